"""All DuckDB statements by query name."""

from __future__ import annotations

from slotwise.oracle import booking, generate, quality, reads


def oracle_sql() -> dict[str, str]:
    parts = (reads, booking, quality, generate)
    return {name: sql for part in parts for name, sql in part.statements().items()}
