"""The stages that turn raw documents into packed training sequences."""

from __future__ import annotations

from slotwise.llm.stages import ORACLE_SQL, STAGES, run  # noqa: F401
