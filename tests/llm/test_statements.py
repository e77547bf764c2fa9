"""The training-data operators that SQL can express, against DuckDB on the small test data."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from slotwise.llm import queries as llm  # noqa: E402

DATA = next(
    (d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
     if all(os.path.exists(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))),
    None,
)
pytestmark = pytest.mark.skipif(DATA is None, reason="no test data")


def test_which_have_a_statement():
    assert set(llm.oracle_sql()) == {"op2_decontamination", "op8_secrets", "op11_merkle"}
    assert llm.oracle_sql().items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query(name, spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    verdict = check.compare(entry.queries()[name](spark, DATA), con.sql(entry.oracle_sql()[name]))
    assert verdict.startswith("ok"), verdict
