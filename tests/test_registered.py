"""Every registered query against its DuckDB statement on the small test data."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from slotwise import queries as own  # noqa: E402
from slotwise.oracle import statements  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_a_statement():
    assert set(own.queries()) == set(statements.oracle_sql())
    assert set(own.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 24


@pytest.mark.parametrize("name", list(own.queries()))
def test_query(name, spark, con):
    verdict = check.compare(entry.queries()[name](spark, DATA), con.sql(entry.oracle_sql()[name]))
    assert verdict.startswith("ok"), verdict


def test_sql_queries_keep_the_settings_of_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        made = entry.queries()["sql_towns_by_region"](spark, DATA)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"
