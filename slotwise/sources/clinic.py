"""The set of domain tables an operator works on, and its Parquet storage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.clock import moment
from slotwise.functions.text import blank_to_null
from slotwise.sources.schemas import TABLES

SLOT_MONTH = "slot_month"
WRITERS = 4


class Clinic:
    """Domain tables by attribute; each is built on first use only.

    `Clinic({"towns": df})` wraps ready DataFrames; values may also be functions
    without arguments that return one.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._tables = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def names(self) -> list[str]:
        return list(self._tables)

    def replace(self, **tables: DataFrame) -> Clinic:
        return Clinic(self._tables | tables)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Clinic:
        """Tables stored by `write`, each with its declared schema."""

        def reader(name: str) -> Callable[[], DataFrame]:
            return lambda: read_table(spark, name, f"{root}/{name}")

        return cls({name: reader(name) for name in TABLES})

    def write(self, root: str) -> None:
        """Store every table as Parquet below `root`, which must be new.

        The tables are written side by side, since most are too small to keep a cluster busy.
        """
        frames = {name: getattr(self, name) for name in TABLES if name in self._tables}
        with ThreadPoolExecutor(WRITERS) as pool:
            jobs = [
                pool.submit(write_table, df, name, f"{root}/{name}")
                for name, df in frames.items()
            ]
        for job in jobs:
            job.result()


def _stored_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from a footer; none for a table by month that has no rows, so no files."""
    try:
        return spark.read.parquet(path).columns
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return []


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table with its declared schema; a required column must be stored.

    Without this check Parquet would read an absent column as null. Optional ones are read so.
    """
    schema = TABLES[name].schema
    found = _stored_columns(spark, path)
    absent = [c for c in TABLES[name].required if found and c not in found]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)} of {name}")
    if name == "tickets":
        schema = type(schema)(list(schema)).add(SLOT_MONTH, "date")
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, name: str, path: str) -> None:
    """Tickets are laid out by month, so that a time filter skips the past by folder.

    The rebalance hint gathers the rows of a month into files of the advisory size: small
    months share no task needlessly and a month that holds most rows is split.
    """
    df = conform(df, name)
    if name != "tickets":
        df.write.parquet(path)
        return
    dated = df.withColumn(SLOT_MONTH, F.trunc("time_begin", "month"))
    dated.hint("rebalance", F.col(SLOT_MONTH)).write.partitionBy(SLOT_MONTH).parquet(path)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Rows for a table: declared columns and types, defaults filled, empty text null.

    A default fills a column that is absent from `df`; a present null stays null, as in an
    insert that names the column.
    """
    table = TABLES[name]
    columns = []
    for field in table.schema:
        if field.name in df.columns:
            value = F.col(field.name)
        elif field.name in table.defaults:
            value = F.lit(table.defaults[field.name])
        elif field.nullable:
            value = F.lit(None)
        else:
            raise ValueError(f"{name}.{field.name} has no default and no value")
        columns.append(value.cast(field.dataType).alias(field.name))
    return blank_to_null(df.select(*columns))


def apply_defaults(df: DataFrame, name: str) -> DataFrame:
    """Defaults of the table also in place of nulls, for feeds that send every column."""
    defaults = {c: v for c, v in TABLES[name].defaults.items() if c in df.columns}
    return conform(df.fillna(defaults) if defaults else df, name)


def tickets_after(tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Tickets that begin after `as_of`; stored tickets leave out the folders before."""
    if SLOT_MONTH in tickets.columns:
        month = as_of.date().replace(day=1)
        tickets = tickets.filter(F.col(SLOT_MONTH) >= F.lit(month)).drop(SLOT_MONTH)
    return tickets.filter(F.col("time_begin") > moment(as_of))
