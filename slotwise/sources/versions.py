"""Versions of stored tables that share what did not change, and tables laid out by buckets."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.sources.clinic import SLOT_MONTH, conform, write_table
from slotwise.sources.schemas import TABLES

FOLDERS = "month string, folder string"
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # Spark's name for the folder of rows without one
_MARK = f"/{SLOT_MONTH}="


def month_folders(tickets: DataFrame) -> dict[str, str]:
    """The folder of each month of stored tickets, from the files that Spark will read."""
    found = {file.rsplit("/", 1)[0] for file in tickets.inputFiles()}
    return {folder.rsplit(_MARK, 1)[1]: folder for folder in found if _MARK in folder}


def read_months(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Tickets from folders of any versions; a filter on the month still skips folders."""
    declared = TABLES["tickets"].schema
    schema = type(declared)(list(declared)).add(SLOT_MONTH, "date")
    by_root: dict[str, list[str]] = defaultdict(list)
    for folder in folders.values():
        by_root[folder.rsplit(_MARK, 1)[0]].append(folder)
    found = spark.createDataFrame([], schema)
    for root, own in sorted(by_root.items()):
        found = found.unionByName(
            spark.read.schema(schema).option("basePath", root).parquet(*sorted(own))
        )
    return found


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """Tickets as of the version that `store_version` wrote below `root`."""
    rows = spark.read.schema(FOLDERS).parquet(f"{root}/tickets_folders").collect()
    return read_months(spark, dict(rows))


def store_version(tickets: DataFrame, changes: DataFrame, root: str) -> DataFrame:
    """A new version of stored tickets with `new_closed` of `changes` (id_ticket, new_closed).

    Only months with a ticket that changes are written, below `root`/tickets; a list of
    folders, one row per month, refers to the others where they are. A version stays as it is
    while later ones are made. `tickets` is a stored table or an earlier version.
    """
    spark = tickets.sparkSession
    folders = month_folders(tickets)
    known = tickets["id"] == changes["id_ticket"]
    changed = tickets.join(changes, known).filter(~F.equal_null("closed", "new_closed"))
    touched = [r[0] for r in changed.select(SLOT_MONTH).distinct().collect()]
    if touched:
        months = F.col(SLOT_MONTH).isin([m for m in touched if m])
        if None in touched:
            months = months | F.col(SLOT_MONTH).isNull()
        own = tickets.filter(months)
        new = own.join(changes, own["id"] == changes["id_ticket"], "left").withColumn(
            "closed", F.coalesce("new_closed", "closed")
        )
        write_table(new, "tickets", f"{root}/tickets")
        names = {NO_MONTH if m is None else m.isoformat() for m in touched}
        written = month_folders(spark.read.parquet(f"{root}/tickets"))
        folders = {m: f for m, f in folders.items() if m not in names} | written
    spark.createDataFrame(sorted(folders.items()), FOLDERS).coalesce(1).write.parquet(
        f"{root}/tickets_folders"
    )
    return read_version(spark, root)


def store_bucketed(
    df: DataFrame, name: str, keys: Sequence[str], buckets: int, table: str, path: str
) -> DataFrame:
    """A declared table as catalog table `table` below `path`, in buckets by `keys`.

    A join on the keys then moves the other side only. The rows are dealt out by bucket before
    they are written, so there is one file per bucket.
    """
    rows = conform(df, name).repartition(buckets, *keys)
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
