"""How much one task takes in, from the rows of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 100_000  # input rows for each partition that a shuffle begins with
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Bytes that a task reads: the values Spark has at first, which are replaced, and ours.
SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": (("67108864b", "64MB"), "4MB"),
    "spark.sql.files.maxPartitionBytes": (("134217728b", "128MB"), "16MB"),
}

# Rows of one key that a sort merge join keeps outside of Spark's managed memory; more of them
# go to a buffer that can spill. Spark itself sets no bound.
HELD_ROWS = ("spark.sql.sortMergeJoinExec.buffer.in.memory.threshold", "65536")


def bounded_tasks(spark: SparkSession, table: DataFrame) -> None:
    """Sizes the tasks of the session's queries by the rows of `table`.

    A row of the input becomes several keys of an aggregate, and a task holds its keys in memory,
    so that the usual sizes make tasks of gigabytes. Shuffles begin with partitions in proportion
    to the input and small ones are gathered to SIZES. With small tables nothing is set; the
    number of partitions is only raised, and a size that the caller chose is kept.

    A key with very many matches, as the null parameter that stands for all rows, is one task's:
    beyond 2,000 partitions Spark knows only mean sizes and does not split it. Its matches are
    held in a buffer that spills.
    """
    needed = -(-table.count() // TASK_ROWS)
    if needed <= spark.sparkContext.defaultParallelism:
        return
    usual = spark.conf.get("spark.sql.shuffle.partitions", "200")
    if int(spark.conf.get(PARTITIONS, None) or usual) < needed:
        spark.conf.set(PARTITIONS, str(needed))
    for name, (plain, bounded) in SIZES.items():
        if spark.conf.get(name, plain[0]) in plain:
            spark.conf.set(name, bounded)
    name, bounded = HELD_ROWS
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, bounded)
