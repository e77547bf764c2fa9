"""Positions and running counts without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one bucket share their sort keys and a range of this many tie-breaking ids, so a
# bucket never holds more rows than this times the rows per id.
ID_RANGE = 65536
BEFORE = (Window.unboundedPreceding, -1)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal; the keys come from the left."""
    names = {k: f"_right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    return left.join(renamed, same).drop(*names.values())


def with_position(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str],
    tie: str,
    within: Sequence[str] = (),
    name: str = "pos",
) -> DataFrame:
    """Add the 1-based place of each row by `order`, then `tie` ascending, per `within`.

    `order` holds sort expressions on the columns `keys`; `keys` and `tie` together are
    unique per `within`. Null keys are a value of their own; `tie` holds no nulls.

    Three small levels replace one window over the whole group: a row number inside a
    bucket of at most ID_RANGE ids, running totals over the buckets of equal keys, and
    running totals over the distinct keys. The last two work on counts that are combined
    before the shuffle, so a group that holds a third of all rows stays spread out.
    """
    before = BEFORE
    same = [*within, *keys]
    bucketed = df.withColumn("_bucket", F.floor(F.col(tie) / ID_RANGE))
    buckets = bucketed.groupBy(*same, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    buckets = buckets.withColumn(
        "_inner",
        F.sum("_n").over(Window.partitionBy(*same).orderBy("_bucket").rowsBetween(*before)),
    )
    groups = buckets.groupBy(*same).agg(F.sum("_n").alias("_n"))
    groups = groups.select(
        *same,
        F.sum("_n")
        .over(Window.partitionBy(*within).orderBy(*order).rowsBetween(*before))
        .alias("_outer"),
    )
    starts = _null_safe(buckets, groups, same).select(
        *same,
        "_bucket",
        (F.coalesce("_inner", F.lit(0)) + F.coalesce("_outer", F.lit(0))).alias("_start"),
    )
    rows = bucketed.withColumn(
        "_row", F.row_number().over(Window.partitionBy(*same, "_bucket").orderBy(tie))
    )
    return _null_safe(rows, starts, [*same, "_bucket"]).select(
        *df.columns, (F.col("_start") + F.col("_row")).alias(name)
    )


def count_before(
    df: DataFrame, flag: Column, by: Sequence[str], order: str, name: str
) -> DataFrame:
    """Add how many rows of the same `by` have `flag` and a smaller `order`.

    `order` holds call numbers, unique whole numbers. The count is the running total over
    ranges of ID_RANGE numbers, summed from counts, plus the one inside the range.
    """
    by = list(by)
    hit = F.when(flag, 1).otherwise(0)
    ranged = df.withColumn("_range", F.floor(F.col(order) / ID_RANGE)).withColumn("_hit", hit)
    totals = ranged.groupBy(*by, "_range").agg(F.sum("_hit").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(*BEFORE))
    totals = totals.select(*by, "_range", earlier.alias("_earlier"))
    inside = F.sum("_hit").over(
        Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(*BEFORE)
    )
    total = F.coalesce("_earlier", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return (
        ranged.withColumn("_inside", inside)
        .join(totals, [*by, "_range"])
        .select(*df.columns, total.alias(name))
    )
