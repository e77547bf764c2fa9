"""The nearest row before or after in an order, and what is reached from row to row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.plans.lineage import durable, forget
from slotwise.plans.ranking import BEFORE, ID_RANGE

AFTER = (1, Window.unboundedFollowing)


def nearest(
    df: DataFrame, value: Column, by: Sequence[str], order: str, name: str, *, after: bool = False
) -> DataFrame:
    """Add the `value` of the last row of the same `by` with a smaller `order` that has one.

    `order` holds call numbers, unique whole numbers; `value` is null or a number that rises
    with `order`. With `after` it is that of the first row with a larger `order`. Rows are
    looked through within ranges of ID_RANGE numbers, and the extremes of whole ranges beyond
    them, so a key with all rows is spread over its ranges; without a key, ranges of ranges
    keep each step as small.
    """
    by = list(by)
    best, reach = (F.min, AFTER) if after else (F.max, BEFORE)

    def look(rows: DataFrame, place: str, found: str, depth: int) -> DataFrame:
        """`rows` with the extreme of `_value` over those beyond each in `place`."""
        if depth == 0:
            window = Window.partitionBy(*by).orderBy(place).rowsBetween(*reach)
            return rows.withColumn(found, best("_value").over(window))
        piece = f"_range_{depth}"
        ranged = rows.withColumn(piece, F.floor(F.col(place) / ID_RANGE))
        totals = ranged.groupBy(*by, piece).agg(best("_value").alias("_value"))
        beyond = look(totals, piece, "_beyond", depth - 1).select(*by, piece, "_beyond")
        window = Window.partitionBy(*by, piece).orderBy(place).rowsBetween(*reach)
        inside = ranged.withColumn("_inside", best("_value").over(window))
        return inside.join(beyond, [*by, piece]).select(
            *rows.columns, F.coalesce("_inside", "_beyond").alias(found)
        )

    valued = df.withColumn("_value", value.cast("long"))
    return look(valued, order, name, 1 if by else 2).drop("_value")


def reached(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """(`seq`) of all rows that can be reached from `roots` (seq) by `steps` (seq, target).

    Each row has one target at most, so steps compose: every round follows twice as many of
    them at once, and a path of n rows takes log2(n) rounds however many tasks share it. Only
    the rows and steps of the last round stay stored.
    """
    found = durable(roots.distinct())
    steps = durable(steps.filter(F.col("target").isNotNull()))
    n = found.count()
    while True:
        more = found.join(steps, "seq").select(F.col("target").alias("seq"))
        before, found = found, durable(found.union(more).distinct())
        forget(before)
        now = found.count()
        if now == n:
            forget(steps)
            return found
        n = now
        onward = steps.select(F.col("seq").alias("target"), F.col("target").alias("_next"))
        before, steps = steps, durable(
            steps.join(onward, "target").select("seq", F.col("_next").alias("target"))
        )
        forget(before)
