"""Places in a global order, from range partitions."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.plans.lineage import durable

ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def numbered(df: DataFrame, order: Sequence[Column], name: str, first: int = 0) -> DataFrame:
    """`df` with the place of each row by `order`, counted from `first`.

    Rows go to sampled ranges of `order`, are sorted and counted off there, and the number of
    rows in the ranges before is added: one shuffle, no window, and only one count per
    partition comes to the driver. `order` should tell rows apart, since rows that agree in
    all of it share a range; the places of such rows are taken in any order. The numbered rows
    are stored, so they keep their places for as long as the result is used.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", F.col("_row"), F.lit(ROW_BITS)).cast("int")
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, total = {}, first
    for part_id, n in sorted(counts):
        starts[part_id] = total - (part_id << ROW_BITS)
        total += n
    table = pa.table({"_part": pa.array(starts, pa.int32()), "_shift": pa.array(starts.values(), pa.int64())})
    shifts = df.sparkSession.createDataFrame(table)
    return (
        placed.withColumn("_part", part)
        .join(shifts, "_part")
        .select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))
    )
