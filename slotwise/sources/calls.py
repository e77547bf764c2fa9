"""Batches of calls from feeds whose numbers come as text or in other types.

The batch operators rely on a unique `seq`. A feed is typed and looked through here before it
is decided: a call that cannot be placed or read would otherwise be lost or refused in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("request", "cancel")
_WIDE = T.DecimalType(38, 9)


def _whole(column: Column, given: T.DataType) -> Column:
    """A whole number as long; null if the value is none or does not fit."""
    if isinstance(given, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long")
    value = F.trim(column) if isinstance(given, T.StringType) else column
    value = value.try_cast(_WIDE)
    return F.when(value == F.floor(value), value.try_cast("long"))


def _declared(df: DataFrame, schema: T.StructType) -> None:
    absent = [f.name for f in schema if f.name not in df.columns]
    if absent:
        raise ValueError(f"the batch has no column {', '.join(absent)}")


def typed_calls(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns of a batch with their types; other columns are left out.

    Numbers may be given as text, with blanks around them, or in any numeric type. What is no
    whole number becomes null (`call_faults` counts it). An absent column is an error.
    """
    _declared(df, schema)
    columns = []
    for field in schema:
        value = F.col(field.name)
        if isinstance(field.dataType, T.LongType):
            value = _whole(value, df.schema[field.name].dataType)
        else:
            value = value.cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def call_faults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """What is wrong with a batch: `fault` and `n_rows`, one row per kind, zeros included.

    Kinds: a `seq` that is null or unreadable, rows beyond the first of a repeated `seq`, ids
    that are given but are no whole numbers, and in a log an `op` that is unknown or null. A null
    id is no fault; such a call is refused. Rows are counted per `seq` before the shuffle, so a
    `seq` that very many rows share is no hot key.
    """
    numbers = [f.name for f in schema if f.dataType == T.LongType() and f.name != "seq"]
    _declared(df, schema)
    typed = df.select(
        _whole(F.col("seq"), df.schema["seq"].dataType).alias("seq"),
        *(
            (F.col(c).isNotNull() & _whole(F.col(c), df.schema[c].dataType).isNull()).alias(c)
            for c in numbers
        ),
        *(["op"] if "op" in schema.names else []),
    )
    bad = {f"{c} is no whole number": F.col(c) for c in numbers}
    if "op" in schema.names:
        bad["op is unknown"] = ~F.coalesce(F.col("op").isin(*OPS), F.lit(False))
    places = list(enumerate(bad.items()))
    per_seq = typed.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"_{i}") for i, (_, c) in places)
    )
    no_seq = F.col("seq").isNull()
    totals = {
        "seq is missing": F.sum(F.when(no_seq, F.col("n"))),
        "seq is repeated": F.sum(F.when(~no_seq, F.col("n") - 1)),
    } | {name: F.sum(f"_{i}") for i, (name, _) in places}
    pairs = [
        F.struct(F.lit(name).alias("fault"), F.coalesce(total, F.lit(0)).alias("n_rows"))
        for name, total in totals.items()
    ]
    return per_seq.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))


def checked_calls(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`typed_calls`, after one pass that raises ValueError if the batch has any fault."""
    found = [f"{r.fault}: {r.n_rows}" for r in call_faults(df, schema).collect() if r.n_rows]
    if found:
        raise ValueError("calls that cannot be placed or read; " + ", ".join(found))
    return typed_calls(df, schema)
