"""Text helpers for rules where empty text and null are the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_none(value: str | None) -> str | None:
    return value or None


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes null in every text column."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})


def glue(*parts: Column | str | int) -> Column:
    """Concatenation that skips nulls; plain Python values are literals."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("", *[c.cast("string") for c in columns])
