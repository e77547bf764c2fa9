"""Joins of a table that may be hot on its key with a lookup that is unique on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with a smaller share of the rows than this is not split, so at most 1 / SHARE keys
# per key set come to the driver. The sketch tracks far more keys than that, which keeps its
# error below a tenth of SHARE: no key above SHARE is missed.
SHARE = 0.005
TRACKED = 10000
SALTS = 32
# Fewer rows than this are no load for one task, and each key would hold SHARE of them.
LEAST_ROWS = 1_000


def _hash(keys: Sequence[str]) -> Column:
    """Hash of id columns, equal on both sides of a join whatever whole type they have."""
    return F.xxhash64(*(F.col(k).cast("long") for k in keys))


def hot_keys(df: DataFrame, *key_sets: Sequence[str]) -> list[list[int]]:
    """Per key set the hashes of the keys that hold about SHARE of the rows or more.

    One pass of mergeable sketches, without a shuffle of rows. The list is fixed here, so
    both sides of a join salt alike.
    """
    most = int(1 / SHARE)
    tops = [
        F.call_function("approx_top_k", _hash(keys), F.lit(most), F.lit(TRACKED))
        for keys in key_sets
    ]
    total, *found = df.agg(F.count(F.lit(1)), *tops).first()
    if total < LEAST_ROWS:
        return [[] for _ in key_sets]
    return [
        sorted(top["item"] for top in items if top["count"] >= SHARE * total)
        for items in found
    ]


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    hot: Sequence[int],
    spread_by: str,
    how: str = "inner",
    hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join on `keys`, with each hot key of `facts` spread over SALTS tasks.

    Rows of a hot key get a salt from `spread_by`; the one lookup row of that key is copied
    for every salt. All other keys have salt 0. `how` keeps facts on the left: "inner",
    "left", "left_semi" or "left_anti". `hot` holds hashes of the columns `hot_on`, by
    default of all `keys`.
    """
    keys = list(keys)
    if not hot:
        return facts.join(lookup, keys, how)
    is_hot = _hash(hot_on or keys).isin(*hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = facts.withColumn("_salt", F.coalesce(salt, F.lit(0)))
    copied = lookup.withColumn(
        "_salt", F.explode(F.coalesce(copies, F.array(F.lit(0))))
    )
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
