"""Connected components of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the links `edges` (u, v); root is the smallest node of
    its component.

    Large and small stars by turns: each node sends its larger neighbours, then its smaller
    ones, to the smallest of all, until nothing changes, which takes few rounds also for long
    chains. Minima are combined before the shuffle, so a node with very many links is no hot
    group. Each round is stored in the shared folder; only a count and a sum come to the
    driver. Links of a node with itself and null ends are left out. RuntimeError is raised if links
    still change after `ROUNDS` rounds; no partial result is returned.
    """
    links = edges.select(F.col("u"), F.col("v")).filter("u <> v")
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _fingerprint(now)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), "small-star")
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.union(roots)
