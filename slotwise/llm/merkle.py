"""Merkle manifest of a table: a log of node digests in postorder, proofs and their check.

Each value of one column has a tree over its rows in order; the roots of these trees are the
leaves of a tree above them. A node is the sha256 of its children's digests as hex text, two
children or, at the end of a level, one. The log of a tree holds the nodes in the order in
which they are complete when leaves are appended one by one. Since a node's place in that
order follows from the numbers of nodes in the subtrees before it, a proof needs no search:
the places of the siblings are computed and read from the log.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.plans.order import numbered

from .common import stored

LEVELS = 12  # levels that one builder works up, so it holds 2 ** LEVELS nodes of the lowest


class Manifest(NamedTuple):
    """`leaves`: the columns kept, leaf, tree, n (leaves of the tree), idx (from 0).
    `log`: tier, tree, block, level, idx, position, digest.
    `trees`: tree, the column of the trees, n, subroot, root, and the top siblings."""

    leaves: DataFrame
    log: list[DataFrame]
    trees: DataFrame
    levels: int


def leaf(*columns: Column) -> Column:
    """sha256 in hex of the columns, each "-" if null, else its bytes' number, ":", its text."""
    texts = [c.cast("string") for c in columns]
    fields = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*(F.coalesce(f, F.lit("-")) for f in fields)).cast("binary"), 256)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def positions(level: int, idx: np.ndarray, n: int) -> np.ndarray:
    """Places, from 0, of the nodes `idx` of a level in the postorder of a tree of n leaves.

    The m leaves before a node's own have 2 m - popcount(m) complete nodes, for m is a multiple
    of the node's width; its own subtree holds ceil(leaves / 2^t) nodes on level t and ends
    with the node.
    """
    before = idx.astype(np.int64) << level
    own = np.minimum(np.int64(1) << level, n - before)
    nodes = sum((own + (1 << t) - 1) >> t for t in range(level + 1))
    return 2 * before - np.bitwise_count(before).astype(np.int64) + nodes - 1


_NODES = "tree long, n long, block long, level int, idx long, position long, digest string, up boolean"


def _builder(base: int, levels: int):
    def build(part: pa.Table) -> pa.Table:
        """Nodes of one aligned block, in the order of their completion."""
        part = part.sort_by("idx")
        tree, n = part["tree"][0].as_py(), part["n"][0].as_py()
        first = part["idx"][0].as_py()
        digests = part["digest"].to_pylist()
        level, found = base, []
        while True:
            idx = np.arange(first, first + len(digests), dtype=np.int64)
            found.append((level, idx, digests))
            if level == base + levels or n <= 1 << level:
                break
            pairs = ("".join(digests[i : i + 2]) for i in range(0, len(digests), 2))
            digests = [hashlib.sha256(p.encode()).hexdigest() for p in pairs]
            first, level = first >> 1, level + 1
        places = np.concatenate([positions(lv, idx, n) for lv, idx, _ in found])
        on = np.concatenate([np.full(len(idx), lv, dtype=np.int32) for lv, idx, _ in found])
        made = pa.table({
            "tree": np.full(len(places), tree),
            "n": np.full(len(places), n),
            "block": np.full(len(places), part["block"][0].as_py()),
            "level": on,
            "idx": np.concatenate([idx for _, idx, _ in found]),
            "position": places,
            "digest": pa.array([d for _, _, own in found for d in own], pa.string()),
            "up": on == base + levels,
        })
        return made.take(np.argsort(places))

    return build


def _grow(items: DataFrame, tallest: int, levels: int) -> list[DataFrame]:
    """The log of all trees over `items` (tree, n, idx, digest), one table per tier of builders.

    A builder writes `levels` levels of one aligned block and hands the node above them, a row
    with `up`, to the next tier, so a tree of any size is built in blocks of equal size.
    """
    tiers = []
    for tier in range((max(tallest, 1) - 1).bit_length() // levels + 1):
        dealt = items.withColumn("block", F.call_function("shiftright", "idx", F.lit(levels)))
        built = dealt.select("tree", "n", "block", "idx", "digest").groupBy("tree", "block")
        nodes = stored(built.applyInArrow(_builder(tier * levels, levels), _NODES), "merkle-log")
        tiers.append(nodes)
        items = nodes.filter("up").select("tree", "n", "idx", "digest")
    return tiers


def _proofs(base: int, levels: int):
    def extract(own: pa.Table, right: pa.Table) -> pa.Table:
        """Siblings of all nodes of a block up to its top, then those of the block itself."""
        if not own.num_rows:
            return own.append_column("siblings", pa.array([], pa.list_(pa.string())))
        n, idx = own["n"][0].as_py(), own["idx"].to_numpy()
        is_node = np.asarray(right["position"].is_valid())
        above = right.filter(pa.array(~is_node))["siblings"].combine_chunks().flatten()
        segment = right.filter(pa.array(is_node)).sort_by("position")
        places = segment["position"].to_numpy()
        # Places in the values: log nodes, then "", then what is above the block.
        values = pa.concat_arrays([segment["digest"].combine_chunks(), pa.array([""], pa.string()), above])
        columns, level, at = [], base, idx
        while level < base + levels and n > 1 << level:
            sibling = at ^ 1
            there = sibling < -(-n >> level)
            place = np.searchsorted(places, positions(level, np.where(there, sibling, at), n))
            columns.append(np.where(there, place, len(places)))
            at, level = at >> 1, level + 1
        columns += [np.full(len(idx), len(places) + 1 + i) for i in range(len(above))]
        takes = np.stack(columns, axis=1).ravel() if columns else np.zeros(0, dtype=np.int64)
        ends = np.arange(len(idx) + 1, dtype=np.int32) * len(columns)
        siblings = pa.ListArray.from_arrays(pa.array(ends), values.take(pa.array(takes)))
        return own.append_column("siblings", siblings)

    return extract


def _paths(items: DataFrame, tiers: list[DataFrame], levels: int) -> DataFrame:
    """`items` (tree, n, idx and any other columns) with the siblings up to the root of their
    tree, "" where a node has none."""
    above = None
    for tier in reversed(range(len(tiers))):
        base = tier * levels
        below = items if tier == 0 else tiers[tier].filter(F.col("level") == base).select("tree", "n", "idx")
        own = below.withColumn("block", F.call_function("shiftright", "idx", F.lit(levels)))
        right = tiers[tier].filter("NOT up").select(
            "tree", "block", "position", "digest", F.lit(None).cast("array<string>").alias("siblings")
        )
        if above is not None:
            right = right.unionByName(above, allowMissingColumns=True)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
        pairs = own.groupBy("tree", "block").cogroup(right.groupBy("tree", "block"))
        found = pairs.applyInArrow(_proofs(base, levels), f"{kinds}, siblings array<string>")
        above = found.select("tree", F.col("idx").alias("block"), "siblings")
    return found.drop("block")


def manifest(
    rows: DataFrame, columns: Sequence[str], by: str, order: str, levels: int = LEVELS, **kept: Column
) -> Manifest:
    """Trees over the rows of each value of `by`, ascending by `order`, and one over the trees.

    `columns` make a leaf; `kept` are further expressions on `rows` that stay beside it. Null
    values of `by` are a tree of their own, the first; other trees are in the bytewise order of
    their value. Null values of `order` come first and equal ones go by leaf, so repeated rows
    are leaves of their own with the same digest and the tree does not depend on the order of
    the input. Empty and very long texts are values like any other. An empty table has an empty
    manifest. Other columns of `rows` are not looked at, whatever their names.

    Leaves get their places from range partitions; a value of `by` that holds all rows is
    spread like any other. Only two numbers and the root come to the driver.
    """
    leaves = rows.select(
        F.col(by).cast("string").alias("_by"),
        F.col(order).alias("_order"),
        leaf(*(F.col(c) for c in columns)).alias("leaf"),
        *(c.alias(name) for name, c in kept.items()),
    )
    ascending = [F.asc_nulls_first(c) for c in ("_by", "_order", "leaf")]
    placed = numbered(leaves, ascending, "_place")
    sizes = placed.groupBy("_by").agg(F.min("_place").alias("_start"), F.count(F.lit(1)).alias("n"))
    trees = stored(numbered(sizes, [F.col("_start")], "tree"), "merkle-trees")
    count, tallest = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    items = placed.join(trees.withColumnRenamed("_by", "_tree_by"), F.col("_by").eqNullSafe(F.col("_tree_by")))
    items = items.select(*kept, "leaf", "tree", "n", (F.col("_place") - F.col("_start")).alias("idx"))
    log = _grow(items.withColumnRenamed("leaf", "digest"), tallest, levels)
    top = F.col("n") <= F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    roots = None
    for nodes in log:
        found = nodes.filter(top & ~F.col("up") & (F.col("idx") == 0)).select("tree", "digest", "level")
        roots = found if roots is None else roots.unionByName(found)
    # A tree's own root is the lowest node that has all its leaves below it.
    subroots = roots.groupBy("tree").agg(F.min_by("digest", "level").alias("subroot"))
    named = stored(trees.join(subroots, "tree").select("tree", F.col("_by").alias(by), "n", "subroot"), "merkle-roots")
    over = named.select(
        F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("digest")
    )
    upper = _grow(over, count, levels)
    root = upper[-1].filter(top & ~F.col("up")).select("digest").first()
    paths = _paths(over.drop("digest"), upper, levels).select(F.col("idx").alias("tree"), F.col("siblings").alias("top_siblings"))
    whole = stored(named.join(paths, "tree").withColumn("root", F.lit(root and root[0])), "merkle-trees")
    return Manifest(items, log, whole, levels)


def proofs(made: Manifest) -> DataFrame:
    """The leaves of a manifest with what proves them: `siblings` up to the root over all
    trees, "" on a level where a node has none, `path`, whose bit i is set where the node of
    level i is the right one, and `subroot` and `root`."""
    paths = _paths(made.leaves, made.log, made.levels)
    tree = made.trees.select("tree", "subroot", "root", "top_siblings")
    path = F.col("idx") + F.call_function("shiftleft", F.col("tree"), height(F.col("n")))
    return paths.join(tree, "tree").select(
        *(c for c in made.leaves.columns if c not in ("tree", "n", "idx")),
        "subroot",
        "root",
        path.alias("path"),
        F.concat("siblings", "top_siblings").alias("siblings"),
    )


def folded(digest: Column, path: Column, siblings: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""

    def side(sibling: Column, level: Column) -> Column:
        right = F.call_function("shiftright", path, level).bitwiseAND(F.lit(1)) == 1
        none = F.lit("")
        return F.struct(
            F.when(right, sibling).otherwise(none).alias("left"), F.when(right, none).otherwise(sibling).alias("right")
        )

    return F.aggregate(
        F.transform(siblings, side),
        digest,
        lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256),
    )
