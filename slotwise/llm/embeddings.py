"""Near-duplicate embeddings through product quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

SAMPLE = 20_000  # vectors that centroids and codebooks are learned from, at most
MOST_CELLS = 4096
PARTS = 8  # subspaces of a residual
CODES = 64  # codewords of a subspace
BLOCK = 512  # vectors of a list, or queries, that meet in one step
SLACK = 1e-6  # for rounding; the exact cosine decides


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres**2).sum(axis=1))[None] - 2 * points @ centres.T).argmin(axis=1)


def _means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = points[np.sort(draw.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass
class Quantiser:
    """Coarse cells, and codewords for the parts of a vector's residual in its cell."""

    cells: np.ndarray
    books: list[np.ndarray]
    cuts: list[np.ndarray]  # the dimensions of each part

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, length of what the codes miss) of unit vectors."""
        cell = _nearest(x, self.cells)
        rest = x - self.cells[cell]
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        return cell, codes.astype(np.uint8), np.linalg.norm(rest - self.decoded(codes), axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.cells.shape[1]))
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, c] = b[codes[:, k]]
        return out

    def margins(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """How far each x is at least from the border between its cell and every other one.

        x is nearer to its own centroid c than to c', so it is (|x-c'|^2 - |x-c|^2) / (2 |c-c'|)
        away from the plane between both. Rounding makes it smaller, not larger.
        """
        squares = ((x**2).sum(axis=1))[:, None] + (self.cells**2).sum(axis=1)[None] - 2 * x @ self.cells.T
        gap = squares - squares[np.arange(len(x)), home][:, None]
        between = (self.cells**2).sum(axis=1)
        between = between[:, None] + between[None] - 2 * self.cells @ self.cells.T
        apart = np.sqrt(np.maximum(between, 0))[home]
        return np.maximum(gap - SLACK, 0) / (2 * np.maximum(apart, SLACK))

    def probes(self, x: np.ndarray, radius: float) -> list[np.ndarray]:
        """The cells in which a vector within `radius` of x may be: the way to it passes the
        plane between both cells, which is no farther than the vector itself."""
        return [np.flatnonzero(row) for row in self.margins(x, _nearest(x, self.cells)) <= radius + SLACK]

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: exact queries to coded vectors of a cell, by table lookup."""
        rest = x - self.cells[cell]
        total = np.zeros((len(x), len(codes)))
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, c]
            lookup = (part**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * part @ b.T
            total += lookup[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def train(sample: np.ndarray, n_cells: int, seed: int = 5) -> Quantiser:
    cells = _means(sample, n_cells, 8, seed)
    rest = sample - cells[_nearest(sample, cells)]
    cuts = [c for c in np.array_split(np.arange(sample.shape[1]), PARTS) if len(c)]
    return Quantiser(cells, [_means(rest[:, c], CODES, 6, seed + k) for k, c in enumerate(cuts)], cuts)


def _unit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors in double precision; null where a vector links with nothing."""
    for part in parts:
        units = []
        for label, raw in zip(part["label"], part["embedding"], strict=True):
            x = None
            if raw is not None and len(raw) and not pd.isna(label):
                x = np.array([np.nan if v is None else v for v in raw] if raw.dtype == object else raw, dtype=np.float64)
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None
                x = None if x is None else (x / np.linalg.norm(x)).tolist()
            units.append(x)
        yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "unit": units}).astype({"vec_id": "Int64", "label": "Int64"})


def _local(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Links as stars: (node, smallest node) of each component of a block's links."""
    rows, columns = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(linked, columns[None], top).min(axis=1, initial=top))
        new_columns = np.minimum(columns, np.where(linked, new_rows[:, None], top).min(axis=0, initial=top))
        if (new_rows == rows).all() and (new_columns == columns).all():
            break
        rows, columns = new_rows, new_columns
    pairs = np.concatenate([np.stack([left, rows], axis=1), np.stack([right, columns], axis=1)])
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id.

    `vectors` has vec_id, label and embedding. Vectors link when their labels are equal and
    not null and their cosine, in double precision, is `threshold` or more. Equal vectors are
    one node with a count. Cells and codebooks come from a sample of at most `sample` nodes,
    those of the smallest hashes; every node is indexed and every node is a query.

    A query probes the cells whose border is within the radius, however many these are. Two
    vectors of two cells are at least as far apart as both are from the border between these,
    so a probe is left out only if the vector of its label on the other side that is nearest
    to the border, of all there are, is too far for it. In the cells all stay whose table
    distance is no more than the radius and the vector's own coding error, by the triangle
    inequality. Exact cosines decide then. No list and no candidate is cut.

    Cells are dealt out as blocks of lists against blocks of queries, so a hot cell is spread
    over many tasks. A block pair returns counts, and its links as stars of their components,
    not all its pairs.

    Null vectors, zero ones, those with null or non-finite parts and null labels link with
    nothing. Vectors of different lengths don't link. Rows with a null or a repeated id stay;
    a null id has a null component. An empty table gives an empty result.
    """
    plain = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")
    )
    units = stored(plain.mapInPandas(_unit, "vec_id long, label long, unit array<double>"), "units")
    good = units.filter("unit IS NOT NULL AND vec_id IS NOT NULL")
    nodes = stored(
        good.groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes"
    )
    found = [_links(nodes.filter(F.size("unit") == r["d"]), r["d"], r["n"], threshold, sample)
             for r in nodes.groupBy(F.size("unit").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not found:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    counted, edges = found[0]
    for more, further in found[1:]:
        counted, edges = counted.union(more), edges.union(further)
    roots = components(edges)
    named = nodes.join(counted.groupBy("node").agg(F.sum("n_links").alias("others")), "node", "left").join(
        roots, "node", "left"
    )
    own = named.select("label", "unit", "n", "others", F.coalesce("root", "node").alias("component"))
    # Vectors of one node share label and unit vector.
    joined = good.join(own, ["label", "unit"], "left").select(
        "vec_id",
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.col("component").alias("component_id"),
    )
    rest = units.filter("unit IS NULL OR vec_id IS NULL")
    return joined.unionByName(
        rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )


def _links(nodes: DataFrame, d: int, n: int, threshold: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) and links (u, v) among nodes of one length of vectors."""
    spark = nodes.sparkSession
    drawn = nodes.orderBy(F.xxhash64("node"), "label").limit(sample).select("node", "unit").toPandas()
    drawn = drawn.sort_values("node")
    quantiser = train(np.array(drawn["unit"].tolist(), dtype=np.float64), int(min(MOST_CELLS, max(8, n**0.5))))
    radius = float(np.sqrt(2 - 2 * threshold))
    shared = spark.sparkContext.broadcast(quantiser)

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                cell, codes, miss = shared.value.encode(np.array(part["unit"].tolist()))
                yield part.assign(cell=cell, codes=[c.tobytes() for c in codes], miss=miss)

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                home = some["home"].to_numpy()
                far = shared.value.margins(np.array(some["unit"].tolist()), home)
                i, cell = np.nonzero(far <= radius + SLACK)
                i, cell = i[cell != home[i]], cell[cell != home[i]]
                yield some[["row", "label", "home"]].iloc[i].assign(cell=cell, margin=far[i, cell])

    schema = "label long, unit array<double>, node long, n long"
    lists = stored(nodes.mapInPandas(index, schema + ", cell long, codes binary, miss double"), "lists")
    asking = lists.select("label", "unit", "node", "n", F.col("cell").alias("home"), F.xxhash64("label", "unit").alias("row"))
    ways = stored(asking.mapInPandas(probe, "row long, label long, home long, cell long, margin double"), "probes")
    # Of two cells the lower one's vectors ask; links are counted at both ends.
    least = ways.filter("home > cell").groupBy("label", F.col("home").alias("cell"), F.col("cell").alias("home")).agg(
        F.min("margin").alias("least")
    )
    across = ways.filter("home < cell").join(least, ["label", "home", "cell"]).filter(
        F.col("margin") + F.col("least") <= radius + SLACK
    )
    asked_for = ["node", "label", "unit", "n", "home", "cell"]
    away = across.select("row", "label", "home", "cell").join(asking, ["row", "label", "home"]).select(*asked_for)
    queries = stored(away.unionByName(asking.withColumn("cell", F.col("home")).select(*asked_for)), "queries")
    key = ["label", "cell"]
    sizes = lists.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_lists")).join(
        queries.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_queries")), key
    )

    def dealt(rows: DataFrame, own: str, other: str, of: str, to: str) -> DataFrame:
        """Each row in one block of its own side, with all blocks of the other."""
        placed = rows.join(sizes, key)
        mine = F.pmod(F.xxhash64("node"), F.col(of)).alias(own)
        return placed.select("*", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1)).alias(other)).drop(of, to)

    block = [*key, "l", "q"]
    left = dealt(queries, "q", "l", "n_queries", "n_lists").groupBy(*block)
    right = dealt(lists, "l", "q", "n_lists", "n_queries").groupBy(*block)

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
        if not len(asked) or not len(held):
            return empty
        x, y = np.array(asked["unit"].tolist()), np.array(held["unit"].tolist())
        codes = np.frombuffer(b"".join(held["codes"]), dtype=np.uint8).reshape(len(held), -1)
        far = shared.value.distances(x, int(asked["cell"].iloc[0]), codes)
        kept = far <= radius + held["miss"].to_numpy()[None] + SLACK
        a, b = asked["node"].to_numpy(), held["node"].to_numpy()
        kept &= a[:, None] != b[None]
        linked = np.zeros_like(kept)
        for at in range(0, len(x), 64):
            i, j = np.nonzero(kept[at : at + 64])
            linked[at + i, j] = np.einsum("ij,ij->i", x[at + i], y[j]) >= threshold
        counts = linked @ held["n"].to_numpy()
        away = asked["home"].to_numpy() != int(asked["cell"].iloc[0])
        back = linked[away].T @ asked["n"].to_numpy()[away]
        pairs = _local(linked, a, b)
        # Rows with v = -1 count links of u; the others are links.
        ends, counts = np.concatenate([a, b]), np.concatenate([counts, back])
        own = counts > 0
        rows = [(ends[own], np.full(own.sum(), -1), counts[own]), (pairs[:, 0], pairs[:, 1], np.zeros(len(pairs)))]
        u, v, m = (np.concatenate(c).astype(np.int64) for c in zip(*rows, strict=True))
        return pd.DataFrame({"u": u, "v": v, "n": m, "is_count": np.arange(len(u)) < own.sum()})

    made = stored(left.cogroup(right).applyInPandas(meet, "u long, v long, n long, is_count boolean"), "block-links")
    return made.filter("is_count").select(F.col("u").alias("node"), F.col("n").alias("n_links")), made.filter(
        "NOT is_count"
    ).select("u", "v")
