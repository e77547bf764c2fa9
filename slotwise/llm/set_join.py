"""Exact Jaccard join of shingle sets, with skipping by set relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded_batches, forget, release, shuffle_parts, slices, stored
from .components import components

WIDTH = 5  # words of a shingle
PER_CENT = 75
SKETCH = 1 << 20  # counters of the frequency sketch
CHUNK = 1 << 16  # counters that are summed as one row
NEAR = 1  # neighbours in a list, by size, that each set is compared with at first
STEP = 2048  # sets of a long list that meet in one step
POSTINGS = 400_000  # postings of a partition, about
AT_ONCE = 200_000  # postings that a task looks through at once
BITS = 1024  # bits of a set's parity map in lists
WIDEST = 1 << 17  # bits of a large set's own map, at most
BUFFER = 250_000  # characters that are shingled at once
LEADERS = 64  # sets of a long list that others are tied to before the exact pass
MAPS = 1 << 16  # pairs whose parity maps are compared at once

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)]))


_BASE = 0x9E3779B97F4A7C15
_LETTERS = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _FACTORS[1])
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Shingles:
    """64-bit hashes of shingles of lower-cased words.

    A word's hash is a polynomial of its bytes, taken from running sums over a whole buffer,
    so words are not looked up one by one.
    """

    def __init__(self) -> None:
        self._grow(1 << 18)

    def _grow(self, size: int) -> None:
        self.powers = _powers(_BASE, size)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), size)

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin in `data`, and their hashes."""
        raw = np.frombuffer(data, dtype=np.uint8)
        if len(raw) > len(self.powers):
            self._grow(1 << (len(raw) - 1).bit_length())
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[raw] * self.powers[: len(raw)], out=sums[1:])
        known = (sums[ends] - sums[begins]) * self.inverse[np.minimum(begins, len(raw) - 1)]
        return begins, _mixed(known + (ends - begins).astype(np.uint64))

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the hashes of all shingles in order; fewer words than a shingle's are one,
        none none."""
        parts = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
        begins, h = self._words(b" ".join(parts))
        at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        bounds = np.searchsorted(begins, at).tolist()
        whole = _shingled(h, WIDTH)
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            out.append(whole[a : b - WIDTH + 1] if b - a >= WIDTH else _shingled(h[a:b], b - a))
        return out

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its distinct hashes, sorted."""
        return [_distinct(row) for row in self.rows(texts)]

    def of(self, text: str) -> np.ndarray:
        return self.sets([text])[0]


def _shingled(h: np.ndarray, width: int) -> np.ndarray:
    size = len(h) - width + 1
    if size <= 0 or not width:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(size, width, dtype=np.uint64)
    for k in range(width):
        total += h[k : size + k] * _FACTORS[k]
    return _mixed(total)


def _distinct(row: np.ndarray) -> np.ndarray:
    row = np.sort(row)
    return row[np.concatenate([[True], row[1:] != row[:-1]])] if len(row) else row


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def node_of(hashes: np.ndarray) -> int:
    """A set's name: a hash of its sorted elements."""
    return _signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))


def parity_map(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """So many bits; each is the parity of the number of elements that are hashed to it."""
    counts = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def wide_map(hashes: np.ndarray) -> bytes | None:
    """A parity map with two bits an element, for sets that BITS bits can't tell apart."""
    if 2 * len(hashes) <= BITS:
        return None
    return parity_map(hashes, 1 << min(2 * len(hashes) - 1, WIDEST - 1).bit_length())


def _wide_room(n_a: int, a: bytes, n_b: int, b: bytes) -> bool:
    """Whether wide maps leave room for a link; the wider is folded to the other's width."""
    x, y = sorted((np.frombuffer(m, dtype=np.uint64) for m in (a, b)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    apart = int(np.bitwise_count(x ^ y).sum(dtype=np.int64))
    return n_a + n_b - apart >= 2 * int(_needed(np.int64(n_a), np.int64(n_b)))


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection of sets of sizes a and b that link, rounded up."""
    return -(-PER_CENT * (a + b) // (100 + PER_CENT))


SETS = "doc_id long, n long, node long, content long, bits binary, wide binary, chunk int, counts binary"


def _describe(docs: DataFrame) -> DataFrame:
    """Per document its set's size, name and parity map; per task the counters of its shingles."""

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        shingles = Shingles()
        counts = np.zeros(SKETCH, dtype=np.uint32)
        for part in parts:
            sizes, nodes, maps, wide = [], [], [], []
            for texts in slices(part["text"], BUFFER):
                for own in shingles.sets(texts):
                    np.add.at(counts, (own & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
                    sizes.append(len(own))
                    nodes.append(node_of(own) if len(own) else None)
                    maps.append(parity_map(own))
                    wide.append(wide_map(own))
            named = {"doc_id": part["doc_id"], "n": sizes, "node": pd.array(nodes, dtype="Int64"), "content": part["content"]}
            yield pd.DataFrame({**named, "bits": maps, "wide": wide, "chunk": None, "counts": None}).astype({"doc_id": "Int64", "chunk": "Int32"})
        for k in range(SKETCH // CHUNK):
            own = counts[k * CHUNK : (k + 1) * CHUNK]
            if own.any():
                row = {"doc_id": None, "n": 0, "node": None, "content": None, "bits": None, "wide": None, "chunk": k, "counts": own.tobytes()}
                yield pd.DataFrame([row]).astype({"doc_id": "Int64", "node": "Int64", "content": "Int64"})

    return docs.mapInPandas(describe, SETS)


def _frequent(sketches: DataFrame) -> np.ndarray:
    """Which counters are far over the mean: those of frequent shingles, and a few more.

    The counters of a chunk are summed as they come, so a task holds one sketch at most.
    """

    def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for chunk, counts in zip(part["chunk"], part["counts"], strict=True):
                own = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
                sums[chunk] = sums.get(chunk, 0) + own
        if sums:
            yield pd.DataFrame({"chunk": list(sums), "counts": [s.tobytes() for s in sums.values()]})

    counts = np.zeros(SKETCH, dtype=np.int64)
    for r in sketches.repartition(SKETCH // CHUNK, "chunk").mapInPandas(total, "chunk int, counts binary").collect():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(r["counts"], dtype=np.int64)
    return counts > 2 * counts.mean() + 50


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(node, n, tokens) of each different set: the tokens, in the order of all sets, of
    which two linked sets have one in common.

    The order is by hash, with frequent shingles behind all others, so lists stay short.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefix(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        shingles, late = Shingles(), shared.value
        for part in parts:
            nodes, sizes, tokens = [], [], []
            for texts in slices(part["text"], BUFFER):
                for own in shingles.sets(texts):
                    if len(own):
                        behind = late[(own & np.uint64(SKETCH - 1)).astype(np.int64)]
                        ordered = np.concatenate([own[~behind], own[behind]])
                        nodes.append(node_of(own))
                        sizes.append(len(own))
                        tokens.append(ordered[: len(own) - -(-PER_CENT * len(own) // 100) + 1].view(np.int64))
            yield pd.DataFrame({"node": nodes, "n": sizes, "tokens": tokens})

    return docs.select("text").mapInPandas(prefix, "node long, n long, tokens array<long>").dropDuplicates(["node", "n"])


_POSTING = ["token", "node", "n", "at", "before"]


def _may_link(n_a, at_a, before_a, n_b, at_b, before_b) -> np.ndarray:
    """Filters on a common token of two sets, taken for their first common one.

    Sizes must allow a link; what comes from the token's places on must be enough; and where
    the tokens before it are equal too, an earlier list has the pair.
    """
    least = _needed(n_a, n_b)
    fits = (PER_CENT * np.maximum(n_a, n_b) <= 100 * np.minimum(n_a, n_b)) & (np.minimum(n_a - at_a, n_b - at_b) >= least)
    return fits & ~((before_a == before_b) & (at_a > 0) & (at_b > 0))


def _may_overlap(n_a: np.ndarray, map_a: np.ndarray, n_b: np.ndarray, map_b: np.ndarray) -> np.ndarray:
    """Whether parity maps leave room for a link.

    Bits that differ each stand for at least one element that only one of the sets has.
    """
    apart = np.bitwise_count(map_a ^ map_b).sum(axis=1, dtype=np.int64)
    return n_a + n_b - apart >= 2 * _needed(n_a, n_b)


def _values(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of byte strings of one length as rows of 64-bit words."""
    if pa.types.is_integer(column.type):
        return np.array(column, dtype=np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Postings sorted by token, as arrays that end where a token ends."""
    held: list[list[np.ndarray]] = []
    size = 0

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[k] for h in held]) for k, c in enumerate(names)}

    for batch in batches:
        if batch.num_rows:
            held.append([_values(batch.column(k)) for k in range(len(names))])
            size += batch.num_rows
        if size >= AT_ONCE:
            run = joined()
            last = int(np.searchsorted(run["token"], run["token"][-1], side="left"))
            held = [[run[c][last:] for c in names]]
            # A list that is longer than this grows on by halves.
            size = (len(run["token"]) - last) // 2
            if last:
                yield {c: v[:last] for c, v in run.items()}
    if held:
        yield joined()


def _batch(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    size = len(columns[0])
    columns = [np.full(size, kind), *columns, *[np.zeros(size, dtype=np.int64)] * (5 - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["kind", "a", "b", "c", "d", "e"])


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: pairs (a, b) of near neighbours by size in a list. Kind 1: the postings of
    lists that have further pairs."""
    for run in _runs(batches, _POSTING):
        token, node, n, at, before = (run[c] for c in _POSTING)
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.concatenate([begins, [len(token)]]))
        many = np.repeat(sizes, sizes)
        keep = many > 1
        if not keep.any():
            continue
        index = np.arange(len(token))
        pairs = [(index[:-d], index[d:]) for d in range(1, NEAR + 1) if len(index) > d]
        pairs = [(i[token[i] == token[j]], j[token[i] == token[j]]) for i, j in pairs]
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        good = _may_link(n[i], at[i], before[i], n[j], at[j], before[j]) & (node[i] != node[j])
        i, j = i[good], j[good]
        if len(i):
            yield _batch(0, [np.maximum(node[i], node[j]), np.minimum(node[i], node[j])])
        long = many > NEAR + 1
        if long.any():
            yield _batch(1, [token[long], node[long], n[long], at[long], before[long]])


def _leader_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a long list's sets with leaders, so that a group of near copies becomes one
    component from as many pairs as it has sets.

    The set of the smallest name leads all that may link with it by their parity maps, the
    smallest of the rest leads next, and so on. What is left is for the exact pass.
    """
    names = [*_POSTING, "bits"]
    for run in _runs(batches, names):
        token = run["token"]
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])).tolist()
        pairs = []
        for b, e in zip(begins, [*begins[1:], len(token)], strict=True):
            node, n, bits = (run[c][b:e] for c in ("node", "n", "bits"))
            left = np.argsort(node)
            for _ in range(LEADERS):
                if len(left) < 2:
                    break
                first, left = left[0], left[1:]
                room = PER_CENT * np.maximum(n[first], n[left]) <= 100 * np.minimum(n[first], n[left])
                room &= _may_overlap(n[first], bits[first][None], n[left], bits[left])
                found = node[left[room]]
                pairs.append((found, np.full(len(found), node[first])))
                left = left[~room]
        if pairs:
            yield _batch(0, [np.concatenate(x) for x in zip(*pairs, strict=True)])


def _other_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a list whose sets are of different components so far.

    Sets of one component need no comparison, and lists are sorted by size, so whole steps
    are skipped where even their nearest sizes are too far apart. Of many sets that hold one
    passage most pairs don't link; their parity maps show that here, before pairs are made.
    """
    names = [*_POSTING, "root", "bits"]
    for run in _runs(batches, names):
        token = run["token"]
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])).tolist()
        for b, e in zip(begins, [*begins[1:], len(token)], strict=True):
            node, n, at, before, root, bits = (run[c][b:e] for c in names[1:])
            if (root == root[0]).all():
                continue
            for x in range(0, len(node), STEP):
                xs = slice(x, x + STEP)
                for y in range(x, len(node), STEP):
                    ys = slice(y, y + STEP)
                    if 100 * n[xs][-1] < PER_CENT * n[ys][0]:
                        break
                    apart = root[xs][:, None] != root[ys][None]
                    if not apart.any():
                        continue
                    good = apart & _may_link(
                        n[xs][:, None], at[xs][:, None], before[xs][:, None], n[ys][None], at[ys][None], before[ys][None]
                    )
                    left, right = (own + first for own, first in zip(np.nonzero(good), (x, y), strict=True))
                    for k in range(0, len(left), MAPS):
                        i, j = left[k : k + MAPS], right[k : k + MAPS]
                        room = _may_overlap(n[i], bits[i], n[j], bits[j])
                        u, v = node[i[room]], node[j[room]]
                        if len(u):
                            yield _batch(0, [np.maximum(u, v), np.minimum(u, v)])


PAIRS = "kind long, a long, b long, c long, d long, e long"


def _by_token(postings: DataFrame, parts: int, *more: str) -> DataFrame:
    """Sorted lists. A list is met in steps and of each step only links leave the task."""
    return postings.select(*_POSTING, *more).repartition(parts, "token").sortWithinPartitions("token", "n", "node")


def _with_room(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (u, v) whose parity maps leave room for a link."""

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = (np.frombuffer(b"".join(part[c]), dtype=np.uint64).reshape(-1, BITS // 64) for c in ("map_u", "map_v"))
            good = _may_overlap(part["n_u"].to_numpy(), a, part["n_v"].to_numpy(), b)
            both = good & part["wide_u"].notna().to_numpy() & part["wide_v"].notna().to_numpy()
            wide = part.loc[both, ["n_u", "wide_u", "n_v", "wide_v"]]
            good[both] = [_wide_room(*row) for row in wide.itertuples(index=False, name=None)]
            yield part.loc[good, ["u", "v"]]

    for end in ("u", "v"):
        of_end = maps.select(*(F.col(c).alias(f"{x}_{end}") for c, x in (("n", "n"), ("bits", "map"), ("wide", "wide"))), F.col("node").alias(end))
        pairs = pairs.join(of_end, end)
    return pairs.mapInPandas(check, "u long, v long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets link, made anew from the texts, which shuffle smaller."""

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        shingles = Shingles()
        for part in parts:
            good = []
            for a, b in zip(part["one"], part["two"], strict=True):
                x, y = shingles.sets([a, b])
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= PER_CENT * (len(x) + len(y) - common))
            yield part[["u", "v"]][np.array(good, dtype=bool)]

    one = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("one")), "u")
    both = one.join(texts.select(F.col("node").alias("v"), F.col("text").alias("two")), "v")
    return both.select("u", "v", "one", "two").mapInPandas(check, "u long, v long")


def _texts(docs: DataFrame, described: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, text) of one text of each set named in `ends`."""
    wanted = described.join(ends, "node", "left_semi").groupBy("node").agg(F.min("content").alias("content"))
    return docs.join(wanted, "content").dropDuplicates(["content", "node"]).select("node", "text")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set is that of its distinct shingles. Documents link when the Jaccard
    similarity of their sets is PER_CENT or more; component_id is the smallest doc_id that
    links reach. Equal sets are one node. Every set has postings for its prefix, so each pair
    that can link meets in the list of its first common token. Pairs are skipped by size, by
    the token's place, where an earlier list has them, and, in long lists, where the sets are
    in one component already: an answer for one set is one for all that are linked with it.
    Sets of long lists are tied to leaders first, so that few pairs make these components.
    Parity maps bound the intersection of a pair before its texts are fetched; a large set
    has a map of its own width for that.
    All others are compared exactly; no list is cut.

    Null and empty texts and texts without words have 0 shingles and link with nothing; their
    component is their own id. A null id keeps its row and doesn't name a component. Repeated
    rows stay and link as copies. Other columns are left out. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    plain = plain.withColumn("content", F.xxhash64("text"))
    table = stored(_describe(plain), "sets")
    described = table.filter("chunk IS NULL").drop("chunk", "counts", "bits", "wide")
    frequent = _frequent(table.filter("chunk IS NOT NULL").select("chunk", "counts"))
    total = described.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-total * (100 - PER_CENT) // 100 // POSTINGS))

    before = F.when(F.col("at") > 0, F.element_at("tokens", F.col("at"))).otherwise(F.lit(0).cast("long"))
    postings = (
        _prefixes(plain, frequent)
        .select("node", "n", "tokens", F.posexplode("tokens").alias("at", "token"))
        .select("token", "node", "n", F.col("at").cast("long").alias("at"), before.alias("before"))
    )
    met = stored(_by_token(postings, parts).mapInArrow(_first_pairs, PAIRS), "first-pairs")
    near = met.filter("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    long = met.filter("kind = 1").select(*(F.col(c).alias(x) for c, x in zip("abcde", _POSTING, strict=True)))
    ends = _ends(near).union(long.select("node")).distinct()
    maps = table.filter("chunk IS NULL").select("node", "n", "bits", "wide").join(ends, "node", "left_semi")
    maps = stored(maps.dropDuplicates(["node"]), "maps")
    lists = long.join(maps.select("node", "bits"), "node")
    led = _by_token(lists, shuffle_parts(spark), "bits").mapInArrow(_leader_pairs, PAIRS)
    led = led.select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = stored(_with_room(near.union(led).distinct(), maps), "pairs")
    release(spark)
    texts = stored(_texts(plain, described, _ends(pairs)), "texts")
    links = stored(_verified(pairs, texts), "links")
    release(spark)
    roots = stored(components(links), "roots")

    named = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    again = _by_token(named, shuffle_parts(spark), "root", "bits").mapInArrow(_other_pairs, PAIRS)
    more = again.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti")
    more = stored(_with_room(more, maps), "more-pairs")
    if more.take(1):
        texts = stored(_texts(plain, described, _ends(more)), "texts")
        links = links.union(stored(_verified(more, texts), "links"))
        roots = components(links)

    ids = described.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = placed.join(smallest, "root").select("node", "component_id")
    return described.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
