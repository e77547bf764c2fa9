"""Passages that repeat across documents, by compact windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, shuffle_parts, slices, stored
from .set_join import WIDTH, Shingles, _mixed, _runs

WORDS = 50  # words of the shortest passage
LEAST = WORDS - WIDTH + 1  # its shingles
NEED = 0.75  # Jaccard similarity of the passages' shingle sets
COMMON = int(np.ceil(LEAST * 2 * NEED / (1 + NEED)))  # shingles of LEAST that similar passages have in common
RUN = COMMON // 2  # equal ones in a row, if one change parts them
CONTEXT = RUN // 2  # of them on the longer side of their minimum
SIDE = 48  # shingles on a side of a minimum that entries are compared by; LEAST or more
OFFSETS = (0, 13, 26, COMMON - 1)  # of runs of COMMON shingles before a minimum
POSTINGS = 400_000
ROUNDS = 2  # in which pairs are verified
AT_ONCE = 1 << 14  # pairs of entries that are compared at once
_SEED = _mixed(np.array([0x9E3779B97F4A7C15], dtype=np.uint64))[0]


def compact_windows(h: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(l, c, r) of all nodes of the Cartesian trees over h within [bounds[i], bounds[i+1])
    that are `least` wide or more.

    All runs inside [l, r) that hold c have their minimum at c, the first of equal ones. The
    trees are built level by level for all documents at once: the minimum of an interval is a
    node, and what is on both sides of it are the intervals of the next level.
    """
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(h) + 1, dtype=np.int64)
    rank[order] = np.arange(len(h))
    rank[len(h)] = len(h)
    l, r = bounds[:-1], bounds[1:]
    found = []
    while True:
        wide = r - l >= least
        l, r = l[wide], r[wide]
        if not len(l):
            break
        cuts = np.stack([l, r], axis=1).ravel()
        c = order[np.minimum.reduceat(rank, cuts)[::2]]
        found.append((l, c, r))
        l, r = np.stack([l, c + 1], axis=1).ravel(), np.stack([c, r], axis=1).ravel()
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_RUNS = [f"run{k}" for k in range(len(OFFSETS))]
_ENTRY = ["token", "context", "before", "node", "c", "width", *_RUNS]
ENTRIES = "token long, context int, before int, node long, c int, width int, " + ", ".join(f"{r} long" for r in _RUNS)


def _signatures(docs: DataFrame) -> DataFrame:
    """One entry per compact window: its min-hash, place, the contexts behind and before its
    minimum, how far it goes to both sides (up to LEAST, packed), and the sums of the runs of
    COMMON shingles that hold its minimum at OFFSETS, 0 where the text has none."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for part in parts:
            at = 0
            for texts in slices(part["text"], 1_000_000):
                nodes = part["node"].to_numpy()[at : at + len(texts)]
                at += len(texts)
                rows = shingles.rows(texts)
                sizes = np.array([len(x) for x in rows], dtype=np.int64)
                h = np.concatenate([*rows, np.zeros(0, dtype=np.uint64)])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                # Sums of mixed hashes over the shingles from c on, up to the text's end.
                sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(h + np.uint64(7)))])
                own = _mixed(h ^ _SEED)
                l, c, r = compact_windows(own, bounds, RUN)
                doc = np.searchsorted(bounds, c, side="right") - 1
                first, end = bounds[doc], bounds[doc + 1]
                ahead = np.minimum(c + CONTEXT, end)
                back = np.maximum(c - CONTEXT, first)
                sides = np.minimum(c - l, LEAST), np.minimum(r - 1 - c, LEAST)
                entry = {
                    "token": own[c].view(np.int64),
                    "context": (sums[ahead] - sums[c]).astype(np.uint32).view(np.int32),
                    "before": (sums[c] - sums[back]).astype(np.uint32).view(np.int32),
                    "node": nodes[doc],
                    "c": (c - first).astype(np.int32),
                    "width": (sides[0] * (LEAST + 1) + sides[1]).astype(np.int32),
                }
                for name, offset in zip(_RUNS, OFFSETS, strict=True):
                    a, b = c - offset, c - offset + COMMON
                    inside = (a >= first) & (b <= end)
                    run = sums[np.where(inside, b, 0)] - sums[np.where(inside, a, 0)]
                    entry[name] = run.view(np.int64)
                yield pd.DataFrame(entry)

    return docs.select("node", "text").mapInPandas(sign, ENTRIES)


def _groups(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the first of its group of equal keys, and whether the group has two
    nodes; `order` sorts by the keys, then by the node, which is the last of them."""
    *keys, node = (k[order] for k in keys)
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    begins = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([begins, [len(order)]]))
    first, several = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=bool)
    first[order] = np.repeat(order[begins], sizes)
    several[order] = np.repeat(node[begins] != node[begins + sizes - 1], sizes)
    return first, several


def _first_of_runs(run: np.ndarray, token: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Of each entry the first, by node, of those that have its run (0: none) in its list."""
    first = np.arange(len(token))
    some = np.flatnonzero(run)
    if len(some):
        order = np.lexsort((node[some], run[some], token[some]))
        first[some] = some[_groups(order, token[some], run[some], node[some])[0]]
    return first


PAIR, PLACE, REST = 0, 1, 2
CANDIDATES = "kind int, u long, v long, w long"


def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *(pa.array(c.astype(np.int64)) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "u", "v", "w"])


def _pair_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
    return _batch(PAIR, pairs[0], pairs[1], np.zeros(pairs.shape[1]))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PAIR: (u, v) of nodes that have a run of COMMON equal shingles around a minimum, v with
    the smallest u of those with this run.

    PLACE: (node, place, width) of the entries that may be in a run of LEAST shingles that
    another node has too. Its longer side around the minimum is CONTEXT long or more, so
    another node has the same context on one side. REST: (node, place, min-hash) of such
    entries that are not held against a smaller node yet; all of them meet in `_near`.
    """
    for run in _runs(batches, _ENTRY):
        token, context, before, node, c, width = (run[x].astype(np.int64) for x in _ENTRY[:6])
        _, ahead_alike = _groups(np.lexsort((node, context, token)), token, context, node)
        _, back_alike = _groups(np.lexsort((node, before, token)), token, before, node)
        alike = ahead_alike | back_alike
        rest = alike.copy()
        index = np.arange(len(token))
        for name in _RUNS:
            first = _first_of_runs(run[name], token, node)
            held = first != index
            rest &= ~held
            other = np.flatnonzero(held & (node[first] != node))
            if len(other):
                yield _pair_batch(node[first[other]], node[other])
        wide = alike & (width // (LEAST + 1) + width % (LEAST + 1) + 1 >= LEAST)
        if wide.any():
            yield _batch(PLACE, node[wide], c[wide], width[wide])
        if rest.any():
            yield _batch(REST, node[rest], c[rest], token[rest])


def _surroundings(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """16 bits of each of the SIDE shingles before each c and from it on; 0 outside the text."""
    small = np.zeros(len(h) + 2 * SIDE, dtype=np.uint16)
    small[SIDE : SIDE + len(h)] = _mixed(h + np.uint64(11)) % np.uint64(65535) + np.uint64(1)
    return small[c[:, None] + np.arange(2 * SIDE)]


def _similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether surroundings x and y have RUN equal shingles around their minimum and COMMON of
    LEAST in common, at places that differ by no more than the shingles that are not."""
    equal = (x == y) & (x != 0)
    ahead, back = equal[:, SIDE:], equal[:, SIDE - 1 :: -1]
    n = np.where(ahead.all(axis=1), SIDE, ahead.argmin(axis=1)) + np.where(back.all(axis=1), SIDE, back.argmin(axis=1))
    good = n >= RUN
    some = np.flatnonzero(good)
    if len(some):
        x, y, hit = x[some], y[some], equal[some]
        for shift in range(1, LEAST - COMMON + 1):
            hit[:, shift:] |= x[:, shift:] == y[:, :-shift]
            hit[:, :-shift] |= x[:, :-shift] == y[:, shift:]
        hit &= x != 0
        sums = np.concatenate([np.zeros((len(hit), 1), dtype=np.int16), np.cumsum(hit, axis=1, dtype=np.int16)], axis=1)
        good[some] = (sums[:, LEAST:] - sums[:, :-LEAST]).max(axis=1) >= COMMON
    return good


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes with similar surroundings of one minimum.

    Each is first held against the smallest with the same run of COMMON shingles. Those that
    are the smallest themselves, or have no such run, are compared with one another, each
    with each that has the same CONTEXT shingles on one side; none is left out.
    """
    for run in _runs(batches, ["token", "node", "around"]):
        token, node = run["token"], run["node"]
        around = np.ascontiguousarray(run["around"]).view(np.uint16)
        mixed = _mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(3))
        alone = np.ones(len(token), dtype=bool)
        index = np.arange(len(token))
        total = mixed[around[:, SIDE : SIDE + COMMON]].sum(axis=1, dtype=np.uint64)
        for offset in range(COMMON):
            a, b = SIDE - offset, SIDE - offset + COMMON
            if offset:
                total += mixed[around[:, a]] - mixed[around[:, b]]
            inside = (around[:, a] != 0) & (around[:, b - 1] != 0)
            first = _first_of_runs(np.where(inside, total, np.uint64(0)), token, node)
            alone &= first == index
            other = np.flatnonzero(node[first] != node)
            if len(other):
                yield _pair_batch(node[first[other]], node[other])
        sides = [mixed[around[:, s]].sum(axis=1, dtype=np.uint64) for s in (slice(SIDE, SIDE + CONTEXT), slice(SIDE - CONTEXT, SIDE))]
        kept = np.flatnonzero(alone)
        for k, side in enumerate(sides):
            order = kept[np.lexsort((side[kept], token[kept]))]
            new = np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (side[order][1:] != side[order][:-1])])
            ends = np.concatenate([np.flatnonzero(new)[1:], [len(order)]])[np.cumsum(new) - 1] if len(order) else order
            place, step = np.arange(len(order)), 0
            while len(place):
                step += 1
                place = place[place + step < ends[place]]
                for at in range(0, len(place), AT_ONCE):
                    i, j = (order[place[at : at + AT_ONCE] + d] for d in (0, step))
                    apart = node[i] != node[j]
                    if k:
                        apart &= sides[0][i] != sides[0][j]
                    i, j = i[apart], j[apart]
                    good = _similar(around[i], around[j])
                    if good.any():
                        yield _pair_batch(node[i[good]], node[j[good]])


def _opened(met: DataFrame, heads: DataFrame) -> DataFrame:
    """PLACE: (token, node) of all runs of LEAST shingles in the compact windows of a text, the
    token being the run's sum. REST: (token, node, around), the token being the min-hash, with
    the surroundings of its minimum."""

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for part in parts:
            at = 0
            for texts in slices(part["text"], 1_000_000):
                some = part.iloc[at : at + len(texts)]
                at += len(texts)
                for node, own, places in zip(some["node"], shingles.rows(texts), some["places"], strict=True):
                    kind, c, w = (np.array([x[k] for x in places], dtype=np.int64) for k in ("kind", "v", "w"))
                    rest = kind == REST
                    if rest.any():
                        around = [x.tobytes() for x in _surroundings(own, c[rest])]
                        yield pd.DataFrame({"kind": REST, "token": w[rest], "node": node, "around": around})
                    c, w = c[~rest], w[~rest]
                    if len(c):
                        first = np.maximum(c - w // (LEAST + 1), c - LEAST + 1)
                        last = np.minimum(c, c + w % (LEAST + 1) - LEAST + 1)
                        # Windows are LEAST wide or more, so each has a run.
                        n = last - first + 1
                        begins = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                        key = np.unique(_sums(own)[begins]).view(np.int64)
                        yield pd.DataFrame({"kind": PLACE, "token": key, "node": node, "around": None})

    def gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for rows in keys(parts):
            held.append(rows)
            size += len(rows)
            if size > 20_000:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    own = met.filter(f"kind <> {PAIR}").groupBy(F.col("u").alias("node"))
    own = own.agg(F.collect_list(F.struct("kind", "v", "w")).alias("places"))
    return heads.select("node", "text").join(own, "node").mapInPandas(gathered, "kind int, token long, node long, around binary")


def _equal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of nodes of which v has a run of LEAST equal shingles with u, the smallest
    node that has this run."""
    for run in _runs(batches, ["token", "node"]):
        token, node = run["token"], run["node"]
        first, _ = _groups(np.lexsort((node, token)), token, node)
        other = np.flatnonzero(node[first] != node)
        if len(other):
            yield _pair_batch(node[first[other]], node[other])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of what `_opened` made, sorted by kind and token: PLACE first, then REST."""
    left: list[pa.RecordBatch] = []

    def of(kind: int, *names: str) -> Iterator[pa.RecordBatch]:
        while True:
            batch = left.pop() if left else next(batches, None)
            if batch is None:
                return
            n = int(np.searchsorted(np.array(batch.column("kind")), kind, side="right"))
            if n:
                yield batch.slice(0, n).select(list(names))
            if n < batch.num_rows:
                left.append(batch.slice(n))
                return

    yield from _equal_runs(of(PLACE, "token", "node"))
    yield from _near(of(REST, "token", "node", "around"))


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [a, b) covered by runs of LEAST shingles of which enough are hit.

    Of two sets of equal size with Jaccard similarity s, 2s / (1 + s) of each are common.
    """
    if len(hit) < LEAST:
        return []
    sums = np.concatenate([[0], np.cumsum(hit)])
    good = np.flatnonzero(sums[LEAST:] - sums[:-LEAST] >= COMMON)
    if not len(good):
        return []
    breaks = np.flatnonzero(np.diff(good) > LEAST)
    heads, tails = good[np.concatenate([[0], breaks + 1])], good[np.concatenate([breaks, [len(good) - 1]])] + LEAST
    found = []
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        own = np.flatnonzero(hit[a:b])
        found.append((a + int(own[0]), a + int(own[-1]) + 1))
    return found


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of mixed hashes over all runs of LEAST shingles."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(x + np.uint64(7)))])
    return sums[LEAST:] - sums[:-LEAST]


def _equal(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, other start, other end) of runs of LEAST shingles or more of x that are in y."""
    own, other = _sums(x), _sums(y)
    order = np.argsort(other, kind="stable")
    at = order[np.minimum(np.searchsorted(other[order], own), len(other) - 1)]
    i = np.flatnonzero(other[at] == own)
    if not len(i):
        return []
    new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(at[i]) != 1)])
    begins = np.flatnonzero(new)
    n = np.diff(np.concatenate([begins, [len(i)]])) + LEAST - 1
    a, c = i[begins], at[i[begins]]
    return list(zip(a.tolist(), (a + n).tolist(), c.tolist(), (c + n).tolist(), strict=True))


def shared_passages(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(start, end, other start, other end, similarity) of the passages of shingle row x that
    are in y too, in shingles."""
    if len(x) < LEAST or len(y) < LEAST:
        return []
    order = np.argsort(y, kind="stable")
    at = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
    hit = y[order][at] == x
    found = []
    for a, b in _spans(hit):
        inside = np.isin(y, x[a:b])
        for c, d in _spans(inside):
            p, q = np.unique(x[a:b]), np.unique(y[c:d])
            common = len(np.intersect1d(p, q, assume_unique=True))
            alike = common / (len(p) + len(q) - common)
            if alike >= NEED and min(b - a, d - c) >= LEAST:
                found.append((a, b, c, d, alike))
                break
        else:
            # Equal passages side by side in x may be apart in y.
            found += [(a + p, a + q, c, d, 1.0) for p, q, c, d in _equal(x[a:b], y)]
    return found


RESULT = "u long, v long, start long, end long, other_start long, other_end long, similarity double"


def _verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingles = Shingles()
    names = [c.split()[0] for c in RESULT.split(", ")]
    for part in parts:
        rows = []
        for u, v, one, two in zip(part["u"], part["v"], part["one"], part["two"], strict=True):
            other, own = shingles.rows([one, two])
            for a, b, c, d, alike in shared_passages(own, other):
                rows.append((u, v, a, b + WIDTH - 1, c, d + WIDTH - 1, alike))
        yield pd.DataFrame(rows, columns=names).astype({"similarity": float} | {n: "int64" for n in names[:-1]})


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of WORDS words or more that a document shares with another one.

    One row per passage of a document and the document it is held against: doc_id, start, end,
    other_id, other_start, other_end (words, ends exclusive), similarity (Jaccard of the
    passages' shingles, NEED or more). Equal texts are one class: each other member has one
    row, with its smallest id and the whole text. Between classes the rows are for their
    smallest ids.

    Min-hashes of shingles group the runs that share a signature: each node of a Cartesian
    tree over them is a compact window. For equal passages the windows are opened where
    contexts repeat, and all their runs of LEAST shingles compared: each document with such a
    run is held against the smallest one that has it, and none is missed. Passages that are
    only similar have COMMON of LEAST shingles in common, which one change parts in two runs,
    one of RUN or more, and meet in the list of its minimum. There a document is held against
    the smallest one with the same run of COMMON shingles; those that have no such smaller one
    are all compared with one another by SIDE shingles on both sides of the minimum, however
    many they are. So a passage that very many documents share gives as many rows as
    documents. A similar passage that ends outside the run its document is held by, and with
    all its minima inside it, is found only if the other document resembles the smallest one
    there; one that several changes part in runs of less than RUN may be missed too. All pairs
    are verified on the whole texts.

    Documents without a repeated passage have no row, and so have null, empty and shorter
    texts and rows with a null id. Repeated rows count once. Other columns are left out. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )
    plain = plain.withColumn("node", F.xxhash64("text"))
    # Words as the shingles have them: all white space of the shingles' rule goes at both ends.
    bare = F.trim(F.first("text"), F.lit(" \t\n\x0b\x0c\r"))
    n_words = F.when(F.length(bare) == 0, 0).otherwise(F.size(F.split(bare, r"[ \t-\r]+")))
    members = stored(plain.groupBy("node", "doc_id").agg(n_words.alias("n_words")), "members")
    classes = members.groupBy("node").agg(F.min("doc_id").alias("first"))
    # A text is signed once: with the smallest id of its class.
    heads = plain.join(classes.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"], "left_semi").dropDuplicates(["node"])
    heads = stored(heads.select("node", "text"), "passage-heads", "zstd")
    release(spark)
    entries = _signatures(heads)
    total = members.agg(F.sum("n_words")).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-total * 2 // RUN // POSTINGS))
    lists = entries.repartition(parts, "token").sortWithinPartitions("token")
    met = stored(lists.mapInArrow(_candidates, CANDIDATES), "passage-lists", "zstd")
    release(spark)
    lists = _opened(met, heads).repartition(parts, "token").sortWithinPartitions("kind", "token")
    near = lists.mapInArrow(_met, CANDIDATES).union(met.filter(f"kind = {PAIR}"))
    agreed = stored(near.select("u", "v").distinct(), "passage-pairs")
    release(spark)
    ends = agreed.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = stored(heads.join(ends, "node", "left_semi").select("node", "text"), "passage-texts", "zstd")
    release(spark)
    found = None
    for part in range(ROUNDS):
        # A pair carries a text through a shuffle; a round's files go before the next round.
        some = agreed.filter(F.pmod(F.xxhash64("u"), F.lit(ROUNDS)) == part)
        both = some.join(texts.select(F.col("node").alias("u"), F.col("text").alias("one")), "u").join(
            texts.select(F.col("node").alias("v"), F.col("text").alias("two")), "v"
        )
        passed = stored(both.select("u", "v", "one", "two").mapInPandas(_verify, RESULT), "passage-found")
        found = passed if found is None else found.unionByName(passed)
        release(spark)
    named = found.join(classes.select(F.col("node").alias("u"), F.col("first").alias("other_id")), "u").join(
        classes.select(F.col("node").alias("v"), F.col("first").alias("doc_id")), "v"
    )
    columns = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"]
    zero, n = F.lit(0).cast("long"), F.col("n_words").cast("long")
    copies = members.filter(f"n_words >= {WORDS}").join(classes, "node").filter("doc_id <> first")
    whole = copies.select(
        "doc_id", zero.alias("start"), n.alias("end"), F.col("first").alias("other_id"), zero.alias("other_start"),
        n.alias("other_end"), F.lit(1.0).alias("similarity"),
    )
    return named.select(*columns).unionByName(whole)
