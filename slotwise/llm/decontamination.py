"""Benchmark decontamination with a positional inverted index of the training tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, bounded_batches, stored

WINDOW = 10
BLOCK_WORDS = 500_000  # words of an index block; a longer document is a block of its own
GROUP_BYTES = 8 << 20  # of a row group of the stored index, a few blocks; a task reads one at a time
GAP = 64  # empty positions between documents, more than any window is long
QUERY_WINDOWS = 100_000  # windows that a task holds at once; more are searched in turns

# Fixed rule of the task: what a word is, on UTF-8 bytes, after A-Z became lower case. A
# character outside ASCII has bytes of 0x80 and more alone, so bytes and characters agree.
_BREAKS = bytes(
    ord(chr(b).lower()) if chr(b) in UPPER
    else b if b >= 0x80 or chr(b) in LOWER + "0123456789"
    else 0x20
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words as UTF-8, in order; none for null."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.translate(_BREAKS).split()


BLOCK = T.StructType(
    [
        # a name of the block, for rows with equal or no ids
        T.StructField("block", T.StringType()),
        # documents of the block: ids, numbers of words, position of the first word
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("begins", T.ArrayType(T.IntegerType())),
        # terms of the block, where the postings of each begin, and all postings in order
        T.StructField("terms", T.ArrayType(T.BinaryType())),
        T.StructField("list_begins", T.ArrayType(T.IntegerType())),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)
_ARROW = pa.schema(
    [
        ("block", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int32())),
        ("begins", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.binary())),
        ("list_begins", pa.list_(pa.int32())),
        ("positions", pa.list_(pa.int32())),
    ]
)


def _block(name: str, doc_ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    n = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(n + GAP)])[:-1]
    slot: dict[bytes, int] = {}
    number = slot.setdefault
    of_word = np.array([number(w, len(slot)) for t in texts for w in t], dtype=np.int32)
    at = np.arange(len(of_word)) + np.repeat(np.arange(len(texts)) * GAP, n)
    order = np.argsort(of_word, kind="stable")
    counts = np.bincount(of_word, minlength=len(slot))
    list_begins = np.concatenate([[0], np.cumsum(counts)])
    values = [name, doc_ids, n, begins, list(slot), list_begins, at[order]]
    columns = [pa.array([v], type=f.type) for v, f in zip(values, _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of `docs` (doc_id, text): one row per block of documents.

    A block holds its documents and, for each of its terms, the list of positions. Each task
    writes the blocks of the documents it reads, so nothing is shuffled, frequent terms are
    spread over the blocks, and a lost executor repeats only its own blocks.
    """
    bounded_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        size = made = 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text)
                if ids and size + len(own) > BLOCK_WORDS:
                    yield _block(f"{task}-{made}", ids, texts)
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(doc_id)
                texts.append(own)
                size += len(own) + GAP
        if ids:
            yield _block(f"{task}-{made}", ids, texts)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(plain.mapInArrow(build, BLOCK), "postings", group_bytes=GROUP_BYTES)


def windows(text: str | None, length: int = WINDOW) -> list[list[bytes]]:
    """All runs of `length` words; a text of fewer, but not none, is one run."""
    own = words(text)
    return [own[i : i + length] for i in range(max(1, len(own) - length + 1))] if own else []


class Windows:
    """Query windows as numbers of their terms; -1 where a window is shorter."""

    def __init__(self, items: list[tuple[int, list[bytes]]], length: int):
        self.terms: dict[bytes, int] = {}
        number = self.terms.setdefault
        self.item = np.array([i for i, _ in items], dtype=np.int64)
        self.size = np.array([len(w) for _, w in items], dtype=np.int64)
        self.table = np.full((len(items), length), -1, dtype=np.int64)
        for row, (_, own) in enumerate(items):
            self.table[row, : len(own)] = [number(w, len(self.terms)) for w in own]


def _find(q: Windows, terms: list[bytes], begins: np.ndarray, positions: np.ndarray, slop: int):
    """(window, position) of each match in a block.

    Of each window the shortest posting list gives the candidates; the lists of its other
    terms, from short to long, are shifted by the distance to that term and intersected.
    With `slop`, each term may stand that much off its place in relation to the rarest.
    """
    local = np.full(len(q.terms) + 1, -2, dtype=np.int64)
    local[-1] = -1  # no term at this place of the window
    for k, term in enumerate(terms):
        own = q.terms.get(term)
        if own is not None:
            local[own] = k
    table = local[q.table]
    rows = np.flatnonzero((table != -2).all(axis=1))
    table = table[rows]
    if not len(rows):
        return rows, rows
    lengths = np.diff(begins)
    sizes = np.where(table >= 0, lengths[table], np.iinfo(np.int64).max)
    order = np.argsort(sizes, axis=1, kind="stable")
    first = table[np.arange(len(rows)), order[:, 0]]
    many = lengths[first]
    who = np.repeat(np.arange(len(rows)), many)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    place = positions[begins[first][who] + nth] - order[who, 0]
    # Postings as one sorted array of (term, position).
    wide = np.int64(positions.max(initial=0)) + 2 * GAP
    keys = np.repeat(np.arange(len(lengths)), lengths) * wide + positions
    for k in range(1, table.shape[1]):
        offset = order[who, k]
        term = table[who, offset]
        low = term * wide + np.maximum(place + offset - slop, 0)
        high = term * wide + place + offset + slop
        at = np.searchsorted(keys, low)
        held = keys[np.minimum(at, len(keys) - 1)]
        good = (term < 0) | ((at < len(keys)) & (held >= low) & (held <= high) & (place + offset + slop >= 0))
        who, place = who[good], place[good]
    return rows[who], place


HITS = "block string, doc_id long, n_words long, begin int, item_id long, spans array<struct<a:int,b:int>>"


def find_passages(index: DataFrame, queries: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """Where the windows of `queries` (item_id, text) occur in an index from build_index.

    One row per (block, document, item) with `spans`, the word intervals (a, b) that its windows
    cover, b exclusive; a document without a match has one row with a null item. With
    slop 0 a match is the exact phrase. With slop s > 0 it is a proximity match: each term of
    the window stands at most s words off its place in relation to the rarest one.

    The windows are split into query sets of QUERY_WINDOWS at most, which bounds what goes to
    the tasks; each set is searched in all blocks.
    """
    if length > GAP or slop >= GAP - length:
        raise ValueError(f"windows and slop of less than {GAP} words together")
    rows = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    parts: list[DataFrame] = []
    chosen: list[tuple[int, list[bytes]]] = []

    def search(items: list[tuple[int, list[bytes]]]) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            q = Windows(shared.value, length)
            for batch in batches:
                for row in range(batch.num_rows):
                    one = [batch.column(k)[row].values for k in range(1, 7)]
                    yield _search_block(q, batch.column(0)[row].as_py(), one, slop)

        return index.mapInArrow(run, HITS)

    # Items come one by one; an item's windows are sent on as soon as a set is full.
    for item in rows.toLocalIterator():
        for own in windows(item["text"], length):
            chosen.append((item["item_id"], own))
            if len(chosen) == QUERY_WINDOWS:
                parts.append(search(chosen))
                chosen = []
    parts.append(search(chosen))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _search_block(q: Windows, block: str, one: list, slop: int) -> pa.RecordBatch:
    ids = one[0].to_pylist()
    n, starts = one[1].to_numpy(), one[2].to_numpy()
    begins, positions = (one[k].to_numpy().astype(np.int64) for k in (4, 5))
    which, place = _find(q, one[3].to_pylist(), begins, positions, slop)
    # A beginning may lie up to slop before its document's own, in the gap.
    doc = np.searchsorted(starts, place + slop, side="right") - 1
    a = np.maximum(place - starts[doc] - slop, 0)
    b = np.minimum(place - starts[doc] + q.size[which] + slop, n[doc])
    item = q.item[which]
    order = np.lexsort((b, a, item, doc))
    doc, item, a, b = doc[order], item[order], a[order], b[order]
    # Overlapping intervals of a document and an item become one.
    group = np.ones(len(doc), dtype=bool)
    group[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    number = np.cumsum(group)
    reach = np.maximum.accumulate(b + number * np.int64(1 << 32)) - number * np.int64(1 << 32) if len(b) else b
    fresh = group.copy()
    fresh[1:] |= a[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(doc)) - 1 if len(doc) else head
    spans: dict[tuple[int, int], list] = {}
    for h, e in zip(head.tolist(), last.tolist(), strict=True):
        spans.setdefault((int(doc[h]), int(item[h])), []).append({"a": int(a[h]), "b": int(reach[e])})
    hit = {d for d, _ in spans}
    rows = [(d, i, s) for (d, i), s in spans.items()]
    rows += [(d, None, []) for d in range(len(ids)) if d not in hit]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * len(rows), pa.string()),
            pa.array([ids[d] for d, _, _ in rows], pa.int64()),
            pa.array([int(n[d]) for d, _, _ in rows], pa.int64()),
            pa.array([int(starts[d]) for d, _, _ in rows], pa.int32()),
            pa.array([i for _, i, _ in rows], pa.int64()),
            pa.array([s for _, _, s in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
        ],
        names=["block", "doc_id", "n_words", "begin", "item_id", "spans"],
    )


def contamination(docs: DataFrame, queries: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids of items with occurrences).

    A document word inside any occurrence is hit. Null texts have no words and no hits, null
    items and items without words match nothing, null ids and repeated rows keep their own
    rows, an empty benchmark finds nothing, other columns are left out.
    """
    found = find_passages(build_index(docs), queries, length, slop)
    each = found.groupBy("block", "begin", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.collect_set("item_id").alias("items"),
    )
    # In order of their beginnings, each interval adds what lies beyond the reach so far.
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["reach"], s["b"]).alias("reach"),
        (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["reach"], s["a"]))).alias("n"),
    )
    n_hit = F.aggregate("spans", start, step, lambda acc: acc["n"])
    return each.select("doc_id", "n_words", n_hit.alias("n_hit"), "items")
