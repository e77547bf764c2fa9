"""Repeated byte strings of a fixed length, by blockwise suffix sorting with a difference cover.

The suffixes of all texts, up to LENGTH bytes deep, are sorted one bucket at a time; of those
that agree, all but the first in the order of the texts are repeats. Only suffixes that can
agree with another one are sorted. A difference cover tells which: COVER holds, for any two
positions, a distance below PERIOD at which both are sample positions of their texts, so two
equal strings of LENGTH bytes hold, at the same distance, equal strings of LENGTH - PERIOD + 1
bytes at sample positions. The sample strings are ranked first, also bucket by bucket; where
all of those inside a suffix's first LENGTH bytes are the only ones of their kind, the suffix
ties with none.

Strings are ordered by name, a hash, not by their bytes: what agrees matters here,
not which is less. A sample string that shares its name with another costs time alone. Repeats
are sorted under two names that do not depend on each other and must be repeats under both.

Blocks are runs of documents in their order, so the block alone tells which of two equal
names comes first, and a name is one entry of its block, however often it is there. Rows of one
id are one document: their strings are in the order of their starts. Where an id goes on in
other blocks, the entries of its strings hold their starts too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, stored
from .packed import packed, unpacked

LENGTH = 100
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # fixed values: all distances modulo PERIOD are differences of two
BLOCK = 4_000_000  # bytes of a block of more than one document
BUCKET = 2_000_000  # names of a bucket, about
NAMINGS = 2
SAMPLE_BITS = 40  # of the names of sample strings, whose chance ties cost time alone
NAME_BITS = 56  # of each of the two names that a repeat needs
_WORD = 2**64


# ---- names ------------------------------------------------------------------------------


@lru_cache(maxsize=NAMINGS + 1)
def _letters(naming: int) -> tuple[np.ndarray, int]:
    """A random odd number for each byte, and the base of a polynomial."""
    rng = np.random.default_rng(1000 + naming)
    return rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), int(rng.integers(2**62)) * 8 + 5


@lru_cache(maxsize=NAMINGS + 1)
def _kept_powers(naming: int) -> np.ndarray:
    return _powers_of(_letters(naming)[1], BLOCK + 1)


def _powers_of(base: int, n: int) -> np.ndarray:
    powers, done = np.ones(n, dtype=np.uint64), 1
    while done < n:
        more = min(done, n - done)
        powers[done : done + more] = powers[:more] * np.uint64(pow(base, done, _WORD))
        done += more
    return powers


class Names:
    """Names of the strings of a block: polynomials modulo 2^64 from running sums, stirred, of
    which the leading bits are kept."""

    def __init__(self, data: np.ndarray, naming: int):
        letters, base = _letters(naming)
        n = len(data)
        self.powers = _kept_powers(naming) if n <= BLOCK else _powers_of(base, n + 1)
        self.unsized = np.uint64(pow(base, -n, _WORD))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(letters[data] * self.powers[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, length: int, bits: int) -> np.ndarray:
        # Times base^(n - at) and base^-n, so that equal strings have equal names wherever they
        # are, also in blocks of other sizes.
        names = (self.sums[at + length] - self.sums[at]) * self.powers[len(self.sums) - 1 - at]
        names *= self.unsized
        names ^= names >> np.uint64(29)
        names *= np.uint64(0xBF58476D1CE4E5B9)
        names ^= names >> np.uint64(32)
        return names & ~np.uint64((1 << 64 - bits) - 1)


# ---- blocks -----------------------------------------------------------------------------

_TEXTS = ("block", "doc_id", "size", "data")
_BLOCKS = "block long, doc_id array<long>, size array<long>, digest array<binary>, data binary"


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, made = TaskContext.get().partitionId() << 32, 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0

    def row() -> pa.RecordBatch:
        data = zstandard.ZstdCompressor(level=9).compress(b"".join(texts))
        digests = [hashlib.md5(t).digest() for t in texts]
        values = [[first + made], [ids], [[len(t) for t in texts]], [digests], [data]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    for part in parts:
        for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
            data = (text.as_py() or "").encode()
            if texts and held + len(data) > BLOCK:
                yield row()
                made, ids, texts, held = made + 1, [], [], 0
            ids.append(doc_id)
            texts.append(data)
            held += len(data)
    if texts:
        yield row()


class Block:
    """The documents of a block that can hold repeats: long enough, and no whole copies."""

    def __init__(self, row: dict, copies: np.ndarray):
        sizes = np.array(row["size"], dtype=np.int64)
        self.whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), dtype=np.uint8)
        use = sizes >= LENGTH
        use[copies] = False
        self.use, self.all_sizes = np.flatnonzero(use), sizes
        self.data = self.whole[np.repeat(use, sizes)] if not use.all() else self.whole
        self.sizes = sizes[use]
        self.starts = np.cumsum(self.sizes) - self.sizes
        ids = row["doc_id"]
        # Places of the different ids among those of the block.
        nth = np.cumsum([False, *(a != b for a, b in zip(ids, ids[1:], strict=False))])
        self.nth, self.last = nth[use], int(nth[-1])
        self.shared = self.last + 1 < len(ids)

    def placed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the id that each position belongs to, and its start in the text."""
        doc = np.searchsorted(self.starts, at, side="right") - 1
        return self.nth[doc], at - self.starts[doc]

    def samples(self) -> np.ndarray:
        """Positions of the cover whose string ends within its document."""
        length = LENGTH - PERIOD + 1
        longest = int(self.sizes.max(initial=0))
        turns = np.arange(0, longest + PERIOD, PERIOD)
        cover = (turns[:, None] + np.array(COVER)).ravel()
        many = np.searchsorted(cover, self.sizes - length, side="right")
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(self.starts, many) + cover[nth]

    def tied(self, samples: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Positions of suffixes with a repeated sample string among their first bytes."""
        n = len(self.data)
        hits = np.zeros(n + 1, dtype=np.int32)
        hits[samples[repeated] + 1] = 1
        np.cumsum(hits, out=hits)
        inside = np.ones(n, dtype=bool)
        ends = self.starts + self.sizes
        for k in range(1, LENGTH):
            inside[ends - k] = False
        found = np.zeros(n, dtype=bool)
        found[: n - PERIOD] = hits[PERIOD:n] > hits[: n - PERIOD]
        return np.flatnonzero(found & inside)

    def spans(self, repeats: np.ndarray) -> list[list[list[int]]]:
        """Per document of the block, the maximal runs of bytes that the repeats cover."""
        n = len(self.data)
        change = np.zeros(n + 1, dtype=np.int32)
        change[repeats] += 1
        change[repeats + LENGTH] -= 1
        covered = np.zeros(n + 2, dtype=np.int8)
        covered[1 : n + 1] = np.cumsum(change[:n]) > 0
        # A run does not go on into the next document.
        edges = np.diff(covered)
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        cuts = self.starts[(self.starts > 0) & (covered[self.starts] == 1) & (covered[np.minimum(self.starts + 1, n + 1)] == 1)]
        begins, ends = np.sort(np.r_[begins, cuts]), np.sort(np.r_[ends, cuts])
        doc = np.searchsorted(self.starts, begins, side="right") - 1
        found: list[list[list[int]]] = [[] for _ in self.all_sizes]
        for k, i, j in zip(doc.tolist(), begins.tolist(), ends.tolist(), strict=True):
            at = int(self.starts[k])
            found[self.use[k]].append([i - at, j - at])
        return found


# ---- sorting by buckets -----------------------------------------------------------------

_RUNS = "block long, bucket int, names binary, places binary"
_MARKS = "block long, kind int, bucket int, marks binary"
SHARED = -1  # kind of the marks that tell where an id of several blocks begins
MET = NAMINGS + 2  # kind of the marks that tell which first names of suffixes are in other blocks


def _runs(block: int, names: np.ndarray, bits: int, kept: int, places: tuple[np.ndarray, ...] = ()) -> pa.Table:
    """One run of names, of which `kept` bits are, for each bucket, the leading bits; `names` rise. `places` are those of
    the names in the order of all texts, if the block alone does not tell them."""
    bucket = (names >> np.uint64(64 - bits)).astype(np.int64)
    here, firsts = np.unique(bucket, return_index=True)
    parts, beside = [], []
    for i, j in zip(firsts, np.append(firsts, len(names))[1:], strict=True):
        rest = ((names[i:j] & np.uint64((1 << 64 - bits) - 1)) >> np.uint64(64 - kept)).astype(np.int64)
        parts.append(packed(np.diff(rest, prepend=0)))
        beside.append(packed(*(x[i:j] for x in places)) if places else None)
    columns = [np.full(len(here), block), here.astype(np.int32), pa.array(parts, pa.binary()), pa.array(beside, pa.binary())]
    return pa.table(columns, names=["block", "bucket", "names", "places"])


def _after_first(part: pa.Table, names: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Which names of the runs of `part` come later than the first of their kind."""
    rows = zip(part["block"].to_pylist(), part["places"].to_pylist(), sizes, strict=True)
    places = [unpacked(p) if p else [np.full(n, block), np.zeros(n, dtype=np.int64)] for block, p, n in rows]
    block, start = (np.concatenate(x) for x in zip(*places, strict=True))
    order = np.lexsort((start, block, names))
    begins = np.flatnonzero(np.concatenate([[True], np.diff(names[order]) != 0]))
    first = np.repeat(order[begins], np.diff(np.append(begins, len(order))))
    marked = np.zeros(len(names), dtype=bool)
    marked[order] = (block[order] != block[first]) | (start[order] != start[first])
    return marked


def _sorted_bucket(kind: int):
    def sort(part: pa.Table) -> pa.Table:
        """Marks for each run of a bucket: which of its names are in another run (kinds 1 and,
        beside kind 2, MET), or come earlier in one (others)."""
        part = part.sort_by("block")
        runs = [np.cumsum(unpacked(data)[0]) for data in part["names"].to_pylist()]
        names = np.concatenate(runs)
        order = np.argsort(names, kind="stable")
        same = np.diff(names[order]) == 0
        later = np.zeros(len(names), dtype=bool)
        later[order[1:]] = same
        met = later.copy()
        met[order[:-1]] |= same
        if part["places"].null_count < len(part):
            later = _after_first(part, names, [len(r) for r in runs])
        ends = np.cumsum([len(r) for r in runs])
        found = []
        for own, marked in {1: [(1, met)], 2: [(2, later), (MET, met)]}.get(kind, [(kind, later)]):
            marks = [np.packbits(marked[end - len(r) : end]).tobytes() for r, end in zip(runs, ends, strict=True)]
            kinds = pa.array(np.full(len(runs), own, dtype=np.int32))
            columns = [part["block"], kinds, part["bucket"], pa.array(marks, pa.binary())]
            found.append(pa.table(columns, names=["block", "kind", "bucket", "marks"]))
        return pa.concat_tables(found)

    return sort


class Work:
    """A block with the marks that came back for it so far."""

    def __init__(self, blocks: pa.Table, marks: pa.Table, bits: int):
        self.row = blocks.to_pylist()[0]
        self.bits = bits
        rows = sorted(marks.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        self.marks = {kind: {r["bucket"]: r["marks"] for r in rows if r["kind"] == kind} for kind in range(MET + 1)}
        copies = self.marks[0].get(0)
        self.copies = unpacked(copies)[0] if copies else np.zeros(0, dtype=np.int64)
        self.block = Block(self.row, self.copies)
        # The block in which the first and the last id begin, if they are in other blocks too.
        self.begin = {r["bucket"]: int(unpacked(r["marks"])[0][0]) for r in rows if r["kind"] == SHARED}

    def _marked(self, names: np.ndarray, kind: int) -> np.ndarray:
        """What came back for the rising `names`."""
        bucket = (names >> np.uint64(64 - self.bits)).astype(np.int64)
        here, many = np.unique(bucket, return_counts=True)
        found = [np.unpackbits(np.frombuffer(self.marks[kind][b], dtype=np.uint8), count=m) for b, m in zip(here.tolist(), many.tolist(), strict=True)]
        return np.concatenate([np.zeros(0, dtype=np.uint8), *found]).astype(bool)

    def sample_names(self, naming: Names) -> tuple[np.ndarray, ...]:
        at = self.block.samples()
        return at, *np.unique(naming.of(at, LENGTH - PERIOD + 1, SAMPLE_BITS), return_inverse=True, return_counts=True)

    def tied(self, naming: Names) -> tuple[np.ndarray, np.ndarray]:
        """The tied suffixes, and those of them that may have an equal one in another block;
        only their names are sent."""
        at, names, back, many = self.sample_names(naming)
        marked = self._marked(names, 1)
        return self.block.tied(at, (marked | (many > 1))[back]), self.block.tied(at, marked[back])

    def suffix_names(self, tied: np.ndarray, naming: Names) -> tuple[np.ndarray, ...]:
        """The rising names of the tied suffixes, the first suffix of each name, and which
        come later than that. Suffixes of one id with the same start are equally early."""
        names, firsts, back = np.unique(naming.of(tied, LENGTH, NAME_BITS), return_index=True, return_inverse=True)
        if not self.block.shared:
            later = np.ones(len(tied), dtype=bool)
            later[firsts] = False
            return names, firsts, back, later
        nth, start = self.block.placed(tied)
        order = np.lexsort((start, nth, back))
        firsts = order[np.searchsorted(back[order], np.arange(len(names)))]
        return names, firsts, back, (nth != nth[firsts][back]) | (start != start[firsts][back])

    def places(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Block and start by which positions are compared with those of other blocks: in an id
        that is in other blocks too, the block where it begins and the start plus one."""
        if not self.begin:
            return ()
        nth, start = self.block.placed(at)
        block, place = np.full(len(at), self.row["block"]), np.zeros(len(at), dtype=np.int64)
        for end, begin in self.begin.items():
            inside = nth == (0 if end == 0 else self.block.last)
            block[inside], place[inside] = begin, start[inside] + 1
        return block, place

    def met(self, sent: np.ndarray, first: Names) -> np.ndarray:
        """The sent suffixes whose first name another block has too; only these can have an
        equal one there, so only their other names are sent."""
        names, back = np.unique(first.of(sent, LENGTH, NAME_BITS), return_inverse=True)
        return sent[self._marked(names, MET)[back]]

    def repeats(self, tied: np.ndarray, sent: np.ndarray, naming: Names, kind: int) -> np.ndarray:
        """Which of the tied suffixes have an earlier one with the same name, in their block or,
        for those that were sent, in another one."""
        names, _, back, later = self.suffix_names(tied, naming)
        some = np.unique(naming.of(sent, LENGTH, NAME_BITS))
        marked = np.zeros(len(names), dtype=bool)
        marked[np.searchsorted(names, some)] = self._marked(some, kind)
        return later | marked[back]


def _sample_pass(bits: int):
    def name(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        work = Work(blocks, marks, bits)
        return _runs(work.row["block"], work.sample_names(Names(work.block.data, 0))[1], bits, SAMPLE_BITS)

    return name


def _suffix_pass(bits: int, naming: int):
    def name(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        work = Work(blocks, marks, bits)
        first = Names(work.block.data, 0)
        _, sent = work.tied(first)
        own = first
        if naming:
            sent = work.met(sent, first)
            own = Names(work.block.data, naming)
        names, firsts, *_ = work.suffix_names(sent, own)
        return _runs(work.row["block"], names, bits, NAME_BITS, work.places(sent[firsts]))

    return name


_FOUND = "doc_id long, n_bytes long, spans array<array<long>>, kept binary"


def _last_pass(bits: int):
    def cut(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        work = Work(blocks, marks, bits)
        names = Names(work.block.data, 0)
        tied, sent = work.tied(names)
        met = work.met(sent, names)
        found = work.repeats(tied, sent, names, 2)
        for naming in range(1, NAMINGS):
            names = Names(work.block.data, naming)
            found &= work.repeats(tied, met, names, 2 + naming)
        spans = work.block.spans(tied[found])
        for copy in work.copies.tolist():
            spans[copy] = [[0, work.row["size"][copy]]]
        data, kept, at = work.block.whole.tobytes(), [], 0
        for size, own in zip(work.row["size"], spans, strict=True):
            edges = [0, *(x for span in own for x in span), size]
            kept.append(b"".join(data[at + i : at + j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
            at += size
        columns = [
            pa.array(work.row["doc_id"], pa.int64()), pa.array(work.row["size"], pa.int64()),
            pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()),
        ]
        return pa.table(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    return cut


def _whole_copies(blocks: DataFrame) -> DataFrame:
    """Marks of kind 0: places in their blocks of texts that a document of a smaller id holds whole."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("digest", "size", "doc_id")).alias("pos", "own")).select(
        "block", "pos", "own.*"
    )
    long = each.filter(F.col("size") >= LENGTH).withColumn("place", F.struct("block", "pos", "doc_id"))
    firsts = long.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = long.join(firsts, "digest").filter("NOT doc_id <=> first.doc_id").groupBy("block").agg(F.collect_list("pos").alias("at"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            marks = [packed(np.sort(np.array(at, dtype=np.int64))) for at in part["at"]]
            yield pd.DataFrame({"block": part["block"], "kind": 0, "bucket": 0, "marks": marks})

    return copies.mapInPandas(write, _MARKS)


def _shared_ids(blocks: DataFrame) -> DataFrame:
    """Marks of kind SHARED for blocks whose first (bucket 0) or last id (1) is in others too."""
    ends = F.array(F.col("doc_id")[0], F.element_at("doc_id", -1))
    each = blocks.select("block", F.posexplode(ends).alias("bucket", "id"))
    begins = each.groupBy(F.col("id").alias("shared")).agg(F.min("block").alias("begin"), F.max("block").alias("_end"))
    found = each.join(begins.filter("begin <> _end"), F.col("id").eqNullSafe(F.col("shared"))).select("block", "bucket", "begin")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            marks = [packed(np.array([begin], dtype=np.int64)) for begin in part["begin"]]
            yield pd.DataFrame({"block": part["block"], "kind": SHARED, "bucket": part["bucket"], "marks": marks})

    return found.mapInPandas(write, _MARKS)


# Jobs of their own functions, so that no plan of theirs is held and their shuffle files go.


def _in_blocks(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ordered = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ordered.mapInArrow(_blocks, _BLOCKS), "text-blocks")


def _marks(blocks: DataFrame, marks: DataFrame, kind: int, names) -> DataFrame:
    """One pass over the blocks, whose runs of names are sorted bucket by bucket."""
    known = marks.filter(F.col("kind").isin(SHARED, 0, 1, MET)).groupBy("block")
    runs = blocks.select(*_TEXTS).groupBy("block").cogroup(known).applyInArrow(names, _RUNS)
    return stored(runs.groupBy("bucket").applyInArrow(_sorted_bucket(kind), _MARKS), "suffix-marks")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: its UTF-8 bytes' number, the spans [start, end) that repeat, and the rest.

    A byte repeats if a string of LENGTH bytes covers it that also starts earlier, in a
    document with a smaller id or before in the same one. Columns: doc_id (whole numbers),
    n_bytes, spans, kept (bytes, since a span may end inside a character). Null ids come before
    all others and are one id. Rows of one id are one document, in which the start alone tells
    what is earlier: equal rows of one id have equal results. A null text is empty; an empty
    table gives an empty result; other columns are left out.

    Texts are stored once, in blocks of BLOCK bytes or one longer text, and go through four
    passes: cover samples, suffixes under both names, and the cut. Between them only names and
    a bit for each go through a shuffle. Texts that repeat as a whole take no part but for the
    first. There are as many buckets as keep them at BUCKET names, so no task sorts more with
    more data; an id or a copy held by a third of all documents is one name a block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = _in_blocks(docs)
    release(spark)
    total = blocks.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    bits = max(4, (total * len(COVER) // PERIOD // BUCKET).bit_length())
    marks = stored(_whole_copies(blocks).unionByName(_shared_ids(blocks)), "whole-copies")
    for kind, names in [(1, _sample_pass(bits)), *((2 + k, _suffix_pass(bits, k)) for k in range(NAMINGS))]:
        marks = marks.unionByName(_marks(blocks, marks, kind, names))
        release(spark)
    texts = blocks.select(*_TEXTS).groupBy("block")
    return texts.cogroup(marks.groupBy("block")).applyInArrow(_last_pass(bits), _FOUND)
