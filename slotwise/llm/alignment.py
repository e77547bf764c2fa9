"""Alignment of two tokenizers by external counting of the id pairs that meet.

Both encode the same bytes; offsets at which tokens of both end cut a text into groups, and
all pairs of tokens of a group are linked. How many documents hold a pair is counted outside
of memory: each batch of documents sorts its (pair, document) records, side A major, and
writes them as compressed runs by radix of the A id. A run has a head, its pairs with their
numbers of documents, and a body, the documents and link counts of each pair. Heads of one
radix are merged through a heap, in tiers of bounded width; since all pairs of an A id are
neighbours in that order, its maximum is known when the next id begins. Then each run gets
back, pair by pair in its own order, the count and whether it is the maximum, and turns them
into sums per document.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, slices, stored
from .packed import packed, unpacked

RADIX = 16  # radix partitions of the A ids
RECORDS = 1 << 21  # pairs of the chunks of documents after which a batch is sorted and written
DOCUMENTS = 1 << 13  # documents of a batch at most
FAN = 64  # heads that one merge takes
STEP = 1 << 16  # pairs of a head that a merge holds at a time
KEPT = 600_000  # chunks whose alignment a worker remembers
LONGEST = 64  # characters of a remembered chunk

# White space at which texts are cut, and all else that any library may take for white space.
_PLAIN = " \t\n"
_ODD = "\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
_ANY_ODD = re.compile(f"[{_ODD}]")
_CHUNK = re.compile(f"[{_PLAIN}]*[^{_PLAIN}]+|[{_PLAIN}]+$")
_CUT = re.compile(f"(?<=[^\\s{_ODD}])(?=[{_PLAIN}])")
# Chunks whose letters, digits and marks no version of Unicode sees differently: those are
# encoded together, by the byte-pair ranks of the same vocabulary.
_COMMON = re.compile(f"[{_PLAIN}]+[!-~¡-ɏЀ-џ‐-‧‰-›€一-龥]+")
_SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value


def chunks(text: str) -> list[str]:
    """`text` cut before runs of blanks, tabs and line ends that follow anything but white space.

    No token of either tokenizer crosses such a place: the byte-level split rule ends a chunk
    there, and no piece of the other goes on with white space (checked when it is loaded).
    """
    return _CUT.split(text) if _ANY_ODD.search(text) else _CHUNK.findall(text)


def _bytes_of_letters() -> dict[str, int]:
    """The letters for which byte-level tokenizers write bytes: printable bytes are themselves,
    the others are numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Links of a chunk's tokens under both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = _bytes_of_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in letters for c in token)
            self.bytes_a[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.bytes_b, self.cuts = [], True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes_b.append(piece.replace("▁", " ").encode())
            inside = "▁" in piece.lstrip("▁") or len(piece) > 1 and any(c in piece for c in _PLAIN)
            self.cuts &= not inside  # else texts stay whole
        self.space = self.b.piece_to_id("▁")
        self.width = -(-len(self.bytes_a) // RADIX)
        self.side = len(self.bytes_b)
        self.length_a, self.length_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        self.fast = self._ranks(vocabulary, letters)
        # An id as text with what follows it: the next id of its side, the other side, a group.
        texts = [str(i).encode() for i in range(max(len(self.bytes_a), self.side))]
        self.marked = [t + mark for mark in (b",", b"|", b";") for t in texts]
        self.marked_length = np.array([len(t) for t in self.marked])
        self.known: dict[str, int] = {}
        self.forget()

    def _ranks(self, vocabulary: dict[str, int], letters: dict[str, int]):
        """A quicker encoder with the same ids, if ids of merged tokens rise with their merges."""
        import tiktoken

        model = json.loads(self.a.to_str())["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocabulary["".join(m)] for m in merges]
        if any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if all(c in letters for c in t)}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {t: i for t, i in ranks.items() if t.decode(errors="replace") not in special}
        return tiktoken.Encoding("pairs", pat_str=_SPLITS, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        """Empties the memory; rows of chunks that were looked up before mean nothing any more."""
        self.known.clear()
        self.chars = 0
        self.texts: list[bytes] = []
        none = np.zeros(0, dtype=np.int64)
        self.rows, self.sizes, self.codes, self.times = none.reshape(0, 4), none, none, none

    def chunks(self, text: str) -> list[str]:
        return chunks(text) if self.cuts else [text]

    def learn(self, new: list[str]) -> None:
        """Chunks of up to LONGEST characters stay known; others have a row for this time only."""
        common, others = [], []
        for c in new:
            plain = self.fast is not None and len(c) <= LONGEST and _COMMON.fullmatch(c)
            (common if plain else others).append(c)
        found = [self._align_one(c) for c in others]
        if common:
            together = self._align_all(common)
            if together is None:
                found += [self._align_one(c) for c in common]
            else:
                self._append(common, *together)
        if found:
            rows, texts, pairs = zip(*found, strict=True)
            codes, times = ([x for p in pairs for x in own(p)] for own in (dict.keys, dict.values))
            sizes = [len(p) for p in pairs]
            self._append(others + common[: len(found) - len(others)], rows, texts, sizes, codes, times)

    def _append(self, new, rows, texts, sizes, codes, times) -> None:
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.texts += texts
        self.rows = np.concatenate([self.rows, np.array(rows, dtype=np.int64)])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, dtype=np.int64)])
        self.codes = np.concatenate([self.codes, np.array(codes, dtype=np.int64)])
        self.times = np.concatenate([self.times, np.array(times, dtype=np.int64)])

    def _align_all(self, new: list[str]):
        """Rows, texts, numbers of pairs, codes and times of common chunks, all at once; None if
        their bytes are changed."""
        text = "".join(new)
        first = 0 if text.startswith(" ") else 1  # the piece for the space that is added
        a = np.array(self.fast.encode_ordinary(text), dtype=np.int64)
        b = np.array(self.b.encode(text[1 - first :], num_threads=1)[first:], dtype=np.int64)
        data = text.encode()
        if any(b"".join(map(known.__getitem__, ids.tolist())) != data for known, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return None
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        mark = np.zeros(len(data) + 1, dtype=np.int8)
        mark[ends_a] += 1
        mark[ends_b] += 2
        ends = np.flatnonzero(mark == 3)
        limits = np.cumsum([len(c.encode()) for c in new])
        if (mark[limits] != 3).any():
            return None
        group_of = np.searchsorted(ends, limits) + 1  # groups up to the end of each chunk
        many_a = np.diff(np.searchsorted(ends_a, ends), prepend=-1)
        many_b = np.diff(np.searchsorted(ends_b, ends), prepend=-1)
        group_a, group_b = (np.repeat(np.arange(len(ends)), many) for many in (many_a, many_b))
        before_a, before_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        links = many_a * many_b
        sums = [np.add.reduceat(x, np.r_[0, group_of[:-1]]) for x in (many_a, many_b, np.ones_like(links), links)]

        # The groups as text: ids in order, those of A before those of B.
        items = np.empty(len(a) + len(b), dtype=np.int64)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        n = len(self.marked) // 3
        items[np.arange(len(a)) + before_b[group_a]] = a + n * last_a
        items[np.arange(len(b)) + (before_a + many_a)[group_b]] = b + 2 * n * last_b
        joined = b"".join(map(self.marked.__getitem__, items.tolist()))
        stops = np.cumsum(self.marked_length[items])[(before_a + many_a + before_b + many_b)[group_of - 1] - 1].tolist()
        texts = [joined[i : j - 1] for i, j in zip([0, *stops], stops, strict=False)]

        # All pairs of a group.
        size = many_b[group_a]
        left = np.repeat(np.arange(len(a)), size)
        right = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + before_b[group_a][left]
        code = (a % RADIX * self.width + a // RADIX)[left] * self.side + b[right]
        chunk = np.searchsorted(group_of, group_a[left], side="right")
        span = RADIX * self.width * self.side
        met, times = np.unique(chunk * span + code, return_counts=True)
        chunk, code = np.divmod(met, span)
        return np.stack(sums, axis=1), texts, np.bincount(chunk, minlength=len(new)), code, times

    def _align_one(self, chunk: str) -> tuple[tuple[int, int, int, int], bytes, dict[int, int]]:
        """Tokens of A and of B, groups and links of a chunk, its groups as text and its linked
        pairs with how often each is linked; -1 tokens if its bytes are changed."""
        data = chunk.encode()
        a = self.a.encode(chunk, add_special_tokens=False).ids
        # The library adds a space before what it gets, but for an empty text.
        b = self.b.encode(chunk.removeprefix(" "), num_threads=1) if chunk != " " else [self.space]
        if not chunk.startswith(" "):
            b = b[1:] if b[:1] == [self.space] else []
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            return (-1, 0, 0, 0), b"", {}
        pairs: dict[int, int] = {}
        texts, links = [], 0
        i = j = end_a = end_b = 0
        while i < len(a):
            first_a, first_b = i, j
            end_a, end_b = end_a + len(parts_a[i]), end_b + len(parts_b[j])
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a, i = end_a + len(parts_a[i]), i + 1
                else:
                    end_b, j = end_b + len(parts_b[j]), j + 1
            own_a, own_b = a[first_a:i], b[first_b:j]
            links += len(own_a) * len(own_b)
            texts.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            # Equal ids of a group go together, so a long group of few ids makes few pairs.
            many_b = Counter(own_b).items()
            for x, times_x in Counter(own_a).items():
                code = (x % RADIX * self.width + x // RADIX) * self.side
                for y, times_y in many_b:
                    pairs[code + y] = pairs.get(code + y, 0) + times_x * times_y
        return (len(a), len(b), len(texts), links), ";".join(texts).encode(), pairs


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_RUNS = pa.schema([
    ("batch", pa.int64()), ("radix", pa.int32()), ("head", pa.binary()), ("body", pa.binary()),
    ("doc_id", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())),
])
_RUNS_DDL = (
    "batch long, radix int, head binary, body binary, doc_id array<long>, totals array<long>, sha array<string>"
)


def _head(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return packed(np.diff(pairs, prepend=0), counts)


def _read_head(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpacked(data)
    return np.cumsum(steps), counts


class Batch:
    """Documents whose records are not yet written."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.totals: list[np.ndarray] = []
        self.sha: list[str] = []
        self.keys: list[np.ndarray] = []  # code of a pair * DOCUMENTS + document of the batch
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, aligner: Aligner, ids: list[int | None], cut: list[list[str]]) -> None:
        rows, sizes, codes, times = aligner.rows, aligner.sizes, aligner.codes, aligner.times
        starts = np.cumsum(sizes) - sizes
        counts = np.array([len(c) for c in cut], dtype=np.int64)
        flat = [aligner.known[c] for own in cut for c in own]
        at, doc = np.array(flat, dtype=np.int64), np.repeat(np.arange(len(cut)), counts)
        bad = np.zeros(len(cut), dtype=bool)
        bad[doc[rows[at, 0] < 0]] = True
        ends = np.cumsum(counts)
        for k, end in enumerate(ends):
            own = not bad[k] and flat[end - counts[k] : end]
            groups = b";".join(map(aligner.texts.__getitem__, own)) if own else b""
            self.sha.append(hashlib.sha256(groups).hexdigest() if own else "")
        good = ~bad[doc]
        met, many = np.unique(doc[good] * len(rows) + at[good], return_counts=True)
        doc, at = np.divmod(met, max(1, len(rows)))
        totals = np.zeros((len(cut), 4), dtype=np.int64)
        np.add.at(totals, doc, rows[at] * many[:, None])
        size = sizes[at]
        place = np.arange(size.sum()) + np.repeat(starts[at] - (np.cumsum(size) - size), size)
        self.keys.append(codes[place] * DOCUMENTS + np.repeat(doc + len(self.ids), size))
        self.times.append(times[place] * np.repeat(many, size))
        self.size += len(place)
        self.ids += ids
        self.totals.append(totals)

    def full(self, more: int) -> bool:
        return self.size >= RECORDS or len(self.ids) + more > DOCUMENTS

    def runs(self, batch: int, span: int) -> pa.RecordBatch:
        """One row of documents, radix -1, and one run for each radix that has records."""
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys)
        keys = keys[order]
        # Chunks of a document share pairs: one record per pair and document, with the sum.
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.add.reduceat(times[order], starts) if len(starts) else times
        pairs, docs = np.divmod(keys[starts], DOCUMENTS)
        radix = pairs // span
        totals = np.concatenate(self.totals).ravel()
        rows = [(batch, -1, None, None, self.ids, totals, self.sha)]
        for r in np.unique(radix):
            own = slice(*np.searchsorted(radix, [r, r + 1]))
            pair, counts = np.unique(pairs[own], return_counts=True)
            # Documents rise within a pair; a step back is an odd number.
            steps = np.diff(docs[own], prepend=0)
            steps = np.where(steps < 0, -2 * steps - 1, 2 * steps)
            rows.append((batch, int(r), _head(pair, counts), packed(steps, times[own]), None, None, None))
        columns = zip(*rows, strict=True)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _RUNS, strict=True)], schema=_RUNS)


def _sorted_runs(path_a: str, path_b: str):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        span = aligner.width * aligner.side
        first, made, batch = TaskContext.get().partitionId() << 32, 0, Batch()
        for part in parts:
            ids = part["doc_id"].to_pylist()
            for texts in slices(part["text"].to_pandas()):
                cut = [aligner.chunks(" " + t) if t else [] for t in texts]
                if batch.ids and batch.full(len(texts)):
                    yield batch.runs(first + made, span)
                    made, batch = made + 1, Batch()
                if len(aligner.texts) > KEPT or aligner.chars > KEPT * LONGEST:
                    aligner.forget()
                new = {c for own in cut for c in own}.difference(aligner.known)
                if new:
                    aligner.learn(list(new))
                batch.add(aligner, ids[: len(texts)], cut)
                ids = ids[len(texts) :]
                for c in new:
                    if len(c) > LONGEST:
                        del aligner.known[c]
        if batch.ids:
            yield batch.runs(first + made, span)

    return write


def merged(heads: list[bytes], step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of sorted heads in order, each once with the sum of its counts.

    A heap holds, for each head, the last pair of the part that it has in hand. What is not
    above the least of these is complete in all of them: it is cut off, sorted together and
    summed, and the head whose part is used up takes the next.
    """
    pending = [_read_head(h) for h in heads]
    at = [0] * len(pending)
    heap = [(int(p[min(step, len(p)) - 1]), k) for k, (p, _) in enumerate(pending) if len(p)]
    heapq.heapify(heap)
    while heap:
        limit, _ = heap[0]
        pairs, counts = [], []
        for k, (p, c) in enumerate(pending):
            end = at[k] + int(np.searchsorted(p[at[k] :], limit, side="right"))
            pairs.append(p[at[k] : end])
            counts.append(c[at[k] : end])
            at[k] = end
        while heap and heap[0][0] <= limit:
            _, k = heapq.heappop(heap)
            p = pending[k][0]
            if at[k] < len(p):
                heapq.heappush(heap, (int(p[min(at[k] + step, len(p)) - 1]), k))
        pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(pair), dtype=np.int64)
        np.add.at(total, back, np.concatenate(counts))
        yield pair, total


def _merge(part: pa.Table) -> pa.Table:
    """One head of all heads of a radix and group."""
    found = list(merged(part["head"].to_pylist()))
    pairs, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    row = {"radix": [part["radix"][0].as_py()], "run": [part["group"][0].as_py()], "head": [_head(pairs, counts)]}
    return pa.table(row, schema=pa.schema([("radix", pa.int32()), ("run", pa.int64()), ("head", pa.binary())]))


def _counted(runs: DataFrame, batches: int) -> DataFrame:
    """(radix, head) with one head per radix: all pairs with their numbers of documents.

    Tier by tier, FAN heads of a radix are merged into one, so no task meets more than that
    many, each as long as the pairs of its batches.
    """
    heads = runs.select("radix", F.col("batch").alias("run"), "head")
    left = batches
    while left > 1:
        left = -(-left // FAN)
        dealt = heads.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(left)))
        heads = stored(
            dealt.groupBy("radix", "group").applyInArrow(_merge, "radix int, run long, head binary"), "pair-counts"
        )
    return heads.select("radix", "head")


_SUMS = "batch long, radix int, sums binary"


def _answers(side: int):
    def answer(runs: pa.Table, totals: pa.Table) -> pa.Table:
        return _sums_of_runs(runs, totals, side)

    return answer


def _sums_of_runs(runs: pa.Table, totals: pa.Table, side: int) -> pa.Table:
    """For each run of a radix and group, sums over its documents: links whose pair is the
    most frequent of its A id, and counts over all links."""
    batches, sums = [], []
    if totals.num_rows:
        pairs, counts = _read_head(totals["head"][0].as_py())
        starts = np.flatnonzero(np.diff(pairs // side, prepend=-1))
        most = np.repeat(np.maximum.reduceat(counts, starts), np.diff(starts, append=len(pairs)))
        best = counts == most
    for batch, head, body in zip(*(runs[c].to_pylist() for c in ("batch", "head", "body")), strict=True):
        own, many = _read_head(head)
        steps, times = unpacked(body)
        docs = np.cumsum(np.where(steps & 1, -(steps + 1) // 2, steps // 2))
        at = np.repeat(np.searchsorted(pairs, own), many)
        found = np.zeros((2, docs.max() + 1), dtype=np.int64)
        np.add.at(found[0], docs, times * best[at])
        np.add.at(found[1], docs, times * counts[at])
        batches.append(batch)
        sums.append(packed(found[0], found[1]))
    made = {"batch": batches, "radix": runs["radix"].combine_chunks(), "sums": sums}
    return pa.table(made, schema=pa.schema([("batch", pa.int64()), ("radix", pa.int32()), ("sums", pa.binary())]))


_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(docs: pa.Table, sums: pa.Table) -> pa.Table:
    ids, totals, sha = (docs[c][0].as_py() for c in ("doc_id", "totals", "sha"))
    own = np.zeros((2, len(ids)), dtype=np.int64)
    for data in sums["sums"].to_pylist():
        best, counts = unpacked(data)
        own[0, : len(best)] += best
        own[1, : len(counts)] += counts
    names = [c.split()[0] for c in _FOUND.split(", ")]
    each = np.array(totals, dtype=np.int64).reshape(-1, 4).T
    values = [pa.array(ids, pa.int64()), *map(pa.array, each), *map(pa.array, own), pa.array(sha, pa.string())]
    return pa.table(dict(zip(names, values, strict=True)))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens, groups, links, links with the most frequent pair of their A id,
    counts summed over all links, and the digest of the groups.

    Columns: doc_id (whole numbers), n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. A null or empty text, and one whose bytes either tokenizer changes, has
    zeros and an empty digest and counts for no pair. Null and repeated ids and equal rows are
    documents like any other; an empty table gives an empty result; other columns are left
    out. A very long text is one document of one batch.

    An id in every document is a hot key only by its records: those stay in the runs of their
    batches, each with at most RECORDS links beyond one document, and only heads, in which a
    pair is one entry per batch, are brought together by id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    runs = stored(plain.mapInArrow(_sorted_runs(path_a, path_b), _RUNS_DDL), "token-runs")
    whole, records = runs.filter("radix = -1"), runs.filter("radix >= 0")
    batches = whole.count()
    totals = stored(_counted(records, batches), "pair-totals")
    release(spark)
    groups = max(1, -(-batches // FAN))
    dealt = records.withColumn("group", F.pmod(F.xxhash64("batch"), F.lit(groups)))
    copies = totals.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "group", F.col("group").cast("long")
    )
    sums = (
        dealt.select("batch", "radix", "group", "head", "body")
        .groupBy("radix", "group")
        .cogroup(copies.groupBy("radix", "group"))
        .applyInArrow(_answers(_aligner(path_a, path_b).side), _SUMS)
    )
    own = whole.select("batch", "doc_id", "totals", "sha").groupBy("batch")
    return own.cogroup(sums.groupBy("batch")).applyInArrow(_finish, _FOUND)
