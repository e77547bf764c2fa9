"""Best-fit packing of documents into sequences by length patterns."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, slices, stored
from .tokenize import word_encoder

SIZE = 4096
END = 1  # id after each document
BINS = 64  # length classes of the patterns
DEPTH = 3  # documents of a pattern at most

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PER_BUCKET = 50_000  # pieces of one length that get their ranks in one task


# ---- the plan: what lengths share a sequence, from the histogram alone -------------------


def patterns(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """All multisets of up to `depth` length classes that fit, as counts per class.

    Class b stands for lengths up to (b + 1) / bins of a sequence.
    """
    found: list[list[int]] = []

    def grow(chosen: list[int], largest: int, left: int) -> None:
        if chosen:
            found.append(chosen)
        if len(chosen) < depth:
            for b in range(min(largest, left), 0, -1):
                grow([*chosen, b], b, left - b)

    grow([], bins, bins)
    counts = np.zeros((len(found), bins))
    for row, chosen in enumerate(found):
        for b in chosen:
            counts[row, b - 1] += 1
    return counts


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| small, by the active set of columns with a positive part."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active.append(best)
        while active:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[active] = z
                break
            now = x[active]
            low = z <= 0
            step = float(np.min(now[low] / np.maximum(now[low] - z[low], 1e-300)))
            x[active] = now + step * (z - now)
            active = [k for k in active if x[k] > 1e-12]
            kept = np.zeros(len(x), dtype=bool)
            kept[active] = True
            x[~kept] = 0
    return x


class Stock:
    """How many pieces of each length are left; lengths are taken in equal runs."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.left)

    def largest(self, room: int, floor: int = 0) -> int | None:
        """The largest length over `floor` that is left and fits into `room`."""
        k = bisect.bisect_right(self.lengths, room)
        return self.lengths[k - 1] if k and self.lengths[k - 1] > floor else None

    def take(self, length: int, count: int) -> None:
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.lengths.remove(length)


def packing_plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences), which use the histogram up.

    The repeat counts of the patterns are fitted to the class histogram by non-negative least
    squares and rounded down. A pattern is filled with the longest lengths left of its
    classes. The rest of a sequence, and all residual pieces, are packed best fit: the longest
    length left that fits into the room. All of it works on runs of equal lengths, so the
    time depends on the number of different lengths (`size` at most), not of documents.
    """
    stock = Stock(histogram)
    width = size / BINS
    b = np.zeros(BINS)
    for length, count in histogram.items():
        b[min(BINS - 1, int(np.ceil(length / width)) - 1)] += count
    table = patterns()
    # Full patterns first come to the fit: among equal fits they leave the least room.
    fill = table @ np.arange(1, BINS + 1) / BINS
    table = table[fill >= 0.9] if (fill >= 0.9).any() else table
    repeats = np.floor(nonnegative_least_squares(table.T, b)).astype(int)
    plan: list[tuple[list[int], int]] = []

    def finish(chosen: list[int], count: int) -> None:
        """Fill the room of `count` equal sequences from the stock, longest first."""
        work = [(chosen, count)]
        while work:
            chosen, count = work.pop()
            room = size - sum(chosen)
            length = stock.largest(room)
            if length is None:
                plan.append((chosen, count))
                continue
            each = min(room // length, max(1, stock.left[length] // count))
            taken = min(count, stock.left[length] // each)
            stock.take(length, taken * each)
            work.append((chosen + [length] * each, taken))
            if count > taken:
                work.append((chosen, count - taken))

    order = np.argsort(-(table @ np.arange(1, BINS + 1)), kind="stable")
    opened: list[tuple[list[int], int]] = []
    for k in order:
        count = int(repeats[k])
        classes = [b for b in range(BINS - 1, -1, -1) for _ in range(int(table[k, b]))]
        while count > 0:
            chosen: list[int] = []
            need: dict[int, int] = defaultdict(int)
            for c in classes:
                top, low = int((c + 1) * width), int(c * width)
                at = bisect.bisect_right(stock.lengths, top)
                length = None
                while at and stock.lengths[at - 1] > low:
                    if stock.left[stock.lengths[at - 1]] > need[stock.lengths[at - 1]]:
                        length = stock.lengths[at - 1]
                        break
                    at -= 1
                if length is None:
                    break
                chosen.append(length)
                need[length] += 1
            if len(chosen) < len(classes):
                break
            taken = min(count, *(stock.left[n] // m for n, m in need.items()))
            for n, m in need.items():
                stock.take(n, taken * m)
            opened.append((chosen, taken))
            count -= taken
    # Long residuals open sequences of their own before short ones fill the rooms.
    residual: list[tuple[list[int], int]] = []
    while (length := stock.largest(size, floor=size // 2)) is not None:
        count = stock.left[length]
        stock.take(length, count)
        residual.append(([length], count))
    for chosen, count in sorted(opened + residual, key=lambda x: size - sum(x[0])):
        finish(chosen, count)
    while (length := stock.largest(size)) is not None:
        count = max(1, stock.left[length] // (size // length))
        each = min(size // length, stock.left[length])
        stock.take(length, count * each)
        finish([length] * each, count)
    return plan


# ---- the pieces and their places ---------------------------------------------------------


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Ids of each document and END, cut into pieces of `size` where they are longer."""
    bounded_batches(docs.sparkSession)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer)
        end = np.array([END], dtype="<u4").tobytes()
        for part in parts:
            found = (ids for texts in slices(part["text"]) for ids in encoder.ids(texts))
            rows = []
            for doc_id, ids in zip(part["doc_id"], found, strict=True):
                data = ids.tobytes() + end
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    piece = data[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """`pieces` with `_rank`, 0, 1, ... among those of equal length.

    A frequent length is dealt to buckets by a hash of the piece; the buckets' counts give
    where their ranks begin, so no task orders more than a bucket.
    """
    buckets = max(1, -(-max(histogram.values(), default=0) // PER_BUCKET))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("_bucket", F.pmod(key, F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_k", F.row_number().over(within) - 1)
    return (
        numbered.join(begins, ["length", "_bucket"])
        .withColumn("_rank", F.col("_begin") + F.col("_k"))
        .drop("_bucket", "_begin", "_k")
    )


def _slots(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, pieces in each, offset of the first)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, count in plan:
        at = 0
        for length, each in Counter(lengths).items():
            rows[length].append((used[length], sequence, each, at))
            used[length] += each * count
            at += each * length
        sequence += count
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Where each piece of each document goes: one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only the histogram
    of lengths (`size` numbers) comes to the driver, and the plan made from it goes to the
    tasks; its size depends on `size` alone. The pieces are stored before, so a lost executor
    doesn't tokenise again, and ranks and plan see the same rows.

    A null or empty text is one piece with the end id alone; null ids and repeated rows are
    packed like any other; an empty table gives an empty result; other columns are left out.
    """
    pieces = stored(cut_pieces(docs, tokenizer, size), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(packing_plan(histogram, size)) if histogram else {}

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            length, rank = part["length"].to_numpy(), part["_rank"].to_numpy()
            sequence, offset = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                table = slots[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * n
            yield part.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    ranked = _ranked(pieces, histogram).select(*pieces.columns, "_rank")
    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
