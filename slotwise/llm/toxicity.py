"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, forget, slices, stored

SAMPLE = 20_000  # labelled documents to learn from, at most
BUCKETS = 1 << 20  # terms are hashed to so many numbers
CHOSEN = 2048  # numbers that the model keeps for telling the classes apart alone
PAIRED = 128  # and numbers that it keeps for what they tell beside another one
PAIR_TERMS = 8192  # pairs are counted among so many of the most frequent numbers
PAIR_CLEAR = 8.0  # signed root of the deviance that a pair must reach; chance stays below
BLOCK = 512  # numbers on each side of a block of pairs that one task counts
FACTORS = 8
ROUNDS = 150
KEPT = 300_000  # words whose columns a worker remembers
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


def word_terms(word: str) -> list[int]:
    """Hash numbers of a word and of its beginnings; invented compounds share a beginning."""
    found = ["w" + word[:64]] + [f"p{word[:n]}" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in found]


class Terms:
    """Terms of texts as sets of columns; columns that are not chosen fall away."""

    def __init__(self, column: np.ndarray | None = None):
        self.column = column
        self.known: dict[str, tuple[int, ...]] = {}

    def _columns(self, word: str) -> tuple[int, ...]:
        found = word_terms(word)
        if self.column is not None:
            found = [c for c in self.column[found].tolist() if c >= 0]
        return tuple(found)

    def of(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        found: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            own = known.get(word)
            if own is None:
                own = known[word] = self._columns(word)
            found.update(own)
        return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass
class Machine:
    """score = bias + sum of weights + sum over pairs of terms of the products of factors."""

    column: np.ndarray  # of a hash number: its column, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def sums(self, columns: np.ndarray, of_row: np.ndarray, n: int) -> np.ndarray:
        """Sum of each factor over the terms of each of `n` rows; one by one, which bounds the memory."""
        return np.stack([np.bincount(of_row, v[columns], n) for v in np.ascontiguousarray(self.factors.T)])

    def margins(self, columns: np.ndarray, of_row: np.ndarray, sums: np.ndarray) -> np.ndarray:
        own = self.weights - 0.5 * (self.factors**2).sum(1)
        return self.bias + np.bincount(of_row, own[columns], sums.shape[1]) + 0.5 * (sums**2).sum(0)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        columns = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        of_row = np.repeat(np.arange(len(counts)), counts)
        margins = self.margins(columns, of_row, self.sums(columns, of_row, len(counts)))
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def _counts(rows: DataFrame) -> DataFrame:
    """Rows (`n`) and rows of label 1 (`one`) that hold each hash number."""
    return (
        rows.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("one"), F.count(F.lit(1)).alias("n"))
        .filter("n >= 4")
    )


def _clear(ones: np.ndarray, n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Signed root of the deviance of `ones` among `n` from a `rate`; 0 where n is 0."""
    share = ones / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.where(ones > 0, ones * np.log(share / rate), 0.0)
        second = np.where(n > ones, (n - ones) * np.log((1 - share) / (1 - rate)), 0.0)
    return np.sign(share - rate) * np.sqrt(2 * np.maximum(first + second, 0.0))


def pair_clear(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How far the rows that hold a pair differ in their labels from those of either term.

    `a` and `b` are 0/1 matrices of rows by terms. A pair counts by the lesser of its two
    distances, and not at all if it is above one term's rate and below the other's; so terms
    that always come together tell nothing as a pair.
    """
    one = labels.astype(bool)
    both = (a.T @ b).astype(np.float64)
    ones = (a[one].T @ b[one]).astype(np.float64)
    rates = [(x[one].sum(0, dtype=np.float64) + 0.5) / (x.sum(0, dtype=np.float64) + 1) for x in (a, b)]
    left = _clear(ones, both, rates[0][:, None])
    right = _clear(ones, both, rates[1][None, :])
    return np.where(left * right > 0, np.minimum(np.abs(left), np.abs(right)), 0.0)


def paired(rows: DataFrame, counts: DataFrame) -> list[int]:
    """At most PAIRED hash numbers that tell the classes apart beside another number.

    Pairs are counted among the PAIR_TERMS numbers that most rows hold, in blocks of BLOCK by
    BLOCK numbers, one task each. Rows travel as bits, PAIR_TERMS of them for each of the
    learning rows, whose number is bounded too. Rows alike in these numbers and in the label
    count once, or a text copied often would make all its pairs look clear.
    """
    spark = rows.sparkSession
    often = sorted(r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(PAIR_TERMS).collect())
    column = np.full(BUCKETS, -1, dtype=np.int32)
    column[often] = np.arange(len(often))
    place = spark.sparkContext.broadcast(column)

    def bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held = np.zeros((len(part), len(often)), dtype=np.uint8)
            for k, terms in enumerate(part["terms"]):
                found = place.value[terms]
                held[k, found[found >= 0]] = 1
            yield pd.DataFrame({"toxic": part["toxic"], "bits": [r.tobytes() for r in np.packbits(held, axis=1)]})

    found = rows.mapInPandas(bits, "toxic int, bits binary").distinct().collect()
    if not found or not often:
        return []
    labels = np.array([r["toxic"] for r in found])
    packed = np.array([np.frombuffer(r["bits"], np.uint8) for r in found])
    shared = spark.sparkContext.broadcast((labels, packed))

    def block(k: int) -> np.ndarray:
        part = shared.value[1][:, k * BLOCK // 8 : (k + 1) * BLOCK // 8]
        return np.unpackbits(part, axis=1).astype(np.float32)

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, j in zip(part["i"], part["j"]):
                clear = pair_clear(block(i), block(j), shared.value[0])
                for k, most in ((i, clear.max(1)), (j, clear.max(0))):
                    places = np.flatnonzero(most > PAIR_CLEAR)
                    yield pd.DataFrame({"place": places + k * BLOCK, "clear": most[places].round(6)})

    blocks = range(-(-len(often) // BLOCK))
    tasks = [(i, j) for i in blocks for j in blocks if i <= j]
    pairs = spark.createDataFrame(tasks, "i int, j int").repartition(len(tasks), "i", "j")
    most = pairs.mapInPandas(best, "place int, clear double").groupBy("place").agg(F.max("clear").alias("clear"))
    return [often[r["place"]] for r in most.orderBy(F.desc("clear"), "place").limit(PAIRED).collect()]


def choose(rows: DataFrame) -> np.ndarray:
    """Column of each hash number that the model keeps: 0, 1, ...; -1 for the others.

    Kept are the CHOSEN numbers of clearest log odds and the `paired` ones, which may be
    neutral alone. `rows` has toxic (0 or 1) and terms (distinct hash numbers). Counts are
    made in Spark; only the chosen numbers come to the driver.
    """
    totals = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = max(1, totals["n1"]), max(1, totals["n"] - totals["n1"])
    one = F.col("one") + 0.5
    zero = F.col("n") - F.col("one") + 0.5
    odds = F.log(one / (n1 + 1 - one)) - F.log(zero / (n0 + 1 - zero))
    counts = stored(_counts(rows), "term-counts")
    clear = counts.select("term", F.round(F.abs(odds) / F.sqrt(1 / one + 1 / zero), 6).alias("clear"))
    best = clear.filter("clear > 2").orderBy(F.desc("clear"), "term").limit(CHOSEN).collect()
    kept = sorted({r["term"] for r in best} | set(paired(rows, counts)))
    column = np.full(BUCKETS, -1, dtype=np.int32)
    column[kept] = np.arange(len(kept))
    return column


def fit(column: np.ndarray, kept: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine for rows of columns: log loss with decay of weights and factors, by full
    steps with adapted rates (Adam).

    Without rows of both labels the score is the share of label 1 (0 for no rows).
    """
    labels = np.asarray(labels, dtype=float)
    size = max(1, int(column.max(initial=-1)) + 1)
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    model = Machine(column, bias, np.zeros(size), np.zeros((size, FACTORS)))
    if not 0 < share < 1:
        return model
    counts = np.array([len(c) for c in kept], dtype=np.int64)
    columns = np.concatenate(kept).astype(np.int64)
    of_row = np.repeat(np.arange(len(kept)), counts)
    model.factors = np.random.default_rng(seed).normal(0, 0.01, (size, FACTORS))
    theta = np.concatenate([[bias], model.weights, model.factors.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    decay = np.concatenate([[0.0], np.full(size, 1e-4), np.full(size * FACTORS, 1e-3)])
    for k in range(1, ROUNDS + 1):
        model.bias, model.weights = theta[0], theta[1 : size + 1]
        model.factors = theta[size + 1 :].reshape(size, FACTORS)
        sums = model.sums(columns, of_row, len(counts))
        p = 1 / (1 + np.exp(-np.clip(model.margins(columns, of_row, sums), -30, 30)))
        error = (p - labels) / len(labels)
        each = error[of_row]
        own = np.bincount(columns, each, size)
        pairs = np.empty((size, FACTORS))
        for f in range(FACTORS):
            pairs[:, f] = np.bincount(columns, (error * sums[f])[of_row], size)
        pairs -= model.factors * own[:, None]
        slope = np.concatenate([[error.sum()], own, pairs.ravel()]) + decay * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta - 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    model.bias, model.weights = float(theta[0]), theta[1 : size + 1]
    model.factors = theta[size + 1 :].reshape(size, FACTORS)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from at most `sample` labelled documents outside the held-out fold.

    The sample is that of the smallest hashes of the id. Rows of `labels` with a null id or
    label are left out, and of repeated ids the larger label counts. Terms are counted in
    Spark; of the sample only the columns that the model keeps come to the driver.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(fold() != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Terms()
        for part in parts:
            rows = [found.of(t) for texts in slices(part["text"]) for t in texts]
            yield pd.DataFrame({"toxic": part["toxic"], "terms": rows})

    # The sample has a proven bound, so it may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = texts.join(F.broadcast(known), "doc_id").select("toxic", "text")
    rows = stored(made.mapInPandas(terms, "toxic int, terms array<int>"), "terms")
    column = choose(rows)
    shared = docs.sparkSession.sparkContext.broadcast(column)

    def columns(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [np.sort(shared.value[t]) for t in part["terms"]]
            yield part.assign(terms=[c[c >= 0].astype("<i4").tobytes() for c in found])

    # The order of the rows depends on the cluster; the fit must not.
    small = sorted(map(tuple, rows.mapInPandas(columns, "toxic int, terms binary").collect()))
    kept = [np.frombuffer(t, dtype="<i4") for _, t in small]
    return fit(column, kept, np.array([y for y, _ in small], dtype=float))


def toxicity(docs: DataFrame, model: Machine, text: str = "text") -> Column:
    """Score of each whole text, 0 to 1; a null text is empty. Only the text is looked at."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        machine = shared.value
        found = Terms(machine.column)
        for batch in batches:
            parts = [machine.scores([found.of(t) for t in texts]) for texts in slices(batch)]
            yield pd.Series(np.concatenate([*parts, np.zeros(0)]))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(F.col(text).cast("string"))
