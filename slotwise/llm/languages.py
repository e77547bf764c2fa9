"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, slices

DIMENSIONS = 512
PER_LANGUAGE = 3_000  # documents that a prototype is learned from, about and at most twice
KEPT = 30_000  # n-gram vectors that a worker keeps; then it starts anew
CHUNK = 4096  # n-grams of a text that are looked up at once
SPACE = 32


def letter_vector(code: int) -> np.ndarray:
    """The random +1/-1 vector of a letter, the same everywhere."""
    return np.random.default_rng([code, 20]).choice(np.array([-1, 1], dtype=np.int8), DIMENSIONS)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; each run of anything else is one blank, also
    before and behind the text. Empty where there is no letter."""
    text = text.lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = codes < 128
    is_letter = (codes >= 97) & (codes <= 122)
    if not low.all():
        other = np.unique(codes[~low])
        alpha = other[[chr(c).isalpha() for c in other.tolist()]]
        is_letter |= np.isin(codes, alpha)
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint32)
    plain = np.concatenate([[SPACE], np.where(is_letter, codes, SPACE), [SPACE]])
    keep = np.ones(len(plain), dtype=bool)
    keep[1:] = (plain[1:] != SPACE) | (plain[:-1] != SPACE)
    return plain[keep].astype(np.uint32)


class Encoder:
    """Document vectors: the sum over all trigrams of their bound letter vectors.

    The letters of a trigram are bound by multiplying their vectors, of which the first is
    rotated by two places and the second by one, so order counts.
    """

    def __init__(self):
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.table = np.zeros((1024, DIMENSIONS), dtype=np.float32)

    def _vector(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) > 20_000:
                self.letter.clear()
            self.letter[code] = letter_vector(code)
        return self.letter[code]

    def _rows(self, grams: list[int]) -> np.ndarray:
        if len(self.row) + len(grams) > KEPT:
            self.row.clear()
        rows = np.empty(len(grams), dtype=np.int64)
        for k, gram in enumerate(grams):
            row = self.row.get(gram)
            if row is None:
                row = self.row[gram] = len(self.row)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
                bound = np.roll(self._vector(a), 2) * np.roll(self._vector(b), 1) * self._vector(c)
                self.table[row] = bound
            rows[k] = row
        return rows

    def encode(self, text: str) -> np.ndarray | None:
        """The unit vector of a text, or None for a text without a letter."""
        codes = letters(text).astype(np.int64)
        if not len(codes):
            return None
        grams, counts = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
        total = np.zeros(DIMENSIONS, dtype=np.float32)
        for at in range(0, len(grams), CHUNK):
            rows = self._rows(grams[at : at + CHUNK].tolist())
            total += counts[at : at + CHUNK].astype(np.float32) @ self.table[rows]
        norm = float(np.linalg.norm(total))
        return total / norm if norm else total


@dataclass
class Profiles:
    names: list[str]
    vectors: np.ndarray  # unit rows

    def nearest(self, vectors: list[np.ndarray | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(vectors), np.zeros(len(vectors))
        own = [k for k, v in enumerate(vectors) if v is not None]
        if own and self.names:
            cosines = np.stack([vectors[k] for k in own]) @ self.vectors.T
            best = cosines.argmax(axis=1)
            for k, b, c in zip(own, best.tolist(), cosines.max(axis=1).tolist(), strict=True):
                names[k], scores[k] = self.names[b], min(1.0, max(0.0, c))
        return names, scores


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Profiles:
    """Prototype of each language: the sum of the unit vectors of its learning documents.

    Rows with a null id, text or lang and rows of the held-out fold are left out. Of a
    language with more than `per_language` documents, a share of its ids' hashes is taken
    that gives about so many. Sums are made in the tasks; one vector per language and task
    comes together. Without learning documents there is no language.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.filter((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles([], np.zeros((0, DIMENSIONS)))
    shares = F.create_map(*(F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, per_language / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    rows = rows.filter(draw < F.element_at(shares, F.col("lang"))).select("lang", "text")

    def bundle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(), {}
        for part in parts:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                vector = encoder.encode(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    found = rows.mapInPandas(bundle, "lang string, vector array<double>")
    parts = found.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    table = parts.toPandas().pivot(index="lang", columns="k", values="x").sort_index()
    vectors = table.to_numpy(dtype=float).reshape(len(table), -1)
    return Profiles(list(table.index), vectors / np.linalg.norm(vectors, axis=1, keepdims=True))


def language(docs: DataFrame, profiles: Profiles, text: str = "text") -> Column:
    """Struct (lang_pred, score) of each whole text; `und` for null or no letter.

    The score is the cosine with the nearest prototype, not below 0; of equal ones the first
    name wins. Only the text is looked at.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, known = Encoder(), shared.value
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = [np.zeros(0)]
            for texts in slices(batch):
                own, near = known.nearest([encoder.encode(t) for t in texts])
                names += own
                scores.append(near)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, "lang_pred string, score double")(F.col(text).cast("string"))
