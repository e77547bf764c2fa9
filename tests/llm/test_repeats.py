"""Repeated byte strings against a dictionary of all of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import repeats

SCHEMA = "doc_id long, text string, block long, kind int, size string, data int"


def brute(rows):
    """Documents in order: id, bytes, spans, kept."""
    seen, found = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - repeats.LENGTH + 1):
            window = data[i : i + repeats.LENGTH]
            if window in seen:
                gone[i : i + repeats.LENGTH] = b"\1" * repeats.LENGTH
            seen.add(window)
        spans, last = [], 0
        for i, x in enumerate(gone):
            if x and not last:
                spans.append([i, i])
            if x:
                spans[-1][1] = i + 1
            last = x
        found.append((doc_id, len(data), spans, bytes(b for b, x in zip(data, gone) if not x)))
    return found


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé \n") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line, page = prose(40), prose(12)[:99], prose(400)
    # An exact window, one byte less, shifts against the cover, runs of one letter, copies.
    exact = "".join(rng.choice("xyz") for _ in range(100))
    made = [page, page, page[:800] + "!" + page[801:], "", None, " ", "a" * 99, "a" * 100, "b" * 350, "ab" * 200, page + page]
    for i in range(25):
        made.append(prose(rng.randint(0, 30)) + passage[i:] + prose(rng.randint(0, 30)) + line + prose(i))
        made.append(prose(5) + "q" * i + exact[: 98 + i % 3] + "w" + prose(3))
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_strings(spark, monkeypatch, seed):
    """With blocks of few documents."""
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(*r, 9, 8, "x", 7) for r in rows], SCHEMA).repartition(5 if seed == 1 else 40)
    found = repeats.remove_repeats(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.spans, bytes(r.kept)) for r in found] == brute(sorted(rows))


def test_null_and_shared_ids_and_equal_rows(spark):
    page = texts(3)[0]
    rows = [(None, page), (1, page), (1, page), (2, "x" + page), (2, None), (None, None)]
    docs = spark.createDataFrame([(*r, 9, 8, "x", 7) for r in rows], SCHEMA)
    found = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in repeats.remove_repeats(docs).collect())
    size = len(page.encode())
    assert found == sorted([(0, size, size), (1, size, 0), (1, size, 0), (2, size + 1, 1), (2, 0, 0), (0, 0, 0)])
    assert repeats.remove_repeats(docs.filter(F.lit(False))).collect() == []


def by_id_and_start(rows):
    """(id, spans) where a string is earlier in a smaller id, or at a smaller start of the same one."""
    first = {}
    windows = lambda data: range(len(data) - repeats.LENGTH + 1)
    for doc_id, text in rows:
        data = text.encode()
        for i in windows(data):
            key = data[i : i + repeats.LENGTH]
            first[key] = min(first.get(key, (doc_id, i)), (doc_id, i))
    found = []
    for doc_id, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in windows(data):
            if first[data[i : i + repeats.LENGTH]] < (doc_id, i):
                gone[i : i + repeats.LENGTH] = b"\1" * repeats.LENGTH
        edges = [i for i in range(len(gone) + 1) if (i and gone[i - 1]) != (i < len(gone) and gone[i])]
        found.append((doc_id, [list(x) for x in zip(edges[::2], edges[1::2], strict=True)]))
    return sorted(found)


@pytest.mark.parametrize("block", [4_000_000, 3_000])
def test_rows_of_one_id_are_one_document(spark, monkeypatch, block):
    """Also where the rows of an id are in several blocks."""
    made = [t or "" for t in texts(4)]
    rows = [(i // 3, t) for i, t in enumerate(made)] + [(9, made[0] + "z")] * 2 + list(enumerate(made[5:15]))
    monkeypatch.setattr(repeats, "BLOCK", block)
    pass_of = repeats._blocks

    def small(parts):  # the workers import the module anew
        repeats.BLOCK = block
        yield from pass_of(parts)

    monkeypatch.setattr(repeats, "_blocks", small)
    docs = spark.createDataFrame([(*r, 9, 8, "x", 7) for r in rows], SCHEMA).repartition(4)
    found = repeats.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.spans) for r in found) == by_id_and_start(rows)


def test_names_do_not_depend_on_the_block():
    """Equal strings in blocks of other sizes and at other places."""
    text = bytes(i * i % 251 for i in range(300))
    data = [np.frombuffer(x, dtype=np.uint8) for x in (text, b"before" + text, text + b"behind" * 50)]
    for naming in range(repeats.NAMINGS):
        one, two, three = (repeats.Names(x, naming).of(np.array([k]), repeats.LENGTH, 64) for x, k in zip(data, (5, 11, 5), strict=True))
        assert one == two == three


def test_the_cover_has_all_distances():
    v = repeats.PERIOD
    assert {(x - y) % v for x in repeats.COVER for y in repeats.COVER} == set(range(v))
    assert max(repeats.COVER) < v < repeats.LENGTH


def test_blocks_without_ties(spark):
    """Also where no sample string repeats, so a pass has no names at all."""
    rows = [(i, "".join(chr(97 + (i * 31 + k * k * (i + 3)) % 26) for k in range(150))) for i in range(3)]
    docs = spark.createDataFrame([(*r, 9, 8, "x", 7) for r in rows], SCHEMA).repartition(3)
    found = repeats.remove_repeats(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.spans, bytes(r.kept)) for r in found] == brute(rows)
