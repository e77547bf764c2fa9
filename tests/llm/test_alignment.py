"""The alignment of two tokenizers against the libraries' ids of whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from slotwise.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "", None, " ", "  two  blanks  ", "a word", "A word, another word; the word's end.", "\n\nlines\r\n\tand tabs \n", "a;\r\nb);\r\n {\r c", "\r\n\tand", "\r", "x\r y\t\rz",
    "x\x1cy\x85z \x0b\x0c u",
    " no break  em　wide ​zero﻿mark", "été ÀÇñ ß øl naïve", "日本語 テキスト 漢字かな交じり", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "a ▁ b", "▁start", "😀👍🏽 emoji \U0001f1e9\U0001f1ea", "été é̈ x", "ſ İ K", "\x00 \x01", "x" * 500, "!?" * 300 + " the the the",
    "don't we'll I'm it's 'tis", "123 4567 8,901.23", "tail   ", "\ttab first", "the of and " * 400, "Ωμέγα привет שלום مرحبا हिन्दी",
]


def brute(rows):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=B)
    letters = alignment._bytes_of_letters()
    raw_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in tok.get_vocab().items()}

    def raw_b(i):
        piece = sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if not text or b"".join(map(raw_a.get, a)) != data or b"".join(map(raw_b, b)) != data:
            docs.append((doc_id, [], Counter(), 0, 0, ""))
            continue
        ends = [np.cumsum([len(r(i)) for i in ids]) for r, ids in ((raw_a.get, a), (raw_b, b))]
        groups, start = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, e in zip(ids, es) if start < e <= end] for ids, es in zip((a, b), ends)])
            start = end
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(links.keys())
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        docs.append((doc_id, groups, links, len(a), len(b), hashlib.sha256(said.encode()).hexdigest()))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(
        (
            (d or -1, n_a, n_b, len(groups), sum(links.values()),
             sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()), sha)
            for d, groups, links, n_a, n_b, sha in docs
        ),
        key=repr,
    )


def found(df):
    return sorted(((r.doc_id or -1, *r[1:]) for r in df.select(*NAMES).collect()), key=repr)


SCHEMA = "doc_id long, text string, batch long, radix int, head string, group long, totals int"


@pytest.fixture(scope="module")
def rows():
    made = [(i + 1, t) for i, t in enumerate(TEXTS)]
    words = " ".join(t for t in TEXTS if t and "▁" not in t and t.isascii()).split()
    made += [(100 + i, " ".join(words[i % 7 :: 1 + i % 5])) for i in range(40)]
    return [*made, (None, "no id the word"), (5, "a word"), (5, "a word"), (5, "another text")]


@pytest.mark.parametrize(("documents", "fan"), [(alignment.DOCUMENTS, alignment.FAN), (2, 2)])
def test_equals_whole_texts(spark, monkeypatch, rows, documents, fan):
    """Also with batches of few documents, whose heads are merged in several tiers."""
    monkeypatch.setattr(alignment, "FAN", fan)
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA).repartition(17 if documents == 2 else 3)
    assert found(alignment.alignment(docs, A, B)) == brute(rows)


def test_no_rows(spark):
    assert alignment.alignment(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_merged_heads_are_sums():
    rng = np.random.default_rng(3)
    heads, want = [], Counter()
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 5000, 700))
        counts = rng.integers(1, 9, len(pairs))
        heads.append(alignment._head(pairs, counts))
        want.update(dict(zip(pairs.tolist(), counts.tolist())))
    steps = list(alignment.merged(heads, step=64))
    assert len(steps) > 9
    got = np.concatenate([p for p, _ in steps])
    assert (np.diff(got) > 0).all() and dict(zip(got.tolist(), np.concatenate([c for _, c in steps]).tolist())) == want
