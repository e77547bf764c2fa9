"""The pipeline on a small table with null ids, shared ids and copies."""

import numpy as np
import public_tokenizers

from slotwise.llm import packing, stages
from slotwise.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(seed, n=60):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 1 << 40, n))


LEAK = _text(99, 14)
TEXTS = [
    (1, _text(1)), (2, _text(1)), (None, _text(1)),  # copies: the smallest id stays
    (3, _text(3)), (3, _text(4)), (4, _text(3)), (4, _text(5)),  # shared ids: 3 twice, and the second 4
    (None, _text(6)), (None, _text(6) + " tail"),  # one of two near copies without ids
    (None, _text(7) + " " + LEAK), (5, _text(8) + " " + LEAK), (5, _text(9)),  # leaks go, a clean row of their id stays
    (6, None), (None, None), (7, ""),
]


def _linked(a, b):
    one, two = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a or "", b or ""))
    return bool(one & two) and 100 * len(one & two) >= 75 * len(one | two)


def test_pipeline_against_brute_force(spark):
    path = scratch(spark, "test-pipeline")
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    frame(TEXTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = []
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0)):
        if not any(_linked(t, other) for _, other in kept):
            kept.append((i, t))
    clean = [(i, t) for i, t in kept if LEAK not in (t or "")]
    order = lambda rows: sorted(rows, key=str)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = stages.drop_copies(spark, docs, path)
    short = lambda rows: order((i, (t or "")[: len(_text(6))]) for i, t in rows)
    assert found.columns == docs.columns
    assert short((r.doc_id, r.text) for r in found.collect()) == short(kept)
    found = stages.decontaminate(spark, frame(kept), path)
    assert order((r.doc_id, r.text) for r in found.collect()) == order(clean)
    expected = packing.pack(frame(clean), public_tokenizers.path("word_bpe_49k.json"))
    placed = lambda df: order((r.doc_id, r.piece) for r in df.collect())
    assert placed(stages.run(spark, path)) == placed(expected)
