"""The Merkle manifest against trees built one node at a time."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import merkle

COLUMNS = ("doc_id", "lang", "text")
SCHEMA = "doc_id long, lang string, text string, leaf string, tree string, idx int, n string, siblings int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return found


def siblings(tree, i):
    for level in tree[:-1]:
        yield level[i ^ 1] if i ^ 1 < len(level) else ""
        i >>= 1


def postorder(tree):
    """(level, index) in the order in which nodes are complete."""
    found = []

    def visit(level, i):
        if level:
            for child in (2 * i, 2 * i + 1):
                if child < len(tree[level - 1]):
                    visit(level - 1, child)
        found.append((level, i))

    visit(len(tree) - 1, 0)
    return found


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_positions_are_those_of_a_walk(n):
    tree = levels([str(i) for i in range(n)])
    for place, (level, i) in enumerate(postorder(tree)):
        assert merkle.positions(level, np.array([i]), n).tolist() == [place]


ROWS = [(i, lang, f"text {i} é\U0001f600" * (i % 3)) for lang, ids in (("en", range(37)), ("de", range(50, 54)), ("ß", [60])) for i in ids]
ROWS += [(None, "en", "no id"), (70, None, "no lang"), (71, None, None), (72, "", ""), (73, "", "x" * 300_000), (3, "en", "text 3 again"), (7, "en", "text 7 é\U0001f600")]


def expected(rows):
    """By leaf, sorted: subroot, root and siblings."""
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0), leaf(row)))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([h for _, h in sorted(by[name])]) for name in names]
    top = levels([t[-1][0] for t in trees])
    found = []
    for k, tree in enumerate(trees):
        for i, own in enumerate(tree[0]):
            path = [*siblings(tree, i), *siblings(top, k)]
            found.append((own, tree[-1][0], top[-1][0], path))
    return sorted(found)


@pytest.mark.parametrize("height", [1, 2, 12])
def test_proofs_of_trees_of_all_shapes(spark, height):
    docs = spark.createDataFrame([(*r, "own", "x", 5, "y", 6) for r in ROWS], SCHEMA).repartition(3)
    other = F.when(F.col("doc_id") == 5, F.lit("f" * 64)).otherwise(merkle.leaf(*map(F.col, COLUMNS)))
    made = merkle.manifest(docs, COLUMNS, "lang", "doc_id", levels=height, claimed=other)
    root = merkle.folded(F.col("claimed"), F.col("path"), F.col("siblings"))
    rows = merkle.proofs(made).withColumn("folded", root).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.siblings) for r in rows) == expected(ROWS)
    assert all((r.folded == r.root) == (r.claimed == r.leaf) for r in rows)
    assert sum(r.folded != r.root for r in rows) == 1
    log = [r for tier in made.log for r in tier.filter("NOT up").collect()]
    for tree in {r.tree for r in log}:
        own = [r for r in log if r.tree == tree]
        assert sorted(r.position for r in own) == list(range(len(own)))


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(*ROWS[0], "own", "x", 5, "y", 6)], SCHEMA)
    (row,) = merkle.proofs(merkle.manifest(docs, COLUMNS, "lang", "doc_id")).collect()
    assert (row.leaf, row.subroot, row.root, row.siblings) == (leaf(ROWS[0]),) * 3 + ([],)
    assert merkle.proofs(merkle.manifest(docs.limit(0), COLUMNS, "lang", "doc_id")).count() == 0
