"""Roots, proofs and verification against a recursive definition, over several passes and odd rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stroma.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, index int, level int, claimed string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", "d", 1, 2, "c") for r in rows], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climbed(nodes, fanout):
    """The root of the nodes and each one's siblings up to it, by the definition."""
    paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        cut = range(0, len(nodes), fanout)
        for k in cut:
            run = nodes[k : k + fanout]
            for j in range(len(run)):
                for leaf in owners[k + j]:
                    paths[leaf].append((run[:j], run[j + 1 :]))
        owners = [sum(owners[k : k + fanout], []) for k in cut]
        nodes = [h(*nodes[k : k + fanout]) for k in cut]
    return nodes[0], paths


def expected(rows, fanout, changed):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops, held = [], []
    for name in order:
        group = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroot, paths = climbed([leaf_of(r) for r in group], fanout)
        tops.append(subroot)
        held += [(r, subroot, p, len(tops) - 1) for r, p in zip(group, paths, strict=True)]
    root, above = climbed(tops, fanout)
    out = []
    for r, subroot, path, at in held:
        path, fold = path + above[at], leaf_of(changed(r))
        for left, right in path:
            fold = h(*left, fold, *right)
        out.append((r[0], leaf_of(r), subroot, root, h(*[x for left, right in path for x in (*left, *right)]), fold))
    return sorted(out, key=str)


def found(spark, rows, fanout, levels):
    docs = table(spark, rows)
    made = merkle.build(docs, claimed={"text": F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))}, fanout=fanout, levels=levels)
    cols = ("doc_id", "digest", "subroot", "root", "proof_sha256", "folded_root")
    return sorted((tuple(r) for r in merkle.prove(made, siblings=False).select(*cols).collect()), key=str)


def lowered(r):
    return (*r[:4], r[4].lower() if r[4] is not None and r[0] is not None and r[0] % 3 == 0 else r[4])


@pytest.mark.parametrize(("fanout", "levels", "n"), [(8, 1, 700), (8, 2, 700), (3, 2, 300), (2, 3, 65), (8, 5, 64), (8, 5, 1)])
def test_definition(spark, fanout, levels, n):
    rng = random.Random(n)
    rows = [(k, rng.choice([None, "s", "sé"]), rng.choice(["hot", "hot", "en", "zh", "É", "z", None]), rng.choice([None, 5]), rng.choice([None, "", "Text A", "x" * rng.randint(0, 99)])) for k in rng.sample(range(5000), n)]
    assert found(spark, rows, fanout, levels) == expected(rows, fanout, lowered)


def test_many_groups(spark):
    rows = [(k, "s", f"l{k % 90}", 1, f"Text {k}") for k in range(200)]
    assert found(spark, rows, 3, 2) == expected(rows, 3, lowered)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (3, "s", "en", 1, "A"), (3, "s", "en", 1, "B"), (None, "s", "en", 1, "A"), (None, None, "", None, "-"), (6, "s", "en", 0, ""), (9, "s", "en", 2, "Long " * 40_000)]
    assert found(spark, rows, 8, 5) == expected(rows, 8, lowered)
    assert found(spark, [], 8, 5) == []


def test_a_proof_is_enough_to_verify(spark):
    rows = [(k, "s", "en" if k % 3 else "de", 1, f"text {k}") for k in range(100)]
    for r in merkle.prove(merkle.build(table(spark, rows))).collect():
        held = r.digest
        for k in range(0, len(r.proof), 2):
            held = h(r.proof[k], held, r.proof[k + 1])
        assert held == r.root == r.folded_root and r.proof_sha256 == h(*r.proof)


def test_levels_lie_in_folders_of_their_own(spark):
    made = merkle.build(table(spark, [(k, "s", "en", 1, f"text {k}") for k in range(100)]), fanout=3, levels=2)
    assert made.bases == [0, 2, 4] and all("level=" in f for s in made.stores for f in s.inputFiles())
    assert {r.level: r["count"] for s in made.stores for r in s.groupBy("level").count().collect()} == {1: 34, 2: 12, 3: 4, 4: 2, 5: 1}
