"""Water-filling against its definition; the mixture's laws on odd tables."""

from __future__ import annotations

import random

import pytest

from stroma.llm.mixing import fill, mix, plan_mix

DOCS = "doc_id long, source string, text string, target int, whole string, _part int, size string"


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "w", 2, "z") for i, s, t in rows], DOCS)


def filled(sizes, weights, words, epochs):
    """Clamp, reshare the excess by weight, and again until none is above."""
    target = {}
    left = set(range(len(sizes)))
    while left:
        level = (words - sum(target.values())) / sum(weights[k] for k in left)
        over = {k for k in left if weights[k] * level > epochs * sizes[k]}
        if not over:
            return [target.get(k, weights[k] * level) for k in range(len(sizes))]
        target |= {k: epochs * sizes[k] for k in over}
        left -= over
    return [target[k] for k in range(len(sizes))]


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_the_definition(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 30)
    sizes, weights = [rng.choice([0, 1, 10, 10**rng.randint(1, 9)]) for _ in range(n)], [rng.randint(1, 5) for _ in range(n)]
    share = rng.choice([0.1, 1.5, 2.0, 5.0])
    rows = spark.createDataFrame([(k, w, s) for k, (w, s) in enumerate(zip(weights, sizes, strict=True))], "k long, weight long, source_size long")
    have = {r.k: r.target for r in fill(rows, share * sum(sizes), 2.0).collect()}
    assert [have[k] for k in range(n)] == pytest.approx(filled(sizes, weights, share * sum(sizes), 2.0))


def test_one_source_with_most_rows(spark):
    rng = random.Random(3)
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", "w " * rng.randint(0, 9)) for k in range(3000)]
    got = plan_mix(table(spark, rows)).toPandas()
    assert len(got) == len(rows)
    got["taken"] = got["whole"] * got["size"] + got["part"]
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), held=("size", "sum"))
    assert (by["size"] == by["held"]).all() and ((by["taken"] - by["target"]).abs() <= 0.5).all() and (got["taken"] <= 2 * got["size"]).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6
    again = plan_mix(table(spark, rows[::-1])).toPandas()
    again["taken"] = again["whole"] * again["size"] + again["part"]
    assert got.groupby("doc_id")["taken"].sum().to_dict() == again.groupby("doc_id")["taken"].sum().to_dict()


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, None, "one two"), (3, "", ""), (None, "b", "x y z"), (None, "b", "x y z"), (4, "b", "p\tq\x0br"), (4, "b", "p\tq\x0br"), (5, "c", "long " * 50_000)]
    got = plan_mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.size) for r in got} == {(1, 0), (2, 2), (3, 0), (None, 3), (4, 3), (5, 50_000)}
    assert all(r.source_size == {"a": 0, "": 0, "b": 12, "c": 50_000, None: 2}[r.source] for r in got)
    assert plan_mix(table(spark, [])).count() == 0 and [r.target for r in plan_mix(table(spark, [(1, "a", None)])).collect()] == [0.0]


def test_the_mixture_has_the_planned_words(spark):
    rows = [(k % 40, f"s{k % 5}", " ".join(f"w{k}_{j}" for j in range(k % 11))) for k in range(200)] + [(None, None, "a b c")]
    docs = table(spark, rows)
    plan = plan_mix(docs).collect()
    texts = mix(docs).collect()
    words = {}
    for r in texts:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert words == {s: n for s in {r.source for r in plan} if (n := sum(r.whole * r.size + r.part for r in plan if r.source == s))}
    whole = {t for _, _, t in rows}
    assert sum(r.text not in whole for r in texts) <= 6
