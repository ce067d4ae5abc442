"""Operators whose results plain SQL doesn't show: brute force on small tables, laws they obey, plans they have."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stroma.functions.names import resolve_aliases
from stroma.operators import eventstudy as es
from stroma.operators import bootstrap, cooccurrence, design, evaluate, features, ordered, simulate, survival, var
from stroma.operators import components
from stroma.operators.components import connected_components
from stroma.plans.registry import QUERIES
from stroma.sources.tables import discard, materialise, shared_folder

SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 8)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("few", [0, 1000])
def test_running_sums_in_parts(spark, monkeypatch, reverse, before, few):
    monkeypatch.setattr(ordered, "FEW_ROWS", few)
    rng = np.random.default_rng(0)
    rows = [(str(g), float(t), float(v)) for g, t, v in zip(rng.integers(0, 3, 500), rng.integers(0, 90, 500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "g string, t double, v double")
    got = ordered.running_sums(df, ["g"], "t", {"s": "v"}, reverse, before, parts=7).collect()
    assert len(got) == 500
    for r in got:
        cmp = (lambda x: x > r.t) if reverse and before else (lambda x: x >= r.t) if reverse else (lambda x: x < r.t) if before else (lambda x: x <= r.t)
        assert r.s == sum(v for g, t, v in rows if g == r.g and cmp(t))


def test_weights_are_poisson_and_alike_in_sql():
    duckdb = pytest.importorskip("duckdb")
    w = np.concatenate([bootstrap.weights(3, 400, f"c{k}") for k in range(50)])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06
    sql = duckdb.sql(f"SELECT {bootstrap.weight_sql(3, 'd', 'c')} FROM (SELECT unnest(range(400)) AS d), (SELECT 'c7' AS c) ORDER BY d").fetchall()
    assert [x for (x,) in sql] == bootstrap.weights(3, 400, "c7").tolist()


def brute_cox(t, e, x, entry, b):
    """Log-likelihood and score with Efron's ties, one event at a time."""
    w = np.exp(x @ b)
    ll, score = 0.0, np.zeros(x.shape[1])
    for time in sorted(set(t[e])):
        risk = (t >= time) & (entry < time)
        hit = (t == time) & e
        d = hit.sum()
        ll += (x[hit] @ b).sum()
        score += x[hit].sum(0)
        for k in range(d):
            z0 = w[risk].sum() - k / d * w[hit].sum()
            z1 = (w[risk] @ x[risk] - k / d * (w[hit] @ x[hit])) / z0
            ll -= math.log(z0)
            score -= z1
    return ll, score


def test_cox_with_entry_strata_and_clusters(spark):
    rng = np.random.default_rng(4)
    n = 120
    x = rng.standard_normal((n, 2))
    t = np.ceil(rng.exponential(5, n) + 2)
    e, entry, half, c = rng.random(n) < 0.7, np.floor(rng.random(n) * 3) - 0.5, rng.integers(0, 2, n), rng.integers(0, 15, n)
    df = spark.createDataFrame([(float(a), bool(k), float(y), float(z), float(i), int(h), int(g)) for a, k, (y, z), i, h, g in zip(t, e, x, entry, half, c)], "t double, e boolean, y double, z double, i double, h int, g int")
    b = np.array([0.3, -0.2])
    rows = survival.cox_rows(df, ["y", "z"], "t", "e", ["h"], "i", "g")
    ll, score, hess = survival.cox_sums(rows, ["y", "z"], b, ["h"])
    want = [brute_cox(t[half == h], e[half == h], x[half == h], entry[half == h], b) for h in (0, 1)]
    assert ll == pytest.approx(sum(a for a, _ in want)) and score == pytest.approx(sum(s for _, s in want))
    step = 1e-5
    for k in range(2):
        up = sum(brute_cox(t[half == h], e[half == h], x[half == h], entry[half == h], b + step * np.eye(2)[k])[1] for h in (0, 1))
        assert hess[k] == pytest.approx(-(up - score) / step, rel=1e-3, abs=1e-3)
    shares = survival.score_residuals(rows, ["y", "z"], b, ["h"])
    total = shares.agg(F.sum("u_0").alias("a"), F.sum("u_1").alias("b")).first()
    assert [total.a, total.b] == pytest.approx(score, abs=1e-8) and shares.count() == n
    m = survival.cox(df, ["y", "z"], "t", "e", ["h"], "i", "g")
    assert (m["robust_se"] > 0).all() and (m["se"] > 0).all()


def test_logrank_of_two_groups_is_the_plain_one(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k % 2), int(t), bool(e)) for k, t, e in zip(range(200), rng.integers(1, 30, 200), rng.random(200) < 0.8)]
    df = spark.createDataFrame(rows, "g int, t int, e boolean")
    r = next(r for r in survival.logrank(df, "g", "t", "e").collect() if r.g == 0)
    stat, free, p = survival.logrank_test(df, "g", "t", "e")
    assert free == 1 and stat == pytest.approx((r.observed - r.expected) ** 2 / r.variance) and 0 <= p <= 1
    assert survival.pairwise_logrank(df, "g", "t", "e").first().chi2 == pytest.approx(stat)


def stops(spark, rows):
    return spark.createDataFrame(rows, "day date, vehicle long, line long, way long, pos long, place string, sched timestamp_ntz, delay double, cancelled boolean")


def some_stops(n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for v in range(n):
        at, late = T0 + dt.timedelta(minutes=int(rng.integers(0, 200))), 0.0
        for k in range(4):
            late += float(rng.integers(0, 4))  # a vehicle never arrives before it was at the stop before
            rows.append((T0.date(), v, v % 3, v % 2, k, f"p{k}", at, late, bool(rng.random() < 0.1)))
            at += dt.timedelta(minutes=int(rng.integers(2, 9)))
    return rows


def test_features_see_nothing_that_comes_later(spark):
    """Changing whatever arrives at a step's time or later changes none of its features. (A cancelled stop is known at its planned time.)"""
    rows = some_stops()
    before = {(r.vehicle, r.pos): r for r in features.transition_features(stops(spark, rows)).collect()}
    cut = T0 + dt.timedelta(minutes=100)
    real = lambda r: r[6] + dt.timedelta(minutes=r[7])
    changed = [r if real(r) < cut or r[8] else (*r[:7], r[7] + 5, r[8]) for r in rows]
    after = {(r.vehicle, r.pos): r for r in features.transition_features(stops(spark, changed)).collect()}
    seen = 0
    for key, r in before.items():
        if r["T"] < cut and key in after and after[key]["T"] == r["T"]:
            seen += 1
            assert [r[c] for c in features.FEATURES] == [after[key][c] for c in features.FEATURES], key
    assert seen > 40


def test_recent_sums_match_brute_force(spark):
    rng = np.random.default_rng(2)
    us = [T0 + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 7200, 300)]
    stream = spark.createDataFrame([("a", t, 1.0, float(k)) for k, t in enumerate(us)], "k string, t timestamp_ntz, one double, v double")
    got = features.recent_sums(stream.select("k", "t", "v"), stream.withColumnRenamed("v", "w"), ["k"], "t", 15, {"n": "one", "s": "w"}).collect()
    for r in got:
        near = [k for k, t in enumerate(us) if r.t - dt.timedelta(minutes=15) <= t < r.t]
        assert (r.n, r.s) == (len(near), sum(near))


def test_boosting_learns_what_is_there(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, 2))
    df = spark.createDataFrame([(float(a), None if k % 9 == 0 else float(b), bool(a > 0.6), int(a * 3)) for k, (a, b) in enumerate(x)], "a double, b double, y boolean, c int")
    p = features.boosted(df, ["a", "b"], "y", trees=3, depth=2).transform(features.numeric(df, ["a", "b"]))
    assert p.where((F.col("prediction") == 1) != F.col("y")).count() < 30
    q = features.boosted_classes(df, ["a", "b"], "c", trees=2, depth=2).transform(features.numeric(df, ["a", "b"]))
    assert q.where(F.col("predicted") != F.col("c")).count() < 60


def test_simulation_does_not_depend_on_its_groups(spark, monkeypatch):
    s = stops(spark, some_stops(20))
    law = simulate.learn(simulate.transitions(s))
    rows = lambda: sorted(map(str, simulate.simulate(s, law, 5, 7).collect()))
    together = rows()
    monkeypatch.setattr(simulate, "RUNS", 2)
    assert rows() == together and len(together) == 5 * 80


def test_effects_decay(spark):
    df = spark.createDataFrame([("a", 0, 3.0, 0.1), ("a", 1, 1.0, 0.1), ("a", 2, 0.05, 0.01), ("a", 3, 0.0, None), ("b", 0, 0.0, None), ("c", 0, 0.0, 0.1), ("c", 1, 9.0, 0.1)], "k string, block int, m double, se double")
    assert {r.k: r.minutes for r in simulate.decay_minutes(df, ["k"], "block", "m", "se", 10).collect()} == {"a": 20, "b": 0, "c": None}


def test_orders_from_one_pass_equal_fits_of_their_own(spark):
    rng = np.random.default_rng(6)
    rows = [(f"e{k // 40}", k % 40 + 1, float(a), float(b)) for k, (a, b) in enumerate(rng.standard_normal((200, 2)))]
    df = spark.createDataFrame(rows, "episode string, step int, x double, y double")
    for m, k in var.order_grid(df, ["x", "y"], 3):
        own = var.fit_var(df, ["x", "y"], m.order)
        assert k == 1 + 2 * m.order and m.rows == own.rows and np.allclose(m.coefficients, own.coefficients) and np.allclose(m.sigma, own.sigma)


def test_unit_root_with_lags(spark):
    rng = np.random.default_rng(7)
    y = np.cumsum(rng.standard_normal(80))
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(y)] + [("b", 0, 1.0)], "k string, t int, y double")
    got = var.unit_root(df, ["k"], "t", "y", 2, 10).collect()
    d = np.diff(y)
    x = np.column_stack([y[2:-1], np.ones(77), d[1:-1], d[:-2]])
    b, rest, *_ = np.linalg.lstsq(x, d[2:], rcond=None)
    se = math.sqrt(rest[0] / (77 - 4) * np.linalg.inv(x.T @ x)[0, 0])
    assert len(got) == 1 and got[0].n == 77 and got[0].statistic == pytest.approx(b[0] / se) and got[0].rejected_at_5 == (b[0] / se < -2.86)


def test_variance_shares_of_both_kinds():
    r = np.array([[[1.0, 0.0], [0.0, 1.0]], [[0.0, 2.0], [0.0, 0.0]]])
    assert var.variance_shares(r, 1).tolist() == [[1, 0], [0, 1]] and var.variance_shares(r, 1, inclusive=True).tolist() == [[0.2, 0.8], [0, 1]]


def test_names_fit_exactly_one(spark):
    df = spark.createDataFrame([("Main Street",), ("Main Street",), ("West End",), ("Westend",)], "name string")
    assert [r.name for r in resolve_aliases(df, "name", {"m": [" MAIN street", "main"]}).collect()] == ["Main Street"]
    for aliases in ({"w": ["west end", "westend"]}, {"n": ["nowhere"]}):
        with pytest.raises(Exception, match="exactly one"):
            resolve_aliases(df, "name", aliases).collect()


def test_unlisted_levels_raise(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [(r.x_b) for r in design.indicators(df, "x", "a", ["b"], "x").collect()] == [0.0, 1.0, None]
    with pytest.raises(Exception, match="unlisted"):
        design.indicators(df, "x", "a", ["c"], "x").collect()


def test_isolation_looks_at_all_places(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    episodes = spark.createDataFrame([(1, "a", ["p", "q"], at(0), at(200)), (2, "a", ["p"], at(1000), at(1000)), (3, "b", ["r"], at(0), at(1))], "id int, code string, places array<string>, t0 timestamp_ntz, t1 timestamp_ntz")
    events = spark.createDataFrame([("b", "q", at(259)), ("b", "p", at(1061)), ("b", "r", at(0)), ("a", "p", at(0))], "code string, place string, ts timestamp_ntz")
    assert sorted(r.id for r in cooccurrence.isolated_anywhere(episodes, "id", "code", "places", "t0", "t1", events, "place", "ts", 60).collect()) == [2, 3]


def test_criteria_judge(spark):
    sim = spark.createDataFrame([("p", float(k % 10), False) for k in range(100)], "place string, v double, gone boolean")
    c = {r.criterion: r.met for r in evaluate.criteria(sim, sim, ["place"], "v", "gone", 4.0).collect()}
    assert c == dict.fromkeys("abcde", True)
    off = sim.withColumn("v", F.col("v") * 3 + 5)
    assert not any(r.met for r in evaluate.criteria(sim, off, ["place"], "v", "gone", 4.0).collect() if r.criterion in "abe")


def test_tables_are_discarded(spark):
    made = materialise(spark.range(5), "test-discard")
    path = spark._jvm.org.apache.hadoop.fs.Path(made._stroma_path)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert system.exists(path)
    discard(made)
    discard(None)
    assert not system.exists(path) and shared_folder(spark).startswith("file:")


@pytest.mark.parametrize("few", [0, 100_000])
def test_long_paths_are_contracted(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "test-path").collect()}
    assert set(got.values()) == {0, 500} and got[200] == 0 and len(got) == 203


@pytest.mark.parametrize("name", ["binary_scores", "logrank_counts", "rank_sum_ranking", "logrank_covariance"])
def test_running_sums_are_dealt_in_parts(spark, monkeypatch, name):
    """What is summed along more than a few times or forecasts is exchanged by parts; only a row a part comes together."""
    monkeypatch.setattr(ordered, "FEW_ROWS", 0)
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan or "_part#" in plan.split("hashpartitioning(")[-1] or any("_part#" in x for x in plan.split("hashpartitioning(")[1:])


def test_sessions_by_days_are_the_sessions(spark):
    rng = np.random.default_rng(9)
    rows = [("ab"[k % 2] if k % 17 else None, k, None if k % 31 == 0 else T0 + dt.timedelta(minutes=int(m))) for k, m in enumerate(rng.integers(0, 9000, 400))]
    rows += [("a", 1000 + k, dt.datetime(2024, 2, 1, 23, 50) + dt.timedelta(minutes=10 * k)) for k in range(4)] + [("b", 2000, dt.datetime(2024, 3, 9))]
    df = spark.createDataFrame(rows, "g string, i long, t timestamp_ntz")
    one, two = (f(df, ["g"], "t", "i", 15, "s") for f in (ordered.sessionize, ordered.sessionize_by_days))
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert ordered.sessionize_by_days(df.limit(0), ["g"], "t", "i", 15).count() == 0


@pytest.mark.parametrize("name", ["episode_summary", "isolated_episodes"])
def test_no_window_over_raw_rows_by_type_alone(spark, name):
    """Windows over events are dealt by type and day; by the type alone only a row a day is ordered."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "windowspecdefinition(event_type" in x]
    assert windows and all("_day#" in x for x in windows)



def test_durations_match_a_walk_over_the_hits(spark):
    rng = np.random.default_rng(4)
    hits = [(p, T0 + dt.timedelta(minutes=int(m) / 2)) for p, m in zip(rng.integers(0, 3, 300), rng.integers(0, 6000, 300))] + [(0, None)]
    hits = [(int(p), t) for p, t in hits]
    asked = [(k, k % 4, T0 + dt.timedelta(minutes=int(m) / 2)) for k, m in enumerate(rng.integers(-50, 6100, 200))] + [(1000 + k, p, t) for k, (p, t) in enumerate(hits)]
    events = spark.createDataFrame(asked, "event_id long, place long, t0 timestamp_ntz")
    got = es.event_duration(events, spark.createDataFrame(hits, "place long, ts timestamp_ntz"), "place", "ts", 45, 6)
    want = {}
    for i, p, t0 in asked:
        at = last = t0
        for t in sorted(t for q, t in hits if q == p and t and t0 and t0 <= t <= t0 + dt.timedelta(hours=6)):
            if t - at > dt.timedelta(minutes=45):
                break
            at = last = t
        want[i] = (last - t0).total_seconds() / 60 if t0 else 0.0
    assert {r.event_id: r.minutes for r in got.collect()} == pytest.approx(want)


def test_durations_make_no_pairs(spark):
    plan = QUERIES["event_durations"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_isolation_lists_no_places(spark):
    """Neither an array of an episode's places nor a row an hour, place and episode."""
    plan = QUERIES["isolated_episodes"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Generate" not in plan


def test_isolation_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    at = lambda m: T0 + dt.timedelta(minutes=int(m))
    events = [(("a", "b", "c", None)[k % 4 if k % 9 else 3], "pqr"[int(p)], at(m)) for k, (p, m) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 900, 60) * 20))]
    episodes = [(k, "abc"[k % 3], sorted({"pqr"[int(x)] for x in rng.integers(0, 3, 2)}), at(m), at(m + 30)) for k, m in enumerate(rng.integers(0, 18_000, 80))]
    hour = dt.timedelta(minutes=60)
    want = [i for i, code, places, t0, t1 in episodes if not any(c and c != code and p in places and t0 - hour <= t <= t1 + hour for c, p, t in events)]
    have = cooccurrence.isolated_anywhere(spark.createDataFrame(episodes, "id int, code string, places array<string>, t0 timestamp_ntz, t1 timestamp_ntz"), "id", "code", "places", "t0", "t1", spark.createDataFrame(events, "code string, place string, ts timestamp_ntz"), "place", "ts", 60)
    assert 0 < len(want) < 80 and sorted(r.id for r in have.collect()) == want


def test_rank_sum_reads_its_sums_once(spark):
    """Ranks are joined by value: sums that are made anew may differ in their last bits and lose a row."""
    plan = QUERIES["rank_sum_ranking"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan
