"""Operators on small hand-computed tables."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stroma.functions import calendar as cal
from stroma.functions import numbers
from stroma.operators import aggregates, evaluate, eventstudy, grid, linear, ordered, ranges, simulate, survival, var
from stroma.operators.components import connected_components

T0 = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def times(spark, rows, schema="k string, id long, ts timestamp_ntz, v double"):
    return spark.createDataFrame(rows, schema)


def test_gap_exactly_at_the_limit_stays(spark):
    df = times(spark, [("a", 1, at(0), 0.0), ("a", 2, at(15), 0.0), ("a", 3, at(30.02), 0.0), ("b", 4, at(1), 0.0)])
    got = {r.id: r.session for r in ordered.sessionize(df, ["k"], "ts", "id", 15).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1}


def test_latest_per_key_puts_nulls_last(spark):
    df = times(spark, [("a", 1, None, 1.0), ("a", 2, at(1), 2.0), ("a", 3, at(5), 3.0), ("a", 4, at(5), 4.0), ("b", 5, None, 5.0)])
    assert {r.k: r.id for r in ordered.latest_per_key(df, ["k"], "ts", "id").collect()} == {"a": 4, "b": 5}
    assert ordered.latest_per_key(df.limit(0), ["k"], "ts", "id").count() == 0


def test_grid_keeps_three_kinds_of_nothing(spark):
    df = times(spark, [("a", 1, at(0), 10.0), ("a", 2, at(3), float("nan")), ("b", 3, at(0), -1.0), ("a", 4, at(31), 20.0)])
    got = {(r.window, r.k): r for r in grid.state_grid(df, "k", "ts", "v", 15, 5.0, F.col("v") < 0).collect()}
    assert len(got) == 6
    assert (got[at(0), "a"].n, got[at(0), "a"].mean) == (2, 10.0)
    assert (got[at(0), "b"].n, got[at(0), "b"].mean, got[at(0), "b"].n_cancelled) == (0, None, 1)
    assert got[at(15), "a"].n is None and got[at(30), "b"].n_cancelled is None
    total = sum(r.n or 0 for r in got.values()) + sum(r.n_cancelled or 0 for r in got.values())
    assert total == 4


def test_gap_variation_needs_two_gaps(spark):
    df = times(spark, [("a", k, at(m), 0.0) for k, m in enumerate([0, 10, 14])] + [("b", 9, at(0), 0.0), ("b", 10, at(5), 0.0)])
    got = {r.k: r for r in grid.gap_variation(df, ["k"], "ts", "id", 60).collect()}
    assert got["b"].cv is None and got["a"].cv == pytest.approx(np.std([10, 4], ddof=1) / 7)


@pytest.mark.parametrize(("day", "windows"), [("2025-03-30", 276), ("2025-10-26", 300), ("2025-06-01", 288)])
def test_days_of_other_lengths(spark, day, windows):
    got = grid.local_axis(spark, day, day, "Europe/Berlin", 5)
    assert got.count() == windows and got.select("window").distinct().count() == windows


def test_local_times_that_never_or_twice_are(spark):
    rows = [("2025-03-30 02:30:00",), ("2025-10-26 02:30:00",), ("2025-06-01 12:00:00",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(cal.to_utc(F.col("s").cast("timestamp_ntz"), "Europe/Berlin")).collect()]
    assert got == [None, None, dt.datetime(2025, 6, 1, 10)]


def test_right_closed_windows(spark):
    df = times(spark, [("a", 1, at(5), 1.0), ("a", 2, at(5.5), 1.0), ("a", 3, at(10), 1.0)])
    assert {r.window: r.n for r in grid.right_closed(df, ["k"], "ts", "v", 5).collect()} == {at(5): 1, at(10): 2}


def test_close_events_drop_each_other_unevenly(spark):
    df = times(spark, [("a", 1, at(0), 0.0), ("a", 2, at(100), 0.0), ("a", 3, at(200), 0.0)])
    minute = 60 * cal.MICROS
    assert [r.id for r in ranges.drop_close(df, ["k"], "ts", F.lit(60 * minute), F.lit(240 * minute)).collect()] == [3]


def test_bins_at_their_edges(spark):
    df = spark.createDataFrame([(0.0,), (30.0,), (90.0,), (91.0,), (None,)], "x double")
    inf = float("inf")
    assert [r[0] for r in df.select(numbers.cut(F.col("x"), [0, 30, 90, inf], ["short", "medium", "long"])).collect()] == [None, "short", "medium", "long", None]
    assert [r[0] for r in df.select(numbers.cut(F.col("x"), [0, 30, 90], ["short", "medium"], right=False)).collect()] == ["short", "medium", None, None, None]


def test_active_windows_and_their_tail(spark):
    df = spark.createDataFrame([("a", at(11), at(18))], "k string, s timestamp_ntz, e timestamp_ntz")
    assert sorted(r.window for r in ranges.active_windows(df, ["k"], "s", "e", 5).collect()) == [at(10), at(15), at(20)]
    assert sorted(r.window for r in ranges.active_windows(df, ["k"], "s", "e", 5, tail=1).collect())[-1] == at(25)


def test_touching_intervals_merge_and_overlap_is_strict(spark):
    blocks = spark.createDataFrame([("a", at(0), at(60)), ("a", at(60), at(120)), ("a", at(200), at(210))], "k string, s timestamp_ntz, e timestamp_ntz")
    merged = ranges.merge_intervals(blocks, ["k"], "s", "e")
    assert sorted((r.s, r.e, r.n) for r in merged.collect()) == [(at(0), at(120), 2), (at(200), at(210), 1)]
    probes = spark.createDataFrame([(1, "a", at(120), at(200)), (2, "a", at(119), at(121)), (3, "a", at(205), at(206)), (4, "b", at(0), at(1)), (5, "a", at(90), at(300))], "i int, k string, s timestamp_ntz, e timestamp_ntz")
    assert {r.i: r.overlaps for r in ranges.overlaps(probes, merged, ["k"], "s", "e").collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}


def test_components_close_transitively(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 3), (20, 21), (7, 7), (None, 1)] + [(100 + k, 101 + k) for k in range(40)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "test").collect()}
    assert (got[3], got[5], got[9], got[21]) == (3, 3, 3, 20) and 7 not in got and {got[100 + k] for k in range(41)} == {100}
    assert connected_components(edges.limit(0), "none").count() == 0


def test_longest_segment_and_first_of_ties(spark):
    df = spark.createDataFrame([("a", r) for r in (0, 1, 2, 5, 6)] + [("b", r) for r in (1, 2, 8, 9)], "k string, r long")
    got = ordered.longest_run(df, ["k"], "r").collect()
    assert sorted((x.k, x.r) for x in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_cancelled_after_running_stays_cancelled(spark):
    df = times(spark, [("a", 1, at(0), 1.0), ("a", 2, at(1), 0.0), ("a", 3, at(2), 1.0), ("b", 4, at(0), 0.0), ("b", 5, at(1), 1.0)])
    assert {r.id: r.gone for r in ordered.absorbing(df, ["k"], ["ts"], F.col("v") == 0, "gone").collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_triple_does_not_span_days(spark):
    df = spark.createDataFrame([("a", k, d) for k, d in enumerate([1, 1, 2, 2, 2])], "k string, i int, d int")
    assert [r.ok for r in ordered.triple(df, ["k"], ["i"], F.lit(True), F.col("d"), "ok").orderBy("i").collect()] == [False, False, True, False, False]


def test_asof_is_strict_and_breaks_ties(spark):
    probes = times(spark, [("a", 1, at(5), 0.0), ("a", 2, at(0), 0.0), ("c", 3, at(9), 0.0), ("a", 4, None, 0.0)])
    stream = times(spark, [("a", 11, at(5), 1.0), ("a", 12, at(4), 2.0), ("a", 13, at(4), 3.0), ("b", 14, at(1), 4.0)])
    strict = {r.id: r.asof_v for r in ranges.asof(probes, stream, ["k"], "ts", ["v"], "id").collect()}
    assert strict == {1: 3.0, 2: None, 3: None, 4: None}
    assert {r.id: r.asof_v for r in ranges.asof(probes, stream, ["k"], "ts", ["v"], "id", strict=False).collect()}[1] == 1.0


def test_interpolation_limits(spark):
    rows = [("a", k, at(k), v) for k, v in enumerate([None, 0.0, None, None, None, 8.0, None])]
    df = times(spark, rows)
    get = lambda **x: [r.f for r in ordered.interpolate(df, ["k"], ["ts"], "v", 2, "f", **x).orderBy("id").collect()]
    assert get() == [None, 0.0, 2.0, 4.0, None, 8.0, None]
    assert get(strict_gap=True) == [None, 0.0, None, None, None, 8.0, None]


def test_range_count_and_pairs(spark):
    df = times(spark, [("a", k, at(m), 1.0) for k, m in enumerate([0, 10, 15, 40])])
    minute = 60 * cal.MICROS
    assert {r.id: r.n for r in ranges.range_count(df, df, ["k"], "ts", -15 * minute, -1, "n").collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    pairs = ranges.range_pairs(df.select("k", "id", "ts"), df.select("k", F.col("id").alias("id2"), F.col("ts").alias("ts2")), ["k"], -15 * minute, -1, "ts", "ts2").collect()
    assert sorted((r.id, r.id2) for r in pairs) == [(1, 0), (2, 0), (2, 1)]


@pytest.mark.parametrize("groups, most", [(1, 1 << 20), (3, 1 << 20), (3, 1)])
def test_close_pairs_are_summed_without_shuffling_them(spark, groups, most):
    """One of them has most rows; times and types repeat; the bound on pairs held at a time changes nothing."""
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    rows = [("ab"[k], 0 if w % 3 else int(w), start + dt.timedelta(seconds=int(s))) for k, w, s in zip(rng.integers(0, 2, 300), rng.integers(-7, 7, 300), rng.integers(0, 900, 300))]
    rows += [(None, 1, start), ("a", None, start), ("a", 1, None), ("b", 2, start - dt.timedelta(days=9))]
    want: dict[tuple, list] = {}
    for k, a, s in rows:
        for j, b, t in rows:
            if None not in (k, a, b, s, t) and k == j and a < b and abs((t - s).total_seconds()) <= 60:
                want.setdefault((a, b), []).append((t - s).total_seconds())
    df = spark.createDataFrame(rows, "kind string, who long, ts timestamp_ntz")
    pairs = ranges.close_pairs(df, "kind", "who", "ts", 60_000_000, groups)
    assert {(r.a, r.b): (r.n, r.mean) for r in pairs.collect()} == {p: (len(v), pytest.approx(sum(v) / len(v))) for p, v in want.items()}
    assert ranges.close_pairs(df.limit(0), "kind", "who", "ts", 60_000_000, groups).count() == 0
    k, who, us = (np.array(x) for x in zip(*[("ab".index(k), w, int((t - start).total_seconds()) * 1_000_000) for k, w, t in rows if None not in (k, w, t)]))
    batches = list(ranges._pairs_of_block(k, who, us, np.ones(len(k), bool), True, 60_000_000, most))
    got = [(r["a"], r["b"], r["n"]) for b in batches for r in b.to_pylist()]
    assert len(got) == len(set(got)) and {(a, b): n for a, b, n in got} == {p: len(v) for p, v in want.items()}


def test_aligned_pairs_shuffle_rows_only(spark):
    plan = __spark_entry__.queries()["aligned_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_kaplan_meier_and_quantile(spark):
    df = spark.createDataFrame([("g", t, e) for t, e in [(1, True), (2, True), (2, False), (3, True)]], "g string, t int, e boolean")
    curve = survival.kaplan_meier(df, ["g"], "t", "e")
    assert [r.survival for r in curve.orderBy("t").collect()] == pytest.approx([0.75, 0.5, 0.0])
    assert survival.survival_quantile(curve, ["g"], "t", 0.5).first().quantile == 2.0


def test_cox_and_aft_find_the_effect(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(2000)
    t = rng.exponential(np.exp(-0.7 * x))
    df = spark.createDataFrame([(float(round(min(a, 3.0), 2) + 0.01), bool(a < 3), float(b)) for a, b in zip(t, x)], "t double, e boolean, x double")
    m = survival.cox(df, ["x"], "t", "e")
    assert m["coefficients"][0] == pytest.approx(0.7, abs=0.1) and m["p"] < 1e-6
    a = survival.aft(df, ["x"], "t", "e", "weibull")
    assert a["coefficients"][1] == pytest.approx(-0.7, abs=0.1) and a["scale"] == pytest.approx(1.0, abs=0.1)
    y = np.exp(1 + 0.5 * x + 0.4 * rng.standard_normal(2000))
    b = survival.aft(spark.createDataFrame([(float(v), True, float(w)) for v, w in zip(y, x)], "t double, e boolean, x double"), ["x"], "t", "e", "lognormal")
    assert b["coefficients"] == pytest.approx([1, 0.5], abs=0.05) and b["scale"] == pytest.approx(0.4, abs=0.03)


def test_holm_and_chi2():
    assert survival.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert var.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and var.chi2_tail(0, 3) == 1.0 and var.chi2_tail(60, 20) == pytest.approx(7.1e-6, rel=0.05)


def test_wilson_below_thirty_is_null(spark):
    df = spark.createDataFrame([(10, 29), (10, 30)], "k int, n int")
    lo, hi = numbers.wilson(F.col("k"), F.col("n"))
    small, large = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert small.lo is None and large.lo == pytest.approx(0.1923, abs=1e-3) and large.hi == pytest.approx(0.5122, abs=1e-3)


def test_lags_never_cross_episodes(spark):
    rows = [(at(60 * k), float(k)) for k in (0, 1, 2, 3, 10, 11, 12, 13)]
    wide = spark.createDataFrame(rows, "ts timestamp_ntz, a double")
    blocks = var.episodes(wide, ["a"], "ts", 60, 3)
    assert blocks.select("episode").distinct().count() == 2
    design, _ = var.lagged(blocks, ["a"], 2)
    assert sorted(r.a for r in design.collect()) == [2.0, 3.0, 12.0, 13.0]


def test_autoregression_recovers_its_law(spark):
    rng = np.random.default_rng(5)
    a = np.array([[0.5, 0.2], [0.0, 0.3]])
    rows, x = [], np.zeros(2)
    for k in range(4000):
        x = a @ x + rng.standard_normal(2)
        rows.append((at(k), float(x[0]), float(x[1])))
    blocks = var.episodes(spark.createDataFrame(rows, "ts timestamp_ntz, p double, q double"), ["p", "q"], "ts", 1, 10)
    m = var.fit_var(blocks, ["p", "q"], 1)
    assert np.allclose(m.lag(1), a, atol=0.06)
    r = m.responses(10)
    assert np.allclose(r[0], np.linalg.cholesky(m.sigma)) and np.allclose(var.variance_shares(r, 10).sum(1), 1)
    assert max(x["modulus"] for x in m.roots(1)) == pytest.approx(0.5, abs=0.06)
    band = var.bootstrap_responses(blocks, ["p", "q"], 1, 2, 40, 1).where("step = 0 and of = 'p' and to = 'p'").first()
    assert band.lo <= band.estimate <= band.hi


def test_gram_and_detrending(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 2))
    y = 1 + x @ [2.0, -1.0] + 0.1 * rng.standard_normal(500)
    df = spark.createDataFrame([("a", *map(float, r), float(v)) for r, v in zip(x, y)] + [("a", 1.0, 1.0, None)], "g string, x double, z double, y double")
    got, fits = linear.detrend(df, "g", "y", ["x", "z"], "r")
    design = np.column_stack([np.ones(500), x])
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    have = sorted(r.r for r in got.collect() if r.r is not None)
    assert have == pytest.approx(sorted(want), abs=1e-8)
    f = fits.first()
    assert f.n == 500 and f.variance == pytest.approx(want.var()) and f.bic == pytest.approx(500 * math.log(want.var()) + 3 * math.log(500))


def test_bootstrap_band_holds_the_mean(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(f"d{k % 30}", int(k % 3), float(rng.standard_normal())) for k in range(900)], "day string, m int, v double")
    for r in eventstudy.cluster_bootstrap(df, "day", "m", "v", 200, 1).collect():
        assert r.lo < r.mean < r.hi
    assert eventstudy.cluster_bootstrap(df.limit(0), "day", "m", "v", 10, 1).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, False), (0.4, True), (0.9, True)], "p double, y boolean")
    s = evaluate.binary_scores(df, "p", "y").first()
    assert (s.n, s.auc) == (4, 0.875) and s.brier == pytest.approx((0.01 + 0.16 + 0.36 + 0.01) / 4)
    c = spark.createDataFrame([([0.2, 0.5, 1.0], 1)], "f array<double>, y int").select(evaluate.crps(F.col("f"), F.col("y")).alias("c"), evaluate.median_class(F.col("f")).alias("m")).first()
    assert c.c == pytest.approx(0.04 + 0.25) and c.m == 1


def test_nothing_of_the_same_minute_or_later_is_seen(spark):
    stops = [(T0.date(), v, p, pl, at(m), d, False) for v, p, pl, m, d in [(1, 0, "x", 0, 0.0), (1, 1, "y", 10, 5.0), (2, 0, "x", 5, 0.0), (2, 1, "y", 20, 1.0), (3, 0, "x", 15, 0.0), (3, 1, "y", 30, 2.0)]]
    schema = "day date, vehicle int, pos int, place string, sched timestamp_ntz, delay double, cancelled boolean"
    seen = {r.vehicle: r.before for r in simulate.transitions(spark.createDataFrame(stops, schema)).collect()}
    # vehicle 1 reaches y at 15: vehicle 3, at x at 15 too, doesn't see it
    assert seen == {1: -1, 2: -1, 3: -1}
    later = [s if s[1:3] != (1, 1) else (*s[:5], 4.0, False) for s in stops]
    assert {r.vehicle: r.before for r in simulate.transitions(spark.createDataFrame(later, schema)).collect()} == {1: -1, 2: -1, 3: 2}


def test_rollout_repeats_and_scenarios_share_draws(spark):
    schema = "day date, vehicle int, pos int, place string, sched timestamp_ntz, delay double"
    stops = spark.createDataFrame([(T0.date(), v, p, f"s{p}", at(10 * v + 5 * p), 0.0) for v in range(5) for p in range(4)], schema)
    law = spark.createDataFrame([(1, -1, 0, 0.6), (1, -1, 1, 0.3), (1, -1, None, 0.1)], "own int, before int, change int, p double")
    base = simulate.simulate(stops, law, 3, 1)
    assert sorted(map(tuple, base.collect()), key=str) == sorted(map(tuple, simulate.simulate(stops, law, 3, 1).collect()), key=str)
    late = simulate.simulate(stops, law, 3, 1, simulate.Scenario("delay", vehicle=0, pos=1, minutes=30))
    assert simulate.effects(base, base).agg(F.max(F.abs("mean"))).first()[0] == 0.0
    assert simulate.effects(base, late).agg(F.sum("affected")).first()[0] > 0
    gone = simulate.simulate(stops, law, 3, 1, simulate.Scenario("cancel", vehicle=2, pos=1)).where("vehicle = 2 and pos >= 1")
    assert gone.where("not cancelled").count() == 0
    shut = simulate.simulate(stops, law, 3, 1, simulate.Scenario("closure", place="s1", first=0, last=60, apart=2)).where("pos = 1 and not cancelled")
    assert shut.agg(F.min("arrival")).first()[0] >= 60


def test_null_arrays(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [34])], "i int, c array<int>")
    assert [r.i for r in df.where(F.array_contains("c", 34)).collect()] == [3] and df.select(F.explode("c")).count() == 1


def test_correlation_of_a_plain_line(spark):
    df = spark.createDataFrame([("a", float(k), 2.0 * k + (1 if k % 2 else -1)) for k in range(40)] + [("b", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in aggregates.correlate(df, ["g"], "x", "y").collect()}
    x, y = np.arange(40.0), np.array([2.0 * k + (1 if k % 2 else -1) for k in range(40)])
    xc = x - x.mean()
    slope = (xc * y).sum() / (xc**2).sum()
    e = y - y.mean() - slope * xc
    assert got["a"].slope == pytest.approx(slope) and got["a"].slope_se == pytest.approx(math.sqrt((xc**2 * e**2).sum() * 40 / 38) / (xc**2).sum()) and got["b"].r is None
