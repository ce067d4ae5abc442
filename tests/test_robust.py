"""The robust score test, placebo times and resampled lines against their definitions."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stroma.operators import bootstrap, ordered, placebo, ranges, survival, var


def score_test(rows):
    """Score, information, sum of squared cluster shares of (t, e, z, cluster), straight from the counting processes."""
    times = sorted({t for t, *_ in rows})
    risk = {u: [r for r in rows if r[0] >= u] for u in times}
    share = {u: sum(r[2] for r in risk[u]) / len(risk[u]) for u in times}
    d = {u: sum(r[1] for r in rows if r[0] == u) for u in times}
    psi = Counter()
    for t, e, z, c in rows:
        psi[c] += e * (z - share[t]) - sum((z - share[u]) * d[u] / len(risk[u]) for u in times if u <= t)
    info = sum(d[u] * (len(risk[u]) - d[u]) / (len(risk[u]) - 1) * share[u] * (1 - share[u]) for u in times if len(risk[u]) > 1)
    return sum(psi.values()), info, sum(v * v for v in psi.values())


@pytest.mark.parametrize("few", [0, 10_000])
def test_robust_score(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW_ROWS", few)
    rng = np.random.default_rng(2)
    rows = [(g, int(t), bool(e), bool(z), int(c)) for g, t, e, z, c in zip(["a", None] * 150, rng.integers(0, 12, 300), rng.random(300) < 0.7, rng.random(300) < 0.4, rng.integers(0, 20, 300))]
    odd = [("a", None, True, True, 1), ("a", 3, None, True, 1), ("a", 3, True, None, 1), ("a", 3, True, True, None)]
    df = spark.createDataFrame(rows + odd, "g string, t long, e boolean, z boolean, c long")
    got = {r.g: r for r in survival.logrank_robust(df, ["g"], "z", "t", "e", "c").collect()}
    assert set(got) == {"a", None}
    for g, r in got.items():
        score, info, robust = score_test([(t, int(e), int(z), c) for h, t, e, z, c in rows if h == g])
        assert (r.score, r.information, r.robust) == pytest.approx((score, info, robust))
        assert (r.chi2, r.log_ratio, r.robust_se) == pytest.approx((score**2 / robust, score / info, robust**0.5 / info)) and r.n == 150
    assert survival.logrank_robust(df, [], "z", "t", "e", "c").first().n == 300
    assert survival.logrank_robust(df.limit(0), ["g"], "z", "t", "e", "c").count() == 0


def test_clusters_of_one_row_are_the_plain_variance_in_size(spark):
    """Without ties and a true null the robust and the model's variance agree."""
    rng = np.random.default_rng(5)
    rows = [(float(t), True, bool(k % 2), k) for k, t in enumerate(rng.random(4000))]
    r = survival.logrank_robust(spark.createDataFrame(rows, "t double, e boolean, z boolean, c long"), [], "z", "t", "e", "c").first()
    assert r.robust / r.information == pytest.approx(1, abs=0.1) and abs(r.score) < 4 * r.robust**0.5


T0 = dt.datetime(2025, 3, 3, 8, 17, 30)
SCHEMA = "id long, place string, ts timestamp_ntz"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clear(at, hits, before, after):
    return not any(at - dt.timedelta(seconds=before) <= h <= at + dt.timedelta(seconds=after) for h in hits)


def test_free_seconds_are_the_complement(spark):
    rng = np.random.default_rng(7)
    start = dt.datetime(2025, 3, 3)
    hits = [("p", start + dt.timedelta(seconds=float(s))) for s in rng.integers(0, 200_000, 25)] + [("p", start + dt.timedelta(seconds=5000, microseconds=1)), ("q", start), ("p", None)]
    hours = [(p, int(start.replace(tzinfo=dt.UTC).timestamp()) + 900 * k) for p in "pqr" for k in range(0, 200, 3)]
    before, after = 700, 2000
    got = placebo.free_seconds(spark.createDataFrame(hours, "place string, hour long"), spark.createDataFrame(hits, "place string, ts timestamp_ntz"), ["place"], "ts", before, after).collect()
    assert len(got) == len(hours)
    for r in got:
        own = sorted(h for p, h in hits if p == r.place and h)
        free = {s for f in r.free for s in range(f.start, f.end)}
        assert sum(f.end - f.start for f in r.free) == len(free)
        at = lambda s: dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None)
        assert free == {s for s in range(r.hour, r.hour + 3600) if clear(at(s), own, before, after)}


def scene(spark):
    """Rows of two places over weeks around a change of clocks, every seventh a hit; place "none" has rows on its event's day alone."""
    rows = [(k, "pq"[k % 2], T0 + dt.timedelta(minutes=47 * k)) for k in range(2000)] + [(9000, "none", T0), (9001, None, T0), (9002, "p", None)]
    stream = table(spark, rows)
    return rows, stream, stream.where("id % 7 = 0 or id >= 9000")


@pytest.mark.parametrize("anchored", [False, True])
def test_placebos_keep_to_the_rules(spark, anchored):
    rows, stream, hits = scene(spark)
    zone, k, days, before, after = "Europe/Berlin", 4, 10, 3600, 3600
    if anchored:
        got = placebo.placebo_anchored(hits, stream, hits, ["place"], "id", "id", "ts", k, days, before, after, 120, 3, zone=zone, excluded=["2025-03-20"]).collect()
    else:
        got = placebo.placebo_uniform(hits, stream, hits, ["place"], "id", "ts", k, days, before, after, 3, zone=zone, excluded=["2025-03-20"]).collect()
    from zoneinfo import ZoneInfo

    local = lambda t: t.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    opday = lambda t: (local(t) - dt.timedelta(hours=3)).date()
    kind = lambda d: {4: 1, 5: 2, 6: 3}.get(d.weekday(), 0)
    event = {i: (p, t) for i, p, t in rows if i % 7 == 0}
    hit_at = {p: [t for i, q, t in rows if q == p and (i % 7 == 0 or i >= 9000) and t] for p in ("p", "q")}
    days_of = {p: {opday(t) for _, q, t in rows if q == p and t} for p in ("p", "q")}
    per_event = Counter(r.id for r in got)
    assert set(per_event.values()) == {k} and 9000 not in per_event and len(per_event) > 200
    for r in got:
        place, t0 = event[r.id]
        base = r.at - dt.timedelta(seconds=120) if anchored else r.at
        assert r.place == place and clear(r.at, hit_at[place], before, after)
        assert local(base).hour == local(t0).hour and opday(base) != opday(t0) and kind(opday(base)) == kind(opday(t0)) and opday(base) in days_of[place]
        assert 0 < abs((local(base).date() - local(t0).date()).days) <= days and str(opday(base)) != "2025-03-20"
        if anchored:
            assert dict((i, t) for i, _, t in rows)[r.anchor] == base
    again = placebo.placebo_uniform(hits, stream, hits, ["place"], "id", "ts", k, days, before, after, 3, zone=zone, excluded=["2025-03-20"]) if not anchored else None
    assert again is None or Counter(again.collect()) == Counter(got)


def test_hours_are_asked_for_like_days_alone(spark):
    """Only days of the event's kind are listed, and no time is moved between zones for each of them where the clock is UTC's; another name of that zone gives the same hours."""
    rows, stream, hits = scene(spark)
    ask = lambda zone: placebo.candidate_hours(hits, stream, ["place"], "id", "ts", 10, zone=zone, holidays=["2025-03-11"], excluded=["2025-03-20"])
    plan = ask("UTC")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate explode")[0]
    assert "from_utc_timestamp" not in above and "sequence(" not in above and above.count("to_utc_timestamp") <= 2
    got = Counter(ask("UTC").collect())
    assert got == Counter(ask("Etc/UTC").collect())
    opday = lambda t: (t - dt.timedelta(hours=3)).date()
    kind = lambda d: 3 if str(d) == "2025-03-11" else {4: 1, 5: 2, 6: 3}.get(d.weekday(), 0)
    known = {(p, opday(t)) for _, p, t in rows if p and t}
    want: Counter = Counter()
    for i, p, t in rows:
        if (i % 7 == 0 or i >= 9000) and p and t:
            for d in range(-10, 11):
                there = t.replace(minute=0, second=0) + dt.timedelta(days=d)
                if d and kind(opday(there)) == kind(opday(t)) and (p, opday(there)) in known and str(opday(there)) != "2025-03-20":
                    want[(i, p, int(there.replace(tzinfo=dt.UTC).timestamp()))] += 1
    assert got == want and len(want) > 500


def test_uniform_draws_cover_what_is_free_evenly(spark):
    stream = table(spark, [(k, "p", dt.datetime(2025, 3, 3, 8) + dt.timedelta(days=k)) for k in range(3)])
    events, hits = stream.where("id = 0"), table(spark, [(9, "p", dt.datetime(2025, 3, 4, 8, 30))])
    got = placebo.placebo_uniform(events, stream, hits, ["place"], "id", "ts", 6000, 3, 600, 600, 1).collect()
    bins = Counter((r.at.day, r.at.minute // 10) for r in got)
    # 20 of the 60 minutes of the fourth are ruled out, and one second at their end
    free = {(4, 0): 10, (4, 1): 10, (4, 4): 10, (4, 5): 10, **{(5, m): 10 for m in range(6)}}
    assert set(bins) == set(free) and max(abs(n - 600) for n in bins.values()) < 110


def test_an_hour_counts_with_its_share_of_admissible_rows(spark):
    """Of three hours with 1, 4 and 2 rows, of which 1, 1 and 0 are admissible, draws take the first four times as often as the second."""
    day = dt.datetime(2025, 3, 3, 8)
    rows = [(0, day), (1, day + dt.timedelta(days=1)), *[(10 + k, day + dt.timedelta(days=2, minutes=10 * k)) for k in range(4)], (20, day + dt.timedelta(days=3)), (21, day + dt.timedelta(days=3))]
    stream = table(spark, [(i, "p", t) for i, t in rows])
    hits = table(spark, [(90, "p", day + dt.timedelta(days=2, minutes=20)), (91, "p", day + dt.timedelta(days=3))])
    got = placebo.placebo_anchored(stream.where("id = 0"), stream, hits, ["place"], "id", "id", "ts", 5000, 3, 780, 900, 120, 1).collect()
    taken = Counter(r.anchor for r in got)
    assert set(taken) == {1, 10}
    assert taken[1] / len(got) == pytest.approx(0.8, abs=0.03)


def test_lines_of_resamples_are_weighted_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{k % 9}", "ab"[k % 2], float(x), float(2 * x + y)) for k, (x, y) in enumerate(zip(rng.random(200), rng.random(200)))] + [("c1", "a", None, 1.0), (None, "a", 1.0, 1.0), ("c1", "z", 1.0, 5.0)]
    got = bootstrap.resampled_moments(spark.createDataFrame(rows, "c string, g string, x double, y double"), "c", "g", "x", "y", 30, 8).collect()
    weights = {f"c{k}": np.concatenate([bootstrap.weights(8, 30, f"c{k}"), [1]]) for k in range(9)}
    for r in got:
        if r.g == "z":
            assert r.slope is None
            continue
        own = [(weights[c][r.draw], x, y) for c, g, x, y in rows if g == r.g and c and x is not None]
        w, x, y = map(np.array, zip(*own))
        slope, constant = np.polyfit(x, y, 1, w=np.sqrt(w))
        assert (r.n, r.slope, r.constant) == pytest.approx((w.sum(), slope, constant))


def test_medians_by_group_are_each_group_s(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[k % 2], f"c{k % 12}", int(t), bool(e)) for k, (t, e) in enumerate(zip(rng.integers(0, 30, 400), rng.random(400) < 0.8))]
    df = spark.createDataFrame(rows, "g string, c string, t long, e boolean")
    both = {r.g: tuple(r)[1:] for r in survival.km_bootstrap(df, "c", "t", "e", 0.5, 60, 2, by=["g"]).collect()}
    for g in "ab":
        assert both[g] == tuple(survival.km_bootstrap(df.where(F.col("g") == g), "c", "t", "e", 0.5, 60, 2).first())


def test_blocks_of_the_network_hold_for_all(spark):
    rng = np.random.default_rng(11)
    start = dt.datetime(2025, 3, 1)
    at = lambda m: start + dt.timedelta(minutes=int(m))
    own = [("pq"[k % 2], at(m), at(m + d)) for k, (m, d) in enumerate(zip(rng.integers(0, 9000, 30), rng.integers(1, 200, 30)))]
    net = [(at(m), at(m + d)) for m, d in zip(rng.integers(0, 9000, 6), [5, 30, 2000, 60, 60, 1])] + [(at(2880), at(2940))]
    probes = [(k, "pqr"[k % 3], at(m), at(m + 50)) for k, m in enumerate(rng.integers(-500, 12000, 400))] + [(900, "p", at(2940), at(2990)), (901, "r", at(2830), at(2880))]
    df = spark.createDataFrame(probes, "id long, k string, a timestamp_ntz, b timestamp_ntz")
    got = {r.id: r.hit for r in ranges.overlaps_anywhere(df, ranges.merge_intervals(spark.createDataFrame(own, "k string, a timestamp_ntz, b timestamp_ntz"), ["k"], "a", "b"), ["k"], "a", "b", spark.createDataFrame(net, "a timestamp_ntz, b timestamp_ntz"), "hit").collect()}
    assert len(got) == len(probes)
    for i, k, a, b in probes:
        assert got[i] == (any(s < b and e > a for p, s, e in own if p == k) or any(s < b and e > a for s, e in net)), i
    none = spark.createDataFrame([], "a timestamp_ntz, b timestamp_ntz")
    assert not any(r.hit for r in ranges.overlaps_anywhere(df.where("k = 'r'"), spark.createDataFrame([], "k string, a timestamp_ntz, b timestamp_ntz"), ["k"], "a", "b", none, "hit").collect())


def test_a_hazard_that_changes_is_seen(spark):
    rng = np.random.default_rng(12)
    z = rng.random(1500) < 0.5
    early = rng.exponential(np.where(z, 0.5, 1.0))
    t = np.where(early < 0.6, early, 0.6 + rng.exponential(1.0, 1500))
    df = spark.createDataFrame([(float(a), True, float(b)) for a, b in zip(t, z)], "t double, e boolean, z double")
    split, [(term, one, _, two, _)] = survival.early_late(df, ["z"], "t", "e", 0.6)
    assert (split, term) == (0.6, "z") and one == pytest.approx(np.log(2), abs=0.25) and two == pytest.approx(0, abs=0.25)


def test_the_side_peak_is_behind_the_first_lags(spark):
    acf = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.9), ("a", 2, 0.2), ("a", 3, 0.5), ("a", 4, 0.5), ("b", 2, None), ("b", 3, -0.1)], "s string, lag int, acf double")
    assert {tuple(r) for r in var.side_peak(acf, ["s"], 2).collect()} == {("a", 3, 0.5), ("b", 3, -0.1)}
