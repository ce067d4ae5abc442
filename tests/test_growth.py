"""Steps whose work grows with the rows: no pairs within a window, no frame summed anew for each row."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from stroma.operators import features, ranges, simulate
from stroma.plans import rollout
from stroma.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 8, 8)
HALF = 1800 * 1_000_000


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_others_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "ab"[k % 2], None if k % 41 == 0 else int(w), None if k % 37 == 0 else T0 + dt.timedelta(minutes=int(m))) for k, (w, m) in enumerate(zip(rng.integers(0, 9, 400), rng.integers(0, 2000, 400)))]
    df = spark.createDataFrame(rows, "i long, k string, who long, t timestamp_ntz")
    want = {i: len({v for _, q, v, s in rows if q == k and v is not None and v != w and s and t - dt.timedelta(minutes=30) <= s <= t}) if t and w is not None else 0 for i, k, w, t in rows}
    assert {r.i: r.n for r in ranges.distinct_others(df, ["k"], "t", "who", HALF, "n").collect()} == want and max(want.values()) > 2


def test_load_makes_no_pairs(spark):
    assert "Join" not in plan(spark, "disturbance_load")


def test_sums_of_a_window_end_where_it_ends(spark):
    rng = np.random.default_rng(6)
    at = lambda s: T0 + dt.timedelta(seconds=int(s))
    stream = [("ab"[k % 2], at(s), 1.0 + k) for k, s in enumerate([0, 900, 900, 1800, 2699, *rng.integers(0, 5400, 200)])] + [("a", None, 5.0)]
    asked = [(i, "abc"[i % 3], at(s)) for i, s in enumerate([900, 1800, 1801, 2700, *rng.integers(0, 6000, 200)])] + [(999, "a", None)]
    got = features.recent_sums(spark.createDataFrame(asked, "i long, k string, t timestamp_ntz"), spark.createDataFrame(stream, "k string, t timestamp_ntz, v double"), ["k"], "t", 15, {"s": "v"}).collect()
    want = {i: sum(v for q, s, v in stream if q == k and s and t and t - dt.timedelta(minutes=15) <= s < t) for i, k, t in asked}
    assert {r.i: r.s for r in got} == want


def test_features_take_no_sliding_frames(spark):
    """A range frame that slides is summed anew for each row."""
    assert "RangeFrame" not in plan(spark, "transition_features").replace("RangeFrame, unboundedpreceding$(), currentrow$()", "")


def test_boosting_grid_takes_no_sliding_frames(spark, monkeypatch):
    """Nor do the features that it writes before it fits."""

    class Seen(Exception):
        pass

    def stop(df, name):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(rollout, "materialise", stop)
    with pytest.raises(Seen) as seen:
        QUERIES["boosting_grid"](spark, SMALL)
    found = str(seen.value)
    assert "Window" in found and "RangeFrame" not in found.replace("RangeFrame, unboundedpreceding$(), currentrow$()", "")


def test_boosting_reads_written_rows(spark):
    """The fit reads its rows many times; they are not worked out anew each time."""
    assert "Window" not in plan(spark, "boosted_cancellation")


def test_rollout_gives_rows_as_they_happen():
    """A run's result never lies whole in a task: it comes while the day goes on."""
    n = 1000
    columns = {"vehicle": np.repeat(np.arange(n), 3), "pos": np.tile(np.arange(3), n), "minute": np.tile([5, 9, 14], n), "place": np.zeros(3 * n, np.int32), "delay": np.zeros(3 * n)}
    rows = simulate._rollout(simulate._paths(columns, ["p"]), 0, 1, {None: ([0], [1.0])}, simulate.Scenario())
    assert iter(rows) is rows and next(rows)[:3] == (0, 0, 5)
    assert sum(1 for _ in rows) == 3 * n - 1
