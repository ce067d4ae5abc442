"""Queries read all rows of their tables, whatever the ids: against brute force on a fixture of many users."""

from __future__ import annotations

import datetime as dt
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from stroma.plans.registry import QUERIES

START = dt.datetime(2024, 1, 9)
HALF = dt.timedelta(minutes=30)


def events() -> list[tuple]:
    kinds = ["view", "click", "purchase", "error"]
    return [(k, START + dt.timedelta(minutes=k * 37 % 5000), k % 60, kinds[(k * k + k // 60) % 4], float(k * 13 % 120)) for k in range(400)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    at = str(tmp_path_factory.mktemp("whole"))
    rows = [(*e, '{"k": 1}') for e in events()]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    return at


def active() -> set[tuple]:
    out = set()
    for _, ts, _, kind, value in events():
        w = START + (ts - START) // HALF * HALF
        while True:
            out.add((kind, w))
            if w >= ts + dt.timedelta(minutes=round(min(value, 90.0))):
                break
            w += HALF
    return out


def test_active_windows_of_all_users(spark, folder):
    want = Counter(kind for kind, _ in active())
    assert {r.event_type: r.windows for r in QUERIES["active_windows"](spark, folder).collect()} == dict(want)


def test_simultaneously_active_of_all_users(spark, folder):
    want = Counter(Counter(w for _, w in active()).values())
    assert {r.n_active: r.windows for r in QUERIES["simultaneously_active"](spark, folder).collect()} == dict(want)


def test_lift_pairs_of_all_users(spark, folder):
    at = defaultdict(set)
    for kind, w in active():
        at[kind].add(w)
    total = len(set.union(*at.values()))
    want = {(a, b): (len(at[a] & at[b]), pytest.approx(len(at[a] & at[b]) * total / (len(at[a]) * len(at[b])), abs=1e-5)) for a, b in combinations(sorted(at), 2) if at[a] & at[b]}
    assert {(r.code_a, r.code_b): (r.joint, r.lift) for r in QUERIES["lift_pairs"](spark, folder).collect()} == want


def test_nearest_in_time_of_all_users(spark, folder):
    want = {}
    for doc in range(3):
        t = dt.datetime(2024, 1, 10, 8 + doc)
        for user in range(60):
            want[doc, user] = min((abs(e[1] - t), e[0]) for e in events() if e[2] == user)[1]
    assert {(r.doc, r.user_id): r.event_id for r in QUERIES["nearest_in_time"](spark, folder).collect()} == want
