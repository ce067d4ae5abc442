"""Routes from trips, boosting with held-out rows, roots with and without further cycles."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stroma.operators import features, routes, var


def test_longest_run_is_the_longest_of_all():
    rng = random.Random(0)
    for _ in range(200):
        x = [rng.randint(1, 9) for _ in range(rng.randint(0, 8))]
        best = max(k for k in range(len(x) + 1) for c in combinations(x, k) if all(a < b for a, b in zip(c, c[1:])))
        assert routes.longest_run(x) == best


def test_the_route_is_found_from_parts(spark):
    """No trip sees the whole line, some go the other way, a few visits are out of order; the order comes out."""
    rng = random.Random(3)
    line, rows = [f"p{k:02d}" for k in range(12)], []
    for t in range(300):
        first = rng.randint(0, 4)
        part = line[first : first + 8]
        if t % 3 == 0:
            part = part[::-1]
        if t % 10 == 0:
            part = [*part[:2], part[3], part[2], *part[4:]]
        rows += [(t, p, k) for k, p in enumerate(part)] + [(t, part[0], 99), (t, None, 5)]
    df = spark.createDataFrame(rows, "trip long, place string, seq long")
    got = {r.place: r for r in routes.route_order(df, ["trip"], "place", ["seq"]).collect()}
    order = sorted(got, key=lambda p: got[p].position)
    assert order in (line, line[::-1]) and min(r.agreed for r in got.values()) > 0.9
    assert sorted(r.anchor_rank for r in got.values() if r.anchor_rank) == list(range(1, 9)) and sum(r.anchor_rank is None for r in got.values()) == 4
    trips = routes.trip_orders(df, ["trip"], "place", ["seq"])
    fit = {r.trip: r for r in routes.agreement(trips, ["trip"], line).collect()}
    assert all(r.shared == 8 and max(r.forward, r.backward) == (7 if t % 10 == 0 else 8) for t, r in fit.items())
    assert routes.route_order(df.limit(0), ["trip"], "place", ["seq"]).count() == 0


def test_levels_of_distance(spark):
    rows = [(48.0, 11.0, 48.0, 11.0), (48.0, 11.0, 48.002, 11.0), (48.0, 11.0, 48.1, 11.0), (48.0, 11.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [r.x for r in df.select(routes.distance_level(*[F.col(c) for c in "abcd"]).alias("x")).collect()] == ["high", "middle", "low", "unproven"]


def test_boosting_stops_early_and_beats_the_groups(spark):
    rng = np.random.default_rng(1)
    x, g, noise = rng.random(3000), rng.integers(0, 3, 3000), rng.random(3000)
    y = rng.random(3000) < np.where((x > 0.5) ^ (g == 1), 0.8, 0.15)
    rows = [(float(a) if k % 50 else None, int(b), float(n), bool(v), k % 3 == 1, k % 3 == 2) for k, (a, b, n, v) in enumerate(zip(x, g, noise, y))]
    df = spark.createDataFrame(rows, "x double, g int, noise double, y boolean, held boolean, test boolean")
    model, grid = features.boosted_grid(df.where("not test"), ["x", "g", "noise"], "y", "held", [(1, 0.3), (3, 0.3)], trees=15)
    got = {r.depth: r for r in grid.collect()}
    assert got[3].chosen and not got[1].chosen and got[3].log_loss < got[1].log_loss and all(r.trees <= 15 and r.n == 1000 for r in got.values())
    test = features.log_loss(model, df.where("test"), ["x", "g", "noise"], "y")
    base = features.group_log_loss(df.where("not test"), df.where("test"), ["g"], "y").first()
    assert test["n"] == base.n == 1000 and test["log_loss"] < base.log_loss < math.log(2)


def test_roots_are_matched_by_frequency():
    def model(*roots):
        a = np.array([[2 * r * math.cos(w), -r * r] for r, w in roots])
        big = np.zeros((2 * len(a), 2 * len(a)))
        for k, (x, y) in enumerate(a):
            big[2 * k, 2 * k : 2 * k + 2], big[2 * k + 1, 2 * k] = (x, y), 1
        return var.Model([f"s{k}" for k in range(len(big))], 1, np.vstack([np.zeros(len(big)), big.T]), np.eye(len(big)), 100)

    got = var.matched_roots(model((0.9, 0.5), (0.6, 2.0)), model((0.3, 2.1), (0.88, 0.52), (0.5, 1.2)), 10)
    assert [(r["rank"], round(r["modulus"], 6), round(r["modulus_after"], 6)) for r in got] == [(1, 0.9, 0.88), (2, 0.6, 0.3)]
    assert got[0]["moved"] == pytest.approx(0.02) and got[0]["period"] == pytest.approx(2 * math.pi / 0.5 * 10) and got[1]["moved"] == pytest.approx(0.1)
