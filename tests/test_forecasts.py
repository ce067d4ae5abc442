"""Criteria, recursive forecasts and unit roots against least squares written out."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from stroma.operators import var

T0 = dt.datetime(2024, 1, 1)


def walk(rng, n, k=2):
    x = np.zeros((n, k))
    for t in range(1, n):
        x[t] = 0.5 * x[t - 1] + 0.2 * x[t - 1][::-1] + rng.normal(size=k)
    return x


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(0)
    eps = {f"e{j}": walk(rng, n) + 10 for j, n in enumerate([40, 25, 3, 60])}
    rows, at = [], 0
    for e, x in eps.items():
        for s, v in enumerate(x):
            rows.append((e, s + 1, T0 + dt.timedelta(hours=at + s), float(v[0]), float(v[1])))
        at += 200
    return eps, spark.createDataFrame(rows, "episode string, step int, ts timestamp_ntz, a double, b double")


def design(eps, p):
    x = [np.concatenate([[1.0], *[e[t - l] for l in range(1, p + 1)]]) for e in eps.values() for t in range(p, len(e))]
    return np.array(x), np.array([e[t] for e in eps.values() for t in range(p, len(e))])


def test_criteria(spark, blocks):
    eps, df = blocks
    got = {r.order: r for r in var.order_criteria(df, ["a", "b"], [1, 3, 5]).collect()}
    for p, r in got.items():
        x, y = design(eps, p)
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        log_det, t, m = np.linalg.slogdet(rest.T @ rest / len(x))[1], len(x), 1 + 2 * p
        assert (r.rows, r.parameters) == (t, m)
        assert (r.log_det, r.aic, r.bic) == pytest.approx((log_det, log_det + 2 / t * 2 * m, log_det + math.log(t) / t * 2 * m))
    few = var.order_criteria(df.where("episode = 'e2'"), ["a", "b"], [1]).first()
    assert few.rows == 2 and few.log_det is None
    assert var.order_criteria(df.limit(0), ["a", "b"], [1]).count() == 0


def test_forecasts(spark, blocks):
    eps, df = blocks
    model = var.fit_var(df, ["a", "b"], 2)
    got = {(r.episode, r.step, r.horizon, r.series): r for r in var.recursive_forecasts(df, "ts", 60, model, [1, 4]).collect()}
    n = 0
    for e, x in eps.items():
        for t in range(1, len(x)):
            state = [x[t], x[t - 1]]
            for h in range(1, 5):
                ahead = model.coefficients[0] + sum(model.lag(l + 1) @ state[l] for l in range(2))
                state = [ahead, state[0]]
                if h in (1, 4) and t + h < len(x):
                    for i, s in enumerate("ab"):
                        r = got[e, t + 1, h, s]
                        assert (r.forecast, r.walk, r.truth) == pytest.approx((ahead[i], x[t][i], x[t + h][i]))
                        n += 1
    assert n == len(got)
    scores = var.forecast_scores(df, df, ["a", "b"], "ts", 60, 2, [1]).collect()
    for r in scores:
        e = [x.truth - x.forecast for x in got.values() if x.horizon == 1 and x.series == r.series]
        assert r.rmse_var == pytest.approx(np.sqrt(np.mean(np.square(e)))) and r.n == len(e) and r.rmse_var < r.rmse_walk


def statistic(x, most):
    d = np.diff(x)
    top = int(max(0, min(most, math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 3)))

    def fitted(k, first):
        rows = range(first, len(d))
        a = np.array([[1.0, x[t], *[d[t - l] for l in range(1, k + 1)]] for t in rows])
        y = d[first:]
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        rest = float(((y - a @ b) ** 2).sum())
        return b, rest, len(y), a

    def aic(k):
        _, rest, n, _ = fitted(k, top)
        return n * math.log(rest / n) + 2 * (2 + k)

    best = min(range(top + 1), key=aic)
    b, rest, n, a = fitted(best, best)
    return n, best, b[1] / math.sqrt(rest / (n - 2 - best) * np.linalg.inv(a.T @ a)[1, 1])


def test_unit_roots(spark):
    rng = np.random.default_rng(1)
    series = {"walk": np.cumsum(rng.normal(size=200)), "calm": rng.normal(size=200), "lagged": walk(rng, 160)[:, 0], "short": rng.normal(size=9), "flat": np.ones(50)}
    x = np.zeros(300)
    for t in range(3, 300):
        x[t] = x[t - 1] + 0.6 * (x[t - 1] - x[t - 2]) - 0.3 * (x[t - 2] - x[t - 3]) + rng.normal()
    series["long"] = x
    df = spark.createDataFrame([(k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)] + [("calm", 999, None)], "g string, t int, v double")
    got = {r.g: r for r in var.unit_root_lags(df, ["g"], "t", "v", 4, 20).collect()}
    assert set(got) == {"walk", "calm", "lagged", "flat", "long"} and got["flat"].statistic is None and got["flat"].p_range is None
    for k in ("walk", "calm", "lagged", "long"):
        assert (got[k].n, got[k].lags, got[k].statistic) == pytest.approx(statistic(series[k], 4))
    assert got["walk"].p_range == "above 0.10" and got["calm"].p_range == "below 0.01" and got["long"].lags >= 2
