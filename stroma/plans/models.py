"""Regression, autoregression, survival, calibration and simulation on the test tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, micros
from stroma.functions.numbers import harmonics, r6
from stroma.operators import evaluate, grid, linear, ordered, simulate, survival, var
from stroma.operators.bootstrap import weight_sql
from stroma.plans.base import query, table

TYPES = ["click", "error", "purchase", "signup", "view"]


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by hour and event type, with hours since the first of 2024."""
    e = table(spark, sf_dir, "events")
    cells = e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window")).agg(F.avg("value").alias("mean"))
    return cells.withColumn("hours", (micros("window") - micros(F.lit("2024-01-01").cast("timestamp_ntz"))) / (3600.0 * MICROS))


_HOURLY = """hourly AS (SELECT event_type, date_trunc('hour', ts) AS "window", avg(value) AS mean, (epoch_us(date_trunc('hour', ts)) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS hours FROM events GROUP BY 1, 2, 4)"""
_TERMS = ["1.0", *[f"{f}(hours * {2 * math.pi * k / p!r})" for p, many in ((24.0, 2), (168.0, 1)) for k in range(1, many + 1) for f in ("sin", "cos")], "mean"]


@query(f"WITH {_HOURLY} " + " UNION ALL ".join(f"SELECT event_type, {i} AS i, {j} AS j, round(sum(({a}) * ({b})), 3) + 0.0 AS total FROM hourly GROUP BY 1" for i, a in enumerate(_TERMS) for j, b in enumerate(_TERMS) if i <= j))
def ols_normal_equations(spark, sf_dir):
    """Normal equations of daily and weekly harmonics, by event type."""
    h = _hourly(spark, sf_dir)
    terms = harmonics(F.col("hours"), [(24.0, 2), (168.0, 1)])
    x = h.select("event_type", F.lit(1.0).alias("x0"), *[t.alias(f"x{i + 1}") for i, t in enumerate(terms)], "mean")
    return linear.gram(x, [*[f"x{i}" for i in range(len(terms) + 1)], "mean"], ["event_type"]).withColumn("total", F.round("total", 3) + F.lit(0.0))


def _detrended(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    h = _hourly(spark, sf_dir)
    terms = {f"x{i}": t for i, t in enumerate(harmonics(F.col("hours"), [(24.0, 4), (168.0, 3)]))}
    return linear.detrend(h.withColumns(terms), "event_type", "mean", list(terms), "residual")


@query()
def fourier_detrend(spark, sf_dir):
    return _detrended(spark, sf_dir)[1]


@query(f"WITH {_HOURLY}, m AS (SELECT event_type, avg(mean) AS mu, count(*) AS n FROM hourly GROUP BY 1), f AS (SELECT unnest([6, 8, 12, 24, 48, 168]::DOUBLE[]) AS period) "
       "SELECT event_type, period, round((pow(sum((mean - mu) * cos(2 * pi() * hours / period)), 2) + pow(sum((mean - mu) * sin(2 * pi() * hours / period)), 2)) / any_value(n), 4) AS power FROM hourly JOIN m USING (event_type) CROSS JOIN f GROUP BY 1, 2")
def periodogram(spark, sf_dir):
    """Power of given periods in unevenly known series, from sums by frequency."""
    h = _hourly(spark, sf_dir)
    m = h.groupBy("event_type").agg(F.avg("mean").alias("mu"), F.count(F.lit(1)).alias("n"))
    x = h.join(F.broadcast(m), "event_type").select("event_type", "n", "hours", (F.col("mean") - F.col("mu")).alias("c"), F.explode(F.array(*[F.lit(p) for p in (6.0, 8.0, 12.0, 24.0, 48.0, 168.0)])).alias("period"))
    angle = 2 * math.pi * F.col("hours") / F.col("period")
    return x.groupBy("event_type", "period").agg(F.round((F.pow(F.sum(F.col("c") * F.cos(angle)), 2) + F.pow(F.sum(F.col("c") * F.sin(angle)), 2)) / F.any_value("n"), 4).alias("power"))


@query(f"""WITH {_HOURLY}, c AS (SELECT event_type, "window"::DATE AS day, "window", mean - avg(mean) OVER w AS c, var_pop(mean) OVER w AS v, count(*) OVER w AS n FROM hourly WINDOW w AS (PARTITION BY event_type, "window"::DATE)),
l AS (SELECT event_type, day, v, n, lag, sum(c * p) AS s FROM (SELECT *, CASE lag {' '.join(f'WHEN {k} THEN lag(c, {k}) OVER q' for k in range(4))} END AS p FROM c CROSS JOIN (SELECT unnest(range(4)) AS lag) WINDOW q AS (PARTITION BY event_type, day, lag ORDER BY "window")) GROUP BY ALL)
SELECT event_type, lag::INT AS lag, sum(n - lag)::BIGINT AS n, round(sum(s / v) / sum(n - lag), 6) AS acf FROM l WHERE v > 0 AND n > lag GROUP BY 1, 2""")
def pooled_acf(spark, sf_dir):
    """Autocorrelation within days, pooled with weights n - lag, all types in one pass."""
    h = _hourly(spark, sf_dir).withColumn("day", F.col("window").cast("date"))
    return var.pooled_acf(h, ["event_type", "day"], "window", "mean", 3, ["event_type"]).select("event_type", "lag", "n", r6(F.col("acf")).alias("acf"))


@query(f"""WITH {_HOURLY}, past AS (SELECT event_type, isodow("window") AS d, hour("window") AS h, avg(mean) AS typical FROM hourly WHERE "window" < TIMESTAMP '2024-01-21' GROUP BY 1, 2, 3),
x AS (SELECT event_type, "window", mean, lag(mean, 1) OVER w AS rw, h.typical FROM hourly LEFT JOIN past h USING (event_type) WHERE h.d = isodow("window") AND h.h = hour("window") WINDOW w AS (PARTITION BY event_type ORDER BY "window"))
SELECT event_type, model, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias FROM (SELECT event_type, 'random walk' AS model, count(*) AS n, avg(abs(rw - mean)) AS mae, sqrt(avg(pow(rw - mean, 2))) AS rmse, avg(rw - mean) AS bias FROM x WHERE "window" >= TIMESTAMP '2024-01-21' AND rw IS NOT NULL GROUP BY 1
UNION ALL SELECT event_type, 'typical', count(*), avg(abs(typical - mean)), sqrt(avg(pow(typical - mean, 2))), avg(typical - mean) FROM x WHERE "window" >= TIMESTAMP '2024-01-21' AND typical IS NOT NULL GROUP BY 1)""")
def baseline_forecast_errors(spark, sf_dir):
    """Random walk and mean of weekday and hour, out of sample."""
    h = _hourly(spark, sf_dir).withColumn("d", F.weekday("window")).withColumn("h", F.hour("window"))
    cut = F.lit("2024-01-21").cast("timestamp_ntz")
    typical = h.where(F.col("window") < cut).groupBy("event_type", "d", "h").agg(F.avg("mean").alias("typical"))
    x = h.join(typical, ["event_type", "d", "h"]).withColumn("rw", F.lag("mean").over(W.partitionBy("event_type").orderBy("window"))).where(F.col("window") >= cut)
    made = [evaluate.point_errors(x, ["event_type"], c, "mean").withColumn("model", F.lit(name)) for c, name in (("rw", "random walk"), ("typical", "typical"))]
    return made[0].unionByName(made[1]).select("event_type", "model", "n", *[r6(F.col(c)).alias(c) for c in ("mae", "rmse", "bias")])


def _blocks(spark, sf_dir) -> DataFrame:
    """Detrended means of three-hour windows by type, wide, interpolated, in episodes."""
    e = table(spark, sf_dir, "events")
    cells = grid.state_grid(e, "event_type", "ts", "value", 180, 100.0).select("window", "event_type", "mean")
    filled = ordered.interpolate(cells, ["event_type"], ["window"], "mean", 2, "filled")
    wide = filled.groupBy("window").pivot("event_type", TYPES).agg(F.first("filled"))
    return var.episodes(wide, TYPES, "window", 180, 6)


@query()
def var_order_selection(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    rows = []
    for p in (1, 2):
        m = var.fit_var(b, TYPES, p)
        rows.append((p, m.rows, *[float(c) for c in m.criteria()]))
    return spark.createDataFrame(rows, "p int, rows int, aic double, bic double")


@query()
def var_irf_fevd(spark, sf_dir):
    m = var.fit_var(_blocks(spark, sf_dir), TYPES, 1)
    r = m.responses(8)
    shares = var.variance_shares(r, 8)
    rows = []
    for i, of in enumerate(TYPES):
        for j, to in enumerate(TYPES):
            at, top, half = var.peak_and_half_life(r[:, i, j], 180)
            rows.append((of, to, at, top, half, float(shares[i, j]), float(shares[:, i].sum() - shares[i, i] - (1 - shares[i, i])) if i == j else None))
    return spark.createDataFrame(rows, "response string, shock string, peak_minutes double, peak double, half_life double, variance_share double, net_export double")


@query()
def var_roots(spark, sf_dir):
    roots = var.fit_var(_blocks(spark, sf_dir), TYPES, 1).roots(180)
    return spark.createDataFrame([tuple(r.values()) for r in roots], "real double, imag double, modulus double, period double, half_life double")


@query()
def var_bootstrap_band(spark, sf_dir):
    return var.bootstrap_responses(_blocks(spark, sf_dir), TYPES, 1, 4, 100, 3)


@query()
def var_diagnostics(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    rows = var.diagnostics(var.residuals(b, var.fit_var(b, TYPES, 1)), TYPES, 4)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "series string, n long, ljung_box double, ljung_box_p double, jarque_bera double, jarque_bera_p double")


# --- survival: hours from a purchase to the user's next event, censored at 36 ---

_TIMES = """times AS (SELECT event_id, hour(ts) >= 12 AS late, ntype AS nxt, user_id, value, least(floor((epoch_us(nt) - epoch_us(ts)) / 3600000000.0), 36)::BIGINT AS t, coalesce((epoch_us(nt) - epoch_us(ts)) / 3600000000.0 < 36, FALSE) AS e FROM
(SELECT *, lead(ts) OVER w AS nt, lead(event_type) OVER w AS ntype FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase' AND nt IS NOT NULL)"""


def _times(spark, sf_dir) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("nt", F.lead("ts").over(w)).where("event_type = 'purchase' and nt is not null")
    hours = (micros("nt") - micros("ts")) / (3600.0 * MICROS)
    return e.select("event_id", (F.hour("ts") >= 12).alias("late"), "user_id", "value", F.least(F.floor(hours), F.lit(36)).cast("long").alias("t"), (hours < 36).alias("e"))


_KM = f"""{_TIMES}, a AS (SELECT late, t, count(*) FILTER (e) AS d, count(*) AS m FROM times GROUP BY 1, 2), r AS (SELECT *, sum(m) OVER (PARTITION BY late ORDER BY t DESC) AS n FROM a),
km AS (SELECT late, t, d, n::BIGINT AS n, CASE WHEN max((d >= n)::INT) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER w) END AS survival FROM r WHERE d > 0 WINDOW w AS (PARTITION BY late ORDER BY t))"""


@query(f"WITH {_KM} SELECT late, t, d, n, round(survival, 6) AS survival FROM km")
def kaplan_meier(spark, sf_dir):
    return survival.kaplan_meier(_times(spark, sf_dir), ["late"], "t", "e").withColumn("survival", r6(F.col("survival")))


@query(f"WITH {_KM} SELECT late, coalesce(min(t) FILTER (survival <= 0.5 + 1e-12), 'inf'::DOUBLE)::DOUBLE AS quantile FROM km GROUP BY 1")
def km_median(spark, sf_dir):
    return survival.survival_quantile(survival.kaplan_meier(_times(spark, sf_dir), ["late"], "t", "e"), ["late"], "t", 0.5)


@query(f"""WITH {_TIMES}, g AS (SELECT late, t, count(*) FILTER (e) AS d, count(*) AS m FROM times GROUP BY 1, 2), tt AS (SELECT t, sum(d) AS dd, sum(m) AS mm FROM g GROUP BY 1), tn AS (SELECT *, sum(mm) OVER (ORDER BY t DESC) AS nn FROM tt),
f AS (SELECT l.late, tn.t, dd, nn, coalesce(d, 0) AS d, sum(coalesce(m, 0)) OVER (PARTITION BY l.late ORDER BY tn.t DESC) AS n FROM tn CROSS JOIN (SELECT DISTINCT late FROM g) l LEFT JOIN g ON g.late = l.late AND g.t = tn.t)
SELECT late, sum(d)::BIGINT AS observed, round(sum(dd * n / nn), 6) AS expected, round(sum(CASE WHEN nn > 1 THEN dd * n / nn * (1 - n / nn) * (nn - dd) / (nn - 1) ELSE 0 END), 6) AS variance FROM f WHERE dd > 0 GROUP BY 1""")
def logrank_counts(spark, sf_dir):
    return survival.logrank(_times(spark, sf_dir), "late", "t", "e").select("late", "observed", r6(F.col("expected")).alias("expected"), r6(F.col("variance")).alias("variance"))


@query()
def cox_regression(spark, sf_dir):
    x = _times(spark, sf_dir).select("t", "e", F.col("late").cast("double").alias("late"), (F.col("value") / 100).alias("value"))
    m = survival.cox(x, ["late", "value"], "t", "e")
    return spark.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(["late", "value"], m["coefficients"], m["se"])], "term string, coefficient double, se double")


@query()
def aft_regression(spark, sf_dir):
    x = _times(spark, sf_dir).select((F.col("t") + 0.5).alias("t"), "e", F.col("late").cast("double").alias("late"), (F.col("value") / 100).alias("value"))
    rows = []
    for law in ("weibull", "lognormal"):
        m = survival.aft(x, ["late", "value"], "t", "e", law)
        rows += [(law, n, float(b), float(s)) for n, b, s in zip(["constant", "late", "value"], m["coefficients"], m["se"])]
    return spark.createDataFrame(rows, "law string, term string, coefficient double, se double")


_DRAWS = 500


@query(f"""WITH {_TIMES}, draws AS (SELECT unnest(range(-1, {_DRAWS})) AS draw), users AS (SELECT DISTINCT user_id FROM times), w AS (SELECT draw, user_id, CASE WHEN draw < 0 THEN 1 ELSE {weight_sql(1, "draw", "user_id")} END AS w FROM draws, users),
own AS (SELECT user_id, t, sum(e::INT) AS d, count(*) AS m FROM times GROUP BY 1, 2), a AS (SELECT draw, t, sum(w * d) AS d, sum(w * m) AS m FROM own JOIN w USING (user_id) GROUP BY 1, 2), r AS (SELECT *, sum(m) OVER (PARTITION BY draw ORDER BY t DESC) AS n FROM a),
km AS (SELECT draw, t, CASE WHEN max((d >= n)::INT) OVER q = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER q) END AS s FROM r WHERE d > 0 WINDOW q AS (PARTITION BY draw ORDER BY t)),
f AS (SELECT draw, coalesce(min(t) FILTER (s <= 0.5 + 1e-12), 'inf'::DOUBLE)::DOUBLE AS q FROM km GROUP BY 1), l AS (SELECT list_sort(list(q) FILTER (draw >= 0)) AS x, max(q) FILTER (draw < 0) AS estimate FROM f)
SELECT estimate, x[floor((len(x) - 1) * 0.025 + 0.5)::INT + 1] AS lo, x[floor((len(x) - 1) * 0.975 + 0.5)::INT + 1] AS hi FROM l""")
def km_bootstrap(spark, sf_dir):
    """Median time to the next event, with its interval over resamples of users."""
    return survival.km_bootstrap(_times(spark, sf_dir), "user_id", "t", "e", 0.5, _DRAWS, 1)


# --- forecasts of the next event being an error -----------------------------

_FORECAST = """pairs AS (SELECT user_id, event_id, event_type AS now, hour(ts) // 6 AS part, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'error' AS y FROM events),
known AS (SELECT * FROM pairs WHERE y IS NOT NULL), base AS (SELECT avg(y::INT) AS p FROM known WHERE event_id % 2 = 1), law AS (SELECT now, part, (sum(y::INT) + 5 * any_value(base.p)) / (count(*) + 5) AS p FROM known, base WHERE event_id % 2 = 1 GROUP BY 1, 2),
f AS (SELECT round(law.p, 9) AS p, y FROM known JOIN law USING (now, part) WHERE event_id % 2 = 0)"""


def _forecast(spark, sf_dir) -> DataFrame:
    """Smoothed group shares learned on odd ids, applied to even ones."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    known = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("now"), F.floor(F.hour("ts") / 6).alias("part"), (F.lead("event_type").over(w) == "error").alias("y")).where("y is not null")
    odd = known.where("event_id % 2 = 1")
    base = odd.agg(F.avg(F.col("y").cast("int")).alias("b"))
    law = odd.groupBy("now", "part").agg(F.sum(F.col("y").cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(base)).select("now", "part", F.round((F.col("k") + 5 * F.col("b")) / (F.col("n") + 5), 9).alias("p"))
    return known.where("event_id % 2 = 0").join(F.broadcast(law), ["now", "part"]).select("p", "y")


@query(f"""WITH {_FORECAST}, g AS (SELECT (p >= 0.15)::INT + (p >= 0.2)::INT + (p >= 0.22)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y::INT) AS o FROM f GROUP BY 1)
SELECT bin, n, round(mp, 6) AS mean_p, round(o, 6) AS observed, round(CASE WHEN n >= 30 THEN (o + 3.8416 / (2 * n) - 1.96 * sqrt(o * (1 - o) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) END, 6) AS lo,
round(CASE WHEN n >= 30 THEN (o + 3.8416 / (2 * n) + 1.96 * sqrt(o * (1 - o) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) END, 6) AS hi FROM g""")
def calibration_reliability(spark, sf_dir):
    r = evaluate.reliability(_forecast(spark, sf_dir), "p", "y", [0, 0.15, 0.2, 0.22, 1])
    return r.select("bin", "n", *[r6(F.col(c)).alias(c) for c in ("mean_p", "observed", "lo", "hi")])


@query(f"""WITH {_FORECAST}, g AS (SELECT p, sum(y::INT) AS pos, sum(1 - y::INT) AS neg FROM f GROUP BY 1), u AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT (SELECT count(*) FROM f) AS n, (SELECT round(avg(pow(p - y::INT, 2)), 6) FROM f) AS brier, (SELECT round(avg(-(y::INT) * ln(p) - (1 - y::INT) * ln(1 - p)), 6) FROM f) AS log_loss, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM u""")
def binary_scores(spark, sf_dir):
    s = evaluate.binary_scores(_forecast(spark, sf_dir), "p", "y")
    return s.select("n", *[r6(F.col(c)).alias(c) for c in ("brier", "log_loss", "auc")])


@query("""WITH c AS (SELECT event_id, event_type, least(floor(value / 25), 7)::INT AS y FROM events), g AS (SELECT event_type, y, count(*) AS k FROM c WHERE event_id % 2 = 1 GROUP BY 1, 2), n AS (SELECT event_type, sum(k) AS n FROM g GROUP BY 1),
a AS (SELECT n.event_type, k.k, coalesce(g.k, 0) / n.n AS p FROM n CROSS JOIN (SELECT unnest(range(8)) AS k) k LEFT JOIN g ON g.event_type = n.event_type AND g.y = k.k), f AS (SELECT event_type, k, sum(p) OVER (PARTITION BY event_type ORDER BY k) AS f FROM a)
SELECT event_type, count(DISTINCT event_id) AS n, round(sum(pow(f - (y <= k)::INT, 2)) / count(DISTINCT event_id), 6) AS crps FROM c JOIN f USING (event_type) WHERE event_id % 2 = 0 AND k < 7 GROUP BY 1""")
def crps_table(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("event_id", "event_type", F.least(F.floor(F.col("value") / 25), F.lit(7)).cast("int").alias("y"))
    g = c.where("event_id % 2 = 1").groupBy("event_type").agg(*[F.avg((F.col("y") <= k).cast("double")).alias(f"f{k}") for k in range(8)])
    law = g.select("event_type", F.array(*[F.col(f"f{k}") for k in range(8)]).alias("cdf"))
    x = c.where("event_id % 2 = 0").join(F.broadcast(law), "event_type")
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(evaluate.crps(F.col("cdf"), F.col("y")))).alias("crps"))


# --- simulation: users are vehicles, a day's events their stops --------------


def _stops(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), F.col("user_id").alias("vehicle"), F.col("event_type").alias("place"), F.col("ts").alias("sched"), (F.col("value") / 20).alias("delay"), (F.col("value") > 150).alias("cancelled"), "event_id")
    w = W.partitionBy("day", "vehicle").orderBy("sched", "event_id")
    return e.withColumn("pos", F.row_number().over(w) - 1).drop("event_id")


@query()
def transition_law(spark, sf_dir):
    return simulate.learn(simulate.transitions(_stops(spark, sf_dir)))


@query()
def simulate_days(spark, sf_dir):
    stops = _stops(spark, sf_dir)
    law = simulate.learn(simulate.transitions(stops))
    return simulate.simulate(stops, law, 5, 7)


@query()
def scenario_effects(spark, sf_dir):
    """A closure of one place for two hours against the same draws without it."""
    stops = _stops(spark, sf_dir)
    law = simulate.learn(simulate.transitions(stops))
    closed = simulate.Scenario("closure", place="view", first=600, last=720, apart=3)
    return simulate.effects(simulate.simulate(stops, law, 5, 7), simulate.simulate(stops, law, 5, 7, closed))
