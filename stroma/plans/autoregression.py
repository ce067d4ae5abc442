"""Autoregressions of all orders, their certificates, tests of residuals, cross correlations and sensitivity on the test tables.

What plain SQL can't solve, it can check: at the right coefficients residuals are
orthogonal to every regressor, roots add up to a trace, shares to one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, micros
from stroma.functions.numbers import harmonics, r6
from stroma.operators import evaluate, grid, linear, ordered, var
from stroma.plans.base import query, table
from stroma.sources.tables import materialise
from stroma.plans.models import _FORECAST, _HOURLY, TYPES, _blocks, _detrended, _forecast, _hourly

_NAMES = {"types": TYPES, "halves": [f"{t}{k}" for t in TYPES for k in (0, 1)]}
_ENTITY = {"types": "event_type", "halves": "event_type || (user_id % 2)::VARCHAR"}


def _wide(spark, sf_dir, minutes: int, limit: int, least: int, of: str = "types") -> tuple[DataFrame, list[str]]:
    """Means by window, wide, interpolated, in episodes within days."""
    e = table(spark, sf_dir, "events")
    if of == "halves":
        e = e.withColumn("event_type", F.concat("event_type", (F.col("user_id") % 2).cast("string")))
    cells = grid.state_grid(e, "event_type", "ts", "value", minutes, 100.0).select("window", "event_type", "mean")
    filled = ordered.interpolate(cells, ["event_type"], ["window"], "mean", limit, "filled")
    wide = filled.groupBy("window").pivot("event_type", _NAMES[of]).agg(F.first("filled"))
    if len(_NAMES[of]) > 5:  # else the optimiser's constraints on the pivot of many series outgrow its memory
        wide = materialise(wide, "wide")
    return var.episodes(wide, _NAMES[of], "window", minutes, least), _NAMES[of]


def _episodes_sql(minutes: int, limit: int, least: int, of: str = "types") -> str:
    """The same episodes as SQL: ``ep`` (day, g, n)."""
    step = f"INTERVAL {minutes} MINUTES"
    return f"""axis AS (SELECT unnest(generate_series((SELECT time_bucket({step}, min(ts)) FROM events), (SELECT time_bucket({step}, max(ts)) FROM events), {step})) AS "window"), kinds AS (SELECT DISTINCT {_ENTITY[of]} AS e FROM events),
cells AS (SELECT time_bucket({step}, ts) AS "window", {_ENTITY[of]} AS e, avg(value) AS mean FROM events GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY "window") AS i FROM (SELECT * FROM axis, kinds) LEFT JOIN cells USING ("window", e)),
b AS (SELECT *, last_value(CASE WHEN mean IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, first_value(CASE WHEN mean IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni FROM g
 WINDOW p AS (PARTITION BY e ORDER BY i ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY e ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
w AS (SELECT "window" FROM b GROUP BY 1 HAVING count(*) FILTER (mean IS NOT NULL OR (pi IS NOT NULL AND ni IS NOT NULL AND i - pi <= {limit})) = {len(_NAMES[of])}),
bl AS (SELECT "window"::DATE AS day, epoch_us("window") // {minutes * 60 * MICROS} - row_number() OVER (PARTITION BY "window"::DATE ORDER BY "window") AS g FROM w), ep AS (SELECT day, g, count(*) AS n FROM bl GROUP BY 1, 2 HAVING count(*) >= {least})"""


@query(f"WITH {_episodes_sql(30, 6, 24)}, p AS (SELECT unnest(range(1, 21)) AS p) SELECT p::INT AS p, sum(greatest(n - p, 0))::BIGINT AS rows, (1 + 5 * p)::INT AS parameters, 0.0::DOUBLE AS score FROM ep, p GROUP BY 1, 3")
def var_orders(spark, sf_dir):
    """Orders 1 to 20 from one pass: rows and parameters of each, and the largest product of residuals and regressors, which is zero at the solution."""
    b, names = _wide(spark, sf_dir, 30, 6, 24)
    found = [m for m, _ in var.order_grid(b, names, 20) if np.isfinite(m.criteria()).all()]
    # the score is looked at for the order that the criterion picks, if there are rows enough for any
    score = round(_largest_score(b, min(found, key=lambda m: m.criteria()[1])), 6) + 0.0 if found else 0.0
    g = var.guarded(b, names, range(1, 21))
    return g.select(F.col("order").alias("p"), "rows", F.col("parameters").cast("int").alias("parameters"), F.lit(score).alias("score"))


def _largest_score(blocks: DataFrame, m: var.Model) -> float:
    design, x = var.lagged(blocks, m.series, m.order)
    rest = [(F.col(s) - sum((F.col(c) * float(m.coefficients[i, j]) for i, c in enumerate(x)), F.lit(0.0))).alias(f"_e{j}") for j, s in enumerate(m.series)]
    g = linear.gram_matrix(design.select(*x, *rest), [*x, *[f"_e{j}" for j in range(len(m.series))]])
    size = np.sqrt(np.outer(np.diag(g)[: len(x)], np.diag(g)[len(x) :]))
    return float(np.abs(g[: len(x), len(x) :] / size).max())


_CHECKS = ["residuals are orthogonal to the lags", "roots add up to the trace", "roots multiply to the determinant", "variance shares add up to one", "first responses are a factor of the covariance", "responses follow the recursion"]


@query("SELECT unnest([" + ", ".join(f"'{c}'" for c in _CHECKS) + "]) AS law, 0.0::DOUBLE AS error")
def var_certificates(spark, sf_dir):
    """How far the model of order 2 is from the laws it must obey: zero."""
    b = _blocks(spark, sf_dir)
    m = var.fit_var(b, TYPES, 2)
    roots = np.array([complex(r["real"], r["imag"]) for r in m.roots(180)])
    a, r = m.companion(), m.responses(6)
    shares = var.variance_shares(r, 6)
    follows = max(np.abs(r[s] - sum(m.lag(k) @ r[s - k] for k in range(1, min(s, 2) + 1))).max() for s in range(1, 7))
    errors = [_largest_score(b, m), abs(roots.sum() - np.trace(a)), abs(np.prod(roots) - np.linalg.det(a)), np.abs(shares.sum(1) - 1).max(), np.abs(r[0] @ r[0].T - m.sigma).max() / np.abs(m.sigma).max(), follows / np.abs(r).max()]
    return spark.createDataFrame([(c, round(float(e), 6) + 0.0) for c, e in zip(_CHECKS, errors)], "law string, error double")


_DETREND_TERMS = 15


@query(f"WITH {_HOURLY} SELECT event_type, i::INT AS term, count(*) AS n, 0.0::DOUBLE AS product FROM hourly, (SELECT unnest(range({_DETREND_TERMS})) AS i) GROUP BY 1, 2")
def fourier_certificates(spark, sf_dir):
    """Products of the detrended series with the constant and every harmonic, a row: zero."""
    rest = _detrended(spark, sf_dir)[0]
    terms = [F.lit(1.0), *harmonics(F.col("hours"), [(24.0, 4), (168.0, 3)])]
    long = rest.select("event_type", F.posexplode(F.array(*[F.col("residual") * t for t in terms])).alias("term", "_p"))
    return long.groupBy("event_type", "term").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("_p"), 6) + 0.0).alias("product")).withColumn("product", F.abs("product"))


@query(f"WITH {_HOURLY} SELECT event_type, daily::INT AS daily, weekly::INT AS weekly, count(*) AS n, (1 + 2 * daily + 2 * weekly)::INT AS parameters, TRUE AS nested FROM hourly, (SELECT unnest([1, 2, 4]) AS daily), (SELECT unnest([0, 1, 3]) AS weekly) GROUP BY 1, 2, 3, 5")
def harmonic_grid(spark, sf_dir):
    """Fits by numbers of daily and weekly harmonics; with more of them the variance never grows (``nested``)."""
    h = _hourly(spark, sf_dir)
    terms = {("d", k): x for k, x in enumerate(harmonics(F.col("hours"), [(24.0, 4)]))} | {("w", k): x for k, x in enumerate(harmonics(F.col("hours"), [(168.0, 3)]))}
    wide = h.withColumns({f"{a}{k}": x for (a, k), x in terms.items()})
    designs = {f"{d}|{w}": [*[f"d{k}" for k in range(2 * d)], *[f"w{k}" for k in range(2 * w)]] for d in (1, 2, 4) for w in (0, 1, 3)}
    fits = linear.nested_fits(wide, "event_type", "mean", designs).collect()  # nine rows a type
    found = {(r["event_type"], *map(int, r["design"].split("|"))): (r["n"], r["variance"], r["bic"]) for r in fits}
    fewer = {2: 1, 4: 2, 1: 1}
    less = {0: 0, 1: 0, 3: 1}
    rows = [(t, d, w, n, 1 + 2 * d + 2 * w, bool(v <= found[t, fewer[d], w][1] + 1e-9 and v <= found[t, d, less[w]][1] + 1e-9)) for (t, d, w), (n, v, _) in found.items()]
    return spark.createDataFrame(rows, "event_type string, daily int, weekly int, n long, parameters int, nested boolean")


@query(f"WITH {_episodes_sql(180, 2, 3, 'halves')}, p AS (SELECT unnest(range(1, 6)) AS p), r AS (SELECT p, sum(greatest(n - p, 0))::BIGINT AS rows FROM ep, p GROUP BY 1) SELECT p::INT AS \"order\", rows, (10 * p + 1)::BIGINT AS parameters, round(rows / (10 * p + 1), 6) AS ratio, rows / (10 * p + 1) > 3 AS allowed FROM r")
def joint_guard(spark, sf_dir):
    """All series of both halves together: whether the rows are enough for the parameters."""
    b, names = _wide(spark, sf_dir, 180, 2, 3, "halves")
    return var.guarded(b, names, range(1, 6)).withColumn("ratio", r6(F.col("ratio")))


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_episodes_sql(m, limit, least)} SELECT {m} AS minutes, {limit} AS fill_limit, {least} AS least, count(*) AS episodes, coalesce(sum(n), 0)::BIGINT AS rows FROM ep)" for m, limit, least in ((180, 0, 3), (180, 2, 6), (60, 2, 6), (60, 6, 12))))
def sensitivity_of_episodes(spark, sf_dir):
    """How many episodes and rows are left under other windows, gaps filled and least lengths."""
    out = None
    for m, limit, least in ((180, 0, 3), (180, 2, 6), (60, 2, 6), (60, 6, 12)):
        b, _ = _wide(spark, sf_dir, m, limit, least)
        one = b.agg(F.count_distinct("episode").alias("episodes"), F.count(F.lit(1)).alias("rows")).select(F.lit(m).alias("minutes"), F.lit(limit).alias("fill_limit"), F.lit(least).alias("least"), "episodes", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_episodes_sql(60, 2, 3)} SELECT CASE WHEN n <= 6 THEN 'to 6' WHEN n <= 12 THEN 'to 12' ELSE 'longer' END AS length, count(*) AS episodes, sum(n)::BIGINT AS rows, round(sum(n) / (SELECT sum(n) FROM ep), 6) AS weight FROM ep GROUP BY 1")
def episode_weights(spark, sf_dir):
    """Share of the rows in short, middle and long episodes."""
    from stroma.functions.numbers import cut

    b, _ = _wide(spark, sf_dir, 60, 2, 3)
    n = b.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy(cut(F.col("n"), [-float("inf"), 6, 12, float("inf")], ["to 6", "to 12", "longer"]).alias("length")).agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("rows"))
    return g.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("length", "episodes", "rows", r6(F.col("rows") / F.col("_all")).alias("weight"))


_HOURS_WIDE = "h AS (SELECT date_trunc('hour', ts) AS w, " + ", ".join(f"avg(value) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1)"
_LAG_PAIRS = [("click", "view"), ("purchase", "view"), ("error", "click")]


@query(f"WITH {_HOURS_WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {k} AS lag, count(*) AS n, round(corr(x, y), 6) AS r FROM (SELECT {a} AS x, {'lag' if k >= 0 else 'lead'}({b}, {abs(k)}) OVER (PARTITION BY w::DATE ORDER BY w) AS y FROM h) WHERE x IS NOT NULL AND y IS NOT NULL" for a, b in _LAG_PAIRS for k in range(-2, 3)))
def lag_cross_check(spark, sf_dir):
    """Correlations of pairs of hourly series at lags from two hours before to two after, within days."""
    h = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("w")).pivot("event_type", TYPES).agg(F.avg("value")).withColumn("day", F.col("w").cast("date"))
    return var.cross_correlation(h, ["day"], "w", _LAG_PAIRS, range(-2, 3)).withColumn("r", r6(F.col("r")))


@query(f"""WITH {_HOURLY}, d AS (SELECT event_type, "window"::DATE AS day, mean - lag(mean) OVER w AS d, lag(mean) OVER w AS y, count(*) OVER (PARTITION BY event_type, "window"::DATE) AS many FROM hourly WINDOW w AS (PARTITION BY event_type, "window"::DATE ORDER BY "window")),
s AS (SELECT event_type, day, count(*) AS n, regr_slope(d, y) AS b, regr_syy(d, y) AS syy, regr_sxx(d, y) AS sxx, regr_r2(d, y) AS r2 FROM d WHERE many >= 12 AND d IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)
SELECT event_type, day, n, round(b / sqrt(syy * (1 - r2) / (n - 2) / sxx), 4) AS statistic, b / sqrt(syy * (1 - r2) / (n - 2) / sxx) < -2.86 AS rejected_at_5 FROM s""")
def unit_roots(spark, sf_dir):
    """Dickey-Fuller statistics of each long enough day and type."""
    h = _hourly(spark, sf_dir).withColumn("day", F.col("window").cast("date"))
    return var.unit_root(h, ["event_type", "day"], "window", "mean", 0, 12).withColumn("statistic", F.round("statistic", 4))


@query(f"""WITH {_HOURLY}, c AS (SELECT event_type, "window", "window"::DATE AS day, mean - avg(mean) OVER (PARTITION BY event_type) AS e FROM hourly), l AS (SELECT event_type, e * e AS e2, lag(e * e) OVER (PARTITION BY event_type, day ORDER BY "window") AS b2 FROM c)
SELECT event_type, count(*) AS n, round(count(*) * pow(corr(e2, b2), 2), 6) AS lm FROM l WHERE b2 IS NOT NULL GROUP BY 1""")
def arch_effects(spark, sf_dir):
    """Whether large deviations follow large ones."""
    h = _hourly(spark, sf_dir).withColumn("day", F.col("window").cast("date"))
    m = h.groupBy("event_type").agg(F.avg("mean").alias("_m"))
    e = h.join(m, "event_type").withColumn("e", F.col("mean") - F.col("_m"))
    return var.arch_lm(e, ["event_type"], ["day"], "window", "e").withColumn("lm", r6(F.col("lm")))


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS mean FROM events GROUP BY 1, 2), m AS (SELECT event_type, median(mean) AS m FROM d GROUP BY 1), s AS (SELECT event_type, median(abs(mean - m)) AS s FROM d JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, day, round(mean, 6) AS mean, round((mean - m) / s, 6) AS deviation, abs((mean - m) / s) > 3 AS odd FROM d JOIN m USING (event_type) JOIN s USING (event_type)""")
def anomaly_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return var.odd_days(e, ["event_type"], "day", "value").withColumns({c: r6(F.col(c)) for c in ("mean", "deviation")})


@query(f"""WITH {_HOURLY}, m AS (SELECT event_type, avg(mean) AS mu FROM hourly GROUP BY 1), f AS (SELECT unnest([20, 48, 24]::DOUBLE[]) AS period)
SELECT event_type, period, round(sqrt(pow(avg((mean - mu) * cos(2 * pi() * hours / period)), 2) + pow(avg((mean - mu) * sin(2 * pi() * hours / period)), 2)), 6) AS amplitude FROM hourly JOIN m USING (event_type) CROSS JOIN f GROUP BY 1, 2""")
def oscillation_placebo(spark, sf_dir):
    """Amplitude at periods nobody expects beside the daily one."""
    h = _hourly(spark, sf_dir)
    m = h.groupBy("event_type").agg(F.avg("mean").alias("mu"))
    x = h.join(m, "event_type").select("event_type", "hours", (F.col("mean") - F.col("mu")).alias("c"), F.explode(F.array(*[F.lit(p) for p in (20.0, 48.0, 24.0)])).alias("period"))
    angle = 2 * np.pi * F.col("hours") / F.col("period")
    return x.groupBy("event_type", "period").agg(r6(F.sqrt(F.pow(F.avg(F.col("c") * F.cos(angle)), 2) + F.pow(F.avg(F.col("c") * F.sin(angle)), 2))).alias("amplitude"))


@query(f"""WITH {_HOURLY}, x AS (SELECT event_type, "window", mean, lag(mean, 1) OVER w AS h1, lag(mean, 5) OVER w AS h5 FROM hourly WINDOW w AS (PARTITION BY event_type, "window"::DATE ORDER BY "window")), l AS (SELECT event_type, CASE WHEN day("window") <= 15 THEN 'first' ELSE 'second' END AS half, unnest([1, 5]) AS horizon, mean, unnest([h1, h5]) AS f FROM x)
SELECT event_type, half, horizon::INT AS horizon, count(*) AS n, round(avg(abs(f - mean)), 6) AS mae, round(sqrt(avg(pow(f - mean, 2))), 6) AS rmse, round(avg(f - mean), 6) AS bias FROM l WHERE f IS NOT NULL GROUP BY 1, 2, 3""")
def walk_errors_by_half(spark, sf_dir):
    """Errors of the random walk one and five hours ahead, in both halves of the month."""
    from pyspark.sql import Window as W

    h = _hourly(spark, sf_dir)
    w = W.partitionBy("event_type", F.col("window").cast("date")).orderBy("window")
    x = h.withColumn("h1", F.lag("mean", 1).over(w)).withColumn("h5", F.lag("mean", 5).over(w))
    half = F.when(F.dayofmonth("window") <= 15, "first").otherwise("second").alias("half")
    long = x.select("event_type", half, "mean", F.explode(F.array(F.struct(F.lit(1).alias("horizon"), F.col("h1").alias("f")), F.struct(F.lit(5).alias("horizon"), F.col("h5").alias("f")))).alias("c")).select("event_type", "half", "mean", "c.*")
    return evaluate.point_errors(long, ["event_type", "half", "horizon"], "f", "mean").select("event_type", "half", "horizon", "n", *[r6(F.col(c)).alias(c) for c in ("mae", "rmse", "bias")])


@query("SELECT unnest(['slope', 'offset']) AS term, 0.0::DOUBLE AS score")
def platt_certificates(spark, sf_dir):
    """The score of the calibration a row: zero at the reported line."""
    f = _forecast(spark, sf_dir)
    a, b = evaluate.platt(f, "p", "y")
    z = F.log(F.col("p") / (1 - F.col("p")))
    r = f.select(z.alias("z"), (F.col("y").cast("double") - 1 / (1 + F.exp(-(z * a + b)))).alias("r")).agg(F.avg(F.col("r") * F.col("z")).alias("s"), F.avg("r").alias("o")).first()
    return spark.createDataFrame([("slope", abs(round(r["s"], 8))), ("offset", abs(round(r["o"], 8)))], "term string, score double")


_EACH = "list_sum(list_transform(range(1, len(z) + 1), lambda i: {0}))"
_Q = "(1 / (1 + exp(-(a * z[i] + b))))"


@query(f"""WITH RECURSIVE {_FORECAST}, bins AS (SELECT ln(p / (1 - p)) AS z, count(*) AS n, sum(y::INT) AS k FROM f GROUP BY p), l AS (SELECT list(z ORDER BY z) AS z, list(n ORDER BY z) AS n, list(k ORDER BY z) AS k FROM bins),
newton(step, a, b) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT step + 1, a + (s0 * h11 - s1 * h01) / (h00 * h11 - h01 * h01), b + (s1 * h00 - s0 * h01) / (h00 * h11 - h01 * h01) FROM
(SELECT step, a, b, {_EACH.format(f"(k[i] - n[i] * {_Q}) * z[i]")} AS s0, {_EACH.format(f"k[i] - n[i] * {_Q}")} AS s1, {_EACH.format(f"n[i] * {_Q} * (1 - {_Q}) * z[i] * z[i]")} AS h00, {_EACH.format(f"n[i] * {_Q} * (1 - {_Q}) * z[i]")} AS h01, {_EACH.format(f"n[i] * {_Q} * (1 - {_Q})")} AS h11 FROM newton, l WHERE step < 30))
SELECT round(a, 5) AS slope, round(b, 5) AS "offset" FROM newton WHERE step = 30""")
def platt_line(spark, sf_dir):
    """The calibration's line itself; the SQL takes thirty Newton steps on the distinct forecasts."""
    a, b = evaluate.platt(_forecast(spark, sf_dir), "p", "y")
    return spark.createDataFrame([(round(float(a), 5), round(float(b), 5))], "slope double, offset double")


@query("""WITH l AS (SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv, lag(event_type) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS (SELECT event_type, pt, value - pv AS d, epoch_us(ts) - epoch_us(pts) <= 3600000000 AS near FROM l WHERE pts IS NOT NULL)
SELECT 'neighbours' AS part, near, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM p GROUP BY 2 UNION ALL SELECT 'line', NULL, count(*), round(avg(t - f), 6), round(stddev_samp(t - f), 6) FROM (SELECT arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS t FROM events GROUP BY user_id, ts::DATE HAVING count(*) >= 2)""")
def increments(spark, sf_dir):
    """Changes from neighbour to neighbour, near or far in time, and along the whole line of a day."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    p = ordered.lag_pairs(e, ["user_id"], ["ts", "event_id"], ["ts", "value"])
    d = F.col("value") - F.col("value_prev")
    stats = lambda c: [F.count(F.lit(1)).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("sd")]
    a = p.groupBy((micros("ts") - micros("ts_prev") <= 3600 * MICROS).alias("near")).agg(*stats(d)).select(F.lit("neighbours").alias("part"), "near", "n", "mean", "sd")
    key = F.struct("ts", "event_id")
    line = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("k"), (F.max_by("value", key) - F.min_by("value", key)).alias("d")).where("k >= 2")
    return a.unionByName(line.agg(*stats(F.col("d"))).select(F.lit("line").alias("part"), F.lit(None).cast("boolean").alias("near"), "n", "mean", "sd"))


@query(f"""WITH c AS (SELECT date_trunc('hour', ts) AS w, event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, sum(m * n) / sum(n) AS typical FROM c GROUP BY 1),
r AS (SELECT w, sum(n * m) / sum(n) - sum(n * typical) / sum(n) AS r FROM c JOIN t USING (event_type) GROUP BY 1), x AS (SELECT w::DATE AS day, w, r - avg(r) OVER q AS c, var_pop(r) OVER q AS v, count(*) OVER q AS n FROM r WINDOW q AS (PARTITION BY w::DATE)),
l AS (SELECT day, v, n, lag, sum(c * p) AS s FROM (SELECT *, CASE lag {" ".join(f"WHEN {k} THEN lag(c, {k}) OVER q" for k in range(5))} END AS p FROM x CROSS JOIN (SELECT unnest(range(5)) AS lag) WINDOW q AS (PARTITION BY day, lag ORDER BY w)) GROUP BY ALL)
SELECT lag::INT AS lag, sum(n - lag)::BIGINT AS n, round(sum(s / v) / sum(n - lag), 6) AS acf FROM l WHERE v > 0 AND n > lag GROUP BY 1""")
def mixture_residual_acf(spark, sf_dir):
    """Autocorrelation of what is left when each hour's mix of types is expected at the types' own means."""
    c = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("w"), "event_type").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    t = c.groupBy("event_type").agg((F.sum("s") / F.sum("n")).alias("typical"))
    r = c.join(F.broadcast(t), "event_type").groupBy("w").agg((F.sum("s") / F.sum("n") - F.sum(F.col("n") * F.col("typical")) / F.sum("n")).alias("r")).withColumn("day", F.col("w").cast("date"))
    return var.pooled_acf(r, ["day"], "w", "r", 4).withColumn("acf", r6(F.col("acf")))
