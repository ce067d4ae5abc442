"""Criteria of joint models, forecasts against baselines, and unit roots with chosen lags on the test tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.functions.numbers import harmonics
from stroma.operators import linear, var
from stroma.plans.autoregression import _NAMES, _episodes_sql, _wide
from stroma.plans.base import query
from stroma.plans.elimination import coefficients, eliminated, products
from stroma.plans.models import _HOURLY, _hourly


def _rows_sql(minutes: int, limit: int, least: int, of: str, series: list[str]) -> str:
    """CTEs up to ``wide`` ("window", day, g, step, a column a series): the episodes' interpolated values."""
    value = "CASE WHEN mean IS NOT NULL THEN mean WHEN pi IS NOT NULL AND ni IS NOT NULL AND i - pi <= {0} THEN pm + (nm - pm) * (i - pi) / (ni - pi) END".format(limit)
    columns = ", ".join(f"max(v) FILTER (e = '{s}') AS {s}" for s in series)
    text = _episodes_sql(minutes, limit, least, of).replace(
        "first_value(CASE WHEN mean IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni FROM g",
        "first_value(CASE WHEN mean IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni, last_value(mean IGNORE NULLS) OVER p AS pm, first_value(mean IGNORE NULLS) OVER q AS nm FROM g",
    )
    return f"""{text},
filled AS (SELECT "window", {columns} FROM (SELECT "window", e, {value} AS v FROM b) GROUP BY 1),
placed AS (SELECT *, epoch_us("window") // {minutes * 60 * 1_000_000} - row_number() OVER (PARTITION BY "window"::DATE ORDER BY "window") AS g FROM filled JOIN w USING ("window")),
wide AS (SELECT placed.*, placed."window"::DATE AS day, row_number() OVER (PARTITION BY ep.day, ep.g ORDER BY "window") AS step FROM placed JOIN ep ON ep.day = placed."window"::DATE AND ep.g = placed.g)"""


def _criteria_sql(minutes: int, limit: int, least: int, of: str, series: list[str], orders: list[int]) -> str:
    n, most = len(series), max(orders)
    lags = [f"{s}_{k}" for k in range(1, most + 1) for s in series]
    lagged = ", ".join(f"lag({s}, {k}) OVER e AS {s}_{k}" for k in range(1, most + 1) for s in series)
    first_y = 1 + n * most
    grams, cut = [], []
    for p in orders:
        grams.append(products(f"(SELECT * FROM lagged WHERE step > {p})", f"{p} AS p", ["1", *lags[: n * p], *["0"] * (n * (most - p)), *series], f"g{p}"))
        cut.append(f"SELECT * FROM g{p} WHERE (i < {1 + n * p} OR i >= {first_y}) AND (j < {1 + n * p} OR j >= {first_y})")
    sweep = eliminated("base", ["p"], [*range(first_y + n)], "s")
    return f"""WITH {_rows_sql(minutes, limit, least, of, series)}, lagged AS (SELECT *, {lagged} FROM wide WINDOW e AS (PARTITION BY day, g ORDER BY step)), {", ".join(grams)}, base AS ({" UNION ALL ".join(cut)}), {", ".join(sweep)},
t AS (SELECT p, any_value(v) AS t FROM base WHERE i = 0 AND j = 0 GROUP BY 1), dets AS (SELECT p, sum(ln(v)) FILTER (k >= {first_y} AND v > 0) AS d FROM s_pivots GROUP BY 1),
c AS (SELECT p, t, 1 + {n} * p AS m, CASE WHEN t > 1 + {n} * p THEN d - {n} * ln(t) END AS log_det FROM t JOIN dets USING (p))
SELECT p::INT AS "order", t::BIGINT AS rows, m::INT AS parameters, round(log_det, 5) AS log_det, round(log_det + 2 / t * {n} * m, 5) AS aic, round(log_det + ln(t) / t * {n} * m, 5) AS bic FROM c"""


def _criteria(blocks: DataFrame, series: list[str], orders: list[int]) -> DataFrame:
    got = var.order_criteria(blocks, series, orders)
    return got.select("order", "rows", "parameters", *[F.round(c, 5).alias(c) for c in ("log_det", "aic", "bic")])


_PAIR, _ORDERS = ["click", "view"], [1, 2, 3, 4]


@query(_criteria_sql(180, 2, 5, "types", _PAIR, _ORDERS))
def var_order_criteria(spark, sf_dir):
    """Determinant, AIC and BIC of a pair's model at each order, all from one table of sums."""
    b, _ = _wide(spark, sf_dir, 180, 2, 5)
    return _criteria(b, _PAIR, _ORDERS)


@query(_criteria_sql(180, 2, 3, "halves", _NAMES["halves"], [1, 2]))
def joint_criteria(spark, sf_dir):
    """The same of all series of both halves together."""
    b, names = _wide(spark, sf_dir, 180, 2, 3, "halves")
    return _criteria(b, names, [1, 2])


# --- forecasts --------------------------------------------------------------

_AHEAD = 5
_SPLIT = "CASE WHEN day(\"window\") <= 15 THEN 'first' ELSE 'second' END"


@query(f"""WITH RECURSIVE {_rows_sql(180, 2, 5, "types", _PAIR)}, r AS (SELECT *, {_SPLIT} AS half, lag(click) OVER e AS x1, lag(view) OVER e AS x2 FROM wide WINDOW e AS (PARTITION BY day, g ORDER BY step)), fitting AS (SELECT * FROM r WHERE x1 IS NOT NULL),
m AS (SELECT half, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, avg(click) AS ma, avg(view) AS mb, covar_pop(x1, click) AS a1, covar_pop(x2, click) AS a2, covar_pop(x1, view) AS b1, covar_pop(x2, view) AS b2 FROM fitting GROUP BY 1),
c AS (SELECT half, (a1 * s22 - a2 * s12) / (s11 * s22 - s12 * s12) AS aa, (a2 * s11 - a1 * s12) / (s11 * s22 - s12 * s12) AS ab, (b1 * s22 - b2 * s12) / (s11 * s22 - s12 * s12) AS ba, (b2 * s11 - b1 * s12) / (s11 * s22 - s12 * s12) AS bb, m1, m2, ma, mb FROM m),
law AS (SELECT half, aa, ab, ba, bb, ma - aa * m1 - ab * m2 AS a0, mb - ba * m1 - bb * m2 AS b0 FROM c),
f(day, g, step, tested, h, fa, fb) AS (SELECT day, g, step, half, 0, click, view FROM r UNION ALL SELECT f.day, f.g, step, tested, h + 1, a0 + aa * fa + ab * fb, b0 + ba * fa + bb * fb FROM f JOIN law ON law.half <> f.tested WHERE h < {_AHEAD}),
means AS (SELECT half, isodow("window") AS wd, hour("window") AS hr, avg(click) AS click, avg(view) AS view FROM r GROUP BY 1, 2, 3),
e AS (SELECT f.tested AS half, h AS horizon, unnest(['click', 'view']) AS series, unnest([t.click - fa, t.view - fb]) AS e, unnest([t.click - o.click, t.view - o.view]) AS w, unnest([t.click - means.click, t.view - means.view]) AS m
FROM f JOIN r o USING (day, g, step) JOIN r t ON t.day = f.day AND t.g = f.g AND t.step = f.step + h LEFT JOIN means ON means.half <> f.tested AND wd = isodow(t."window") AND hr = hour(t."window") WHERE h IN (1, {_AHEAD}))
SELECT half, series, horizon::INT AS horizon, count(*) AS n, {", ".join(f"round(sqrt(avg({x} * {x})), 5) AS rmse_{c}, round(avg(abs({x})), 5) AS mae_{c}" for x, c in (("e", "var"), ("w", "walk"), ("m", "mean")))} FROM e GROUP BY 1, 2, 3""")
def forecast_by_half(spark, sf_dir):
    """Recursive forecasts one and five steps ahead in each half of the month by the other half's model, against the last value and the mean of the weekday and hour."""
    b, _ = _wide(spark, sf_dir, 180, 2, 5)
    half = lambda first: b.where((F.dayofmonth("window") <= 15) == F.lit(first))
    out = None
    for name, first in (("first", True), ("second", False)):
        one = var.forecast_scores(half(not first), half(first), _PAIR, "window", 180, 1, [1, _AHEAD], [F.lit(name).alias("half")])
        out = one if out is None else out.unionByName(one)
    return out.select("half", "series", "horizon", "n", *[F.round(f"{k}_{c}", 5).alias(f"{k}_{c}") for c in ("var", "walk", "mean") for k in ("rmse", "mae")])


# --- unit roots -------------------------------------------------------------

_MOST = 2


def _unit_root_sql() -> str:
    """Variables: 0 the constant, 1 and 2 lagged differences, 8 the level before, 9 the difference; AIC on the common rows, the statistic on all rows of the chosen regression."""
    parts = []
    for k in range(_MOST + 1):
        columns = ["1", *[f"d{j}" for j in range(1, k + 1)], "y", "d"]
        names = [0, *range(1, k + 1), 8, 9]
        where = {"c": f"nth > {_MOST}", "f": f"nth > {k}"}
        for kind, rows in where.items():
            parts.append(products(f"(SELECT * FROM lagged WHERE {rows})", f"event_type, day, {k} AS lags", columns, f"{kind}{k}"))
            renamed = "CASE {0} " + " ".join(f"WHEN {a} THEN {b}" for a, b in enumerate(names)) + " END"
            parts.append(f"{kind}{k}r AS (SELECT event_type, day, lags, {renamed.format('i')} AS i, {renamed.format('j')} AS j, v FROM {kind}{k})")
    keys = ["event_type", "day", "lags"]
    for kind in "cf":
        parts.append(f"{kind}base AS ({' UNION ALL '.join(f'SELECT * FROM {kind}{k}r' for k in range(_MOST + 1))})")
        parts += eliminated(f"{kind}base", keys, [0, *range(1, _MOST + 1)], f"{kind}s")
    last = _MOST + 1
    pick = lambda kind, i, j: f"any_value(v) FILTER (i = {i} AND j = {j})"
    return f"""WITH {_HOURLY}, o AS (SELECT event_type, "window"::DATE AS day, "window", mean, lag(mean) OVER q AS y, mean - lag(mean) OVER q AS d, count(*) OVER (PARTITION BY event_type, "window"::DATE) AS many FROM hourly WINDOW q AS (PARTITION BY event_type, "window"::DATE ORDER BY "window")),
lagged AS (SELECT *, {", ".join(f"coalesce(lag(d, {k}) OVER q, 0) AS d{k}" for k in range(1, _MOST + 1))}, row_number() OVER q AS nth FROM o WHERE many >= 12 AND y IS NOT NULL WINDOW q AS (PARTITION BY event_type, day ORDER BY "window")),
{", ".join(parts)},
cn AS (SELECT event_type, day, lags, any_value(v) AS n FROM cbase WHERE i = 0 AND j = 0 GROUP BY 1, 2, 3), fn AS (SELECT event_type, day, lags, any_value(v) AS n FROM fbase WHERE i = 0 AND j = 0 GROUP BY 1, 2, 3),
ca AS (SELECT event_type, day, lags, {pick("c", 9, 9)} - pow({pick("c", 8, 9)}, 2) / {pick("c", 8, 8)} AS rest FROM cs{last} GROUP BY 1, 2, 3),
ranked AS (SELECT event_type, day, lags, row_number() OVER (PARTITION BY event_type, day ORDER BY round(n * ln(rest / n) + 2 * (2 + lags), 9), lags) AS k FROM ca JOIN cn USING (event_type, day, lags) WHERE n > 2 + lags),
st AS (SELECT event_type, day, lags, {pick("f", 8, 8)} AS yy, {pick("f", 8, 9)} AS yd, {pick("f", 9, 9)} AS dd FROM fs{last} GROUP BY 1, 2, 3),
s AS (SELECT event_type, day, n, lags, yd / yy / sqrt((dd - yd * yd / yy) / (n - 2 - lags) / yy) AS s FROM st JOIN fn USING (event_type, day, lags) JOIN (SELECT * FROM ranked WHERE k = 1) USING (event_type, day, lags))
SELECT event_type, day, n::BIGINT AS n, lags::INT AS lags, round(s, 4) AS statistic, CASE WHEN s < -3.43035 - 6.5393 / n - 16.786 / pow(n, 2) - 79.433 / pow(n, 3) THEN 'below 0.01' WHEN s < -2.86154 - 2.8903 / n - 4.234 / pow(n, 2) - 40.04 / pow(n, 3) THEN 'to 0.05' WHEN s < -2.56677 - 1.5384 / n - 2.809 / pow(n, 2) THEN 'to 0.10' ELSE 'above 0.10' END AS p_range FROM s"""


@query(_unit_root_sql())
def unit_root_lags(spark, sf_dir):
    """Augmented Dickey-Fuller tests with lags chosen by AIC of each long enough day and type."""
    h = _hourly(spark, sf_dir).withColumn("day", F.col("window").cast("date"))
    return var.unit_root_lags(h, ["event_type", "day"], "window", "mean", _MOST, 12).withColumn("statistic", F.round("statistic", 4))


# --- numbers of harmonics ---------------------------------------------------

_DAILY, _WEEKLY = (1, 2, 4), (0, 1, 3)


def _harmonic_sql() -> str:
    """All designs are cut out of one matrix; a design's variance is what is left of the last variable when its own regressors are eliminated."""
    terms = [f"{f}(hours * {2 * math.pi * k / p!r})" for p, many in ((24.0, 4), (168.0, 3)) for k in range(1, many + 1) for f in ("sin", "cos")]
    y = len(terms) + 1
    cut = []
    for d in _DAILY:
        for w in _WEEKLY:
            at = ", ".join(str(k) for k in [0, *range(1, 2 * d + 1), *range(9, 9 + 2 * w), y])
            cut.append(f"SELECT event_type, {d} AS daily, {w} AS weekly, i, j, v FROM every WHERE i IN ({at}) AND j IN ({at})")
    sweep = eliminated("base", ["event_type", "daily", "weekly"], [*range(y)], "s")
    return f"""WITH {_HOURLY}, {products("hourly", "event_type", ["1", *terms, "mean"], "every")}, base AS ({" UNION ALL ".join(cut)}), {", ".join(sweep)},
n AS (SELECT event_type, any_value(v) AS n FROM every WHERE i = 0 AND j = 0 GROUP BY 1), f AS (SELECT event_type, daily, weekly, n, 1 + 2 * daily + 2 * weekly AS k, v / n AS var FROM s{y} JOIN n USING (event_type) WHERE i = {y} AND j = {y})
SELECT event_type, daily::INT AS daily, weekly::INT AS weekly, n::BIGINT AS n, k::INT AS parameters, CASE WHEN n > k THEN round(var, 5) END AS variance, CASE WHEN n > k THEN round(n * ln(var) + 2 * k, 4) END AS aic, CASE WHEN n > k THEN round(n * ln(var) + k * ln(n), 4) END AS bic FROM f"""


@query(_harmonic_sql())
def harmonic_orders(spark, sf_dir):
    """Variance, AIC and BIC by numbers of daily and weekly harmonics, from one table of sums."""
    h = _hourly(spark, sf_dir)
    named = {f"{a}{k}": x for a, period, many in (("d", 24.0, 4), ("w", 168.0, 3)) for k, x in enumerate(harmonics(F.col("hours"), [(period, many)]))}
    designs = {f"{d}|{w}": [*[f"d{k}" for k in range(2 * d)], *[f"w{k}" for k in range(2 * w)]] for d in _DAILY for w in _WEEKLY}
    got = linear.nested_fits(h.withColumns(named), "event_type", "mean", designs)
    part = lambda k: F.get(F.split("design", r"\|"), F.lit(k)).cast("int")
    return got.select("event_type", part(0).alias("daily"), part(1).alias("weekly"), "n", "parameters", F.round("variance", 5).alias("variance"), F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"))


# --- oscillations -----------------------------------------------------------

#: Harmonics that are taken out before the model is fitted, and periods that are tried besides, in hours.
_USUAL, _EXTRA = [(24.0, 1)], [4.0, 9.6]


def _oscillation_sql() -> str:
    terms = [f"{f}(hours * {2 * math.pi / p!r})" for p in (24.0, *_EXTRA) for f in ("sin", "cos")]
    parts = [products("hourly", "event_type", ["1", *terms, "mean"], "every")]
    y = len(terms) + 1
    parts += coefficients("every", ["event_type"], [*range(y)], y, "w1")
    parts.append(f"few AS (SELECT * FROM every WHERE (i < 3 OR i = {y}) AND (j < 3 OR j = {y}))")
    parts += coefficients("few", ["event_type"], [0, 1, 2], y, "w0")
    line = "list_sum(list_transform(range(len(b)), lambda k: b[k + 1] * x[k + 1]))"
    both = " UNION ALL ".join(f"SELECT {n} AS variant, event_type, list(b ORDER BY i) AS b FROM w{n} GROUP BY 2" for n in (0, 1))
    return f"""WITH {_HOURLY}, {", ".join(parts)}, laws AS ({both}),
rest AS (SELECT variant, event_type, "window", mean - {line} AS r FROM (SELECT event_type, "window", mean, [1.0, {", ".join(terms)}] AS x FROM hourly) JOIN laws USING (event_type)),
wide AS (SELECT variant, "window", "window"::DATE AS day, max(r) FILTER (event_type = 'click') AS a, max(r) FILTER (event_type = 'view') AS b FROM rest GROUP BY 1, 2),
full_ AS (SELECT *, epoch_us("window") // 3600000000 - row_number() OVER (PARTITION BY variant, day ORDER BY "window") AS g FROM wide WHERE a IS NOT NULL AND b IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY variant, day, g) AS n FROM full_),
l AS (SELECT *, lag(a) OVER e AS x1, lag(b) OVER e AS x2 FROM sized WHERE n >= 2 WINDOW e AS (PARTITION BY variant, day, g ORDER BY "window")),
m AS (SELECT variant, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, a) AS a1, covar_pop(x2, a) AS a2, covar_pop(x1, b) AS b1, covar_pop(x2, b) AS b2 FROM l WHERE x1 IS NOT NULL GROUP BY 1),
c AS (SELECT variant, (a1 * s22 - a2 * s12) / (s11 * s22 - s12 * s12) AS aa, (a2 * s11 - a1 * s12) / (s11 * s22 - s12 * s12) AS ab, (b1 * s22 - b2 * s12) / (s11 * s22 - s12 * s12) AS ba, (b2 * s11 - b1 * s12) / (s11 * s22 - s12 * s12) AS bb FROM m),
d AS (SELECT variant, (aa + bb) / 2 AS h, aa * bb - ab * ba AS det FROM c),
z AS (SELECT variant, unnest(CASE WHEN h * h - det < 0 THEN [{{'re': h, 'im': sqrt(det - h * h)}}] ELSE [{{'re': h + sqrt(h * h - det), 'im': 0.0}}, {{'re': h - sqrt(h * h - det), 'im': 0.0}}] END) AS z FROM d),
p AS (SELECT variant, sqrt(z.re * z.re + z.im * z.im) AS modulus, abs(atan2(z.im, z.re)) AS angle FROM z),
n AS (SELECT *, row_number() OVER (ORDER BY round(modulus, 9) DESC, angle) AS rank FROM p WHERE variant = 0),
k AS (SELECT n.rank, n.modulus, n.angle, o.modulus AS m2, o.angle AS a2, row_number() OVER (PARTITION BY n.rank ORDER BY round(abs(o.angle - n.angle), 9), abs(o.modulus - n.modulus)) AS nth FROM n JOIN p o ON o.variant = 1)
SELECT rank::INT AS rank, round(modulus, 5) AS modulus, round(CASE WHEN angle > 1e-9 THEN 2 * pi() / angle * 60 END, 3) AS period, round(m2, 5) AS modulus_after, round(CASE WHEN a2 > 1e-9 THEN 2 * pi() / a2 * 60 END, 3) AS period_after, round(a2 - angle, 5) + 0.0 AS moved FROM k WHERE nth = 1"""


@query(_oscillation_sql())
def oscillation_roots(spark, sf_dir):
    """The roots of a pair's hourly model beside those of the model from which two periods more are taken out."""
    h = _hourly(spark, sf_dir).where(F.col("event_type").isin(_PAIR))
    rows = var.oscillation_placebo(h, "event_type", _PAIR, "window", "mean", "hours", _USUAL, _EXTRA, 60, 2, 1)
    found = spark.createDataFrame([tuple(r.values()) for r in rows], "rank int, modulus double, period double, modulus_after double, period_after double, moved double")
    return found.select("rank", F.round("modulus", 5).alias("modulus"), F.round("period", 3).alias("period"), F.round("modulus_after", 5).alias("modulus_after"), F.round("period_after", 3).alias("period_after"), (F.round("moved", 5) + 0.0).alias("moved"))
