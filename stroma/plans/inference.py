"""Tests and regressions of times to events, recovery, severity classes and resampled shares on the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.functions.numbers import cut, r6
from stroma.operators import design, survival
from stroma.operators.bootstrap import band, resampled_sums, weight_sql
from stroma.plans.base import query, table
from stroma.plans.models import _TIMES, _times

_INF = float("inf")
#: Where the score and meat of the regression are looked at.
_B = (0.2, -0.1)

_GROUPED = f"""{_TIMES}, g4 AS (SELECT user_id % 4 AS grp, t, e FROM times)"""


def _grouped(spark, sf_dir) -> DataFrame:
    return _times(spark, sf_dir).select((F.col("user_id") % 4).alias("grp"), "t", "e")


@query(f"""WITH {_GROUPED}, tt AS (SELECT DISTINCT t FROM g4 WHERE e), gg AS (SELECT DISTINCT grp FROM g4),
n AS (SELECT tt.t, gg.grp, (SELECT count(*) FROM g4 x WHERE x.grp = gg.grp AND x.t >= tt.t) AS n, (SELECT count(*) FROM g4 x WHERE x.t >= tt.t) AS nn, (SELECT count(*) FROM g4 x WHERE x.t = tt.t AND x.e) AS dd FROM tt, gg)
SELECT a.grp AS group_a, b.grp AS group_b, round(sum(CASE WHEN a.nn > 1 THEN a.dd * (a.nn - a.dd) / (a.nn - 1) * (a.n / a.nn) * ((a.grp = b.grp)::INT - b.n / b.nn) ELSE 0 END), 6) AS covariance FROM n a JOIN n b USING (t) GROUP BY 1, 2""")
def logrank_covariance(spark, sf_dir):
    """Covariance of observed less expected events between four groups."""
    return survival.logrank_covariance(_grouped(spark, sf_dir), "grp", "t", "e").withColumn("covariance", r6(F.col("covariance")))


@query(f"""WITH {_GROUPED}, p AS (SELECT a.grp AS group_a, b.grp AS group_b FROM (SELECT DISTINCT grp FROM g4) a JOIN (SELECT DISTINCT grp FROM g4) b ON a.grp < b.grp),
x AS (SELECT p.*, g4.grp, t, e FROM p JOIN g4 ON g4.grp = group_a OR g4.grp = group_b), tt AS (SELECT group_a, group_b, t, count(*) FILTER (e) AS dd, count(*) FILTER (e AND grp = group_a) AS d FROM x GROUP BY 1, 2, 3),
n AS (SELECT tt.*, (SELECT count(*) FROM x WHERE x.group_a = tt.group_a AND x.group_b = tt.group_b AND x.t >= tt.t) AS nn, (SELECT count(*) FROM x WHERE x.group_a = tt.group_a AND x.group_b = tt.group_b AND x.t >= tt.t AND x.grp = x.group_a) AS n FROM tt WHERE dd > 0),
s AS (SELECT group_a, group_b, sum(d)::BIGINT AS observed, sum(dd * n / nn) AS expected, sum(CASE WHEN nn > 1 THEN dd * n / nn * (1 - n / nn) * (nn - dd) / (nn - 1) ELSE 0 END) AS variance FROM n GROUP BY 1, 2)
SELECT group_a, group_b, observed, round(expected, 6) AS expected, round(pow(observed - expected, 2) / variance, 6) AS chi2 FROM s""")
def pairwise_logrank(spark, sf_dir):
    """Each two of four groups against each other."""
    p = survival.pairwise_logrank(_grouped(spark, sf_dir), "grp", "t", "e")
    return p.select("group_a", "group_b", "observed", r6(F.col("expected")).alias("expected"), r6(F.col("chi2")).alias("chi2"))


# --- Cox: sums at given coefficients, with strata, entry and clusters -------

_COX = f"""{_TIMES}, r AS (SELECT row_number() OVER () AS i, user_id % 2 AS half, user_id AS c, t::DOUBLE AS t, e, (t // 3)::DOUBLE - 1 AS entry, late::INT::DOUBLE AS x0, value / 100 AS x1, exp({_B[0]} * late::INT - 0.1 * value / 100) AS w FROM times),
ties AS (SELECT half, t, count(*) AS d, sum(w) AS e0, sum(w * x0) AS e10, sum(w * x1) AS e11 FROM r WHERE e GROUP BY 1, 2),
risk AS (SELECT k.half, k.t, any_value(d) AS d, any_value(e0) AS e0, any_value(e10) AS e10, any_value(e11) AS e11, sum(w) AS s0, sum(w * x0) AS s10, sum(w * x1) AS s11 FROM ties k JOIN r ON r.half = k.half AND r.t >= k.t AND r.entry < k.t GROUP BY 1, 2),
z AS (SELECT half, t, l / d AS part, s0 - l / d * e0 AS z0, (s10 - l / d * e10) / (s0 - l / d * e0) AS m0, (s11 - l / d * e11) / (s0 - l / d * e0) AS m1 FROM (SELECT *, unnest(range(d)) AS l FROM risk))"""


def _cox(spark, sf_dir) -> DataFrame:
    x = _times(spark, sf_dir).select((F.col("user_id") % 2).alias("half"), "user_id", F.col("t").cast("double").alias("t"), "e", (F.floor(F.col("t") / 3) - 1).cast("double").alias("entry"), F.col("late").cast("double").alias("late"), (F.col("value") / 100).alias("value"))
    return survival.cox_rows(x, ["late", "value"], "t", "e", ["half"], "entry", "user_id")


@query(f"""WITH {_COX} SELECT 'late' AS term, round((SELECT sum(x0) FROM r WHERE e) - (SELECT sum(m0) FROM z), 6) AS score UNION ALL SELECT 'value', round((SELECT sum(x1) FROM r WHERE e) - (SELECT sum(m1) FROM z), 6)
UNION ALL SELECT 'log-likelihood', round((SELECT sum(ln(w)) FROM r WHERE e) - (SELECT sum(ln(z0)) FROM z), 6)""")
def cox_score(spark, sf_dir):
    """Score and log-likelihood with strata, late entry and ties, at given coefficients."""
    ll, grad, _ = survival.cox_sums(_cox(spark, sf_dir), ["late", "value"], np.array(_B), ["half"])
    return spark.createDataFrame([("late", float(grad[0])), ("value", float(grad[1])), ("log-likelihood", float(ll))], "term string, score double").withColumn("score", r6(F.col("score")))


@query(f"""WITH {_COX}, own AS (SELECT half, t, avg(m0) AS m0, avg(m1) AS m1 FROM z GROUP BY 1, 2),
p AS (SELECT r.i, sum(CASE WHEN r.e AND z.t = r.t THEN (1 - part) / z0 ELSE 1 / z0 END) AS c0, sum(CASE WHEN r.e AND z.t = r.t THEN (1 - part) * m0 / z0 ELSE m0 / z0 END) AS c1, sum(CASE WHEN r.e AND z.t = r.t THEN (1 - part) * m1 / z0 ELSE m1 / z0 END) AS c2 FROM r JOIN z ON z.half = r.half AND z.t <= r.t AND z.t > r.entry GROUP BY 1),
u AS (SELECT r.c, CASE WHEN e THEN x0 - own.m0 ELSE 0 END - w * (x0 * coalesce(c0, 0) - coalesce(c1, 0)) AS u0, CASE WHEN e THEN x1 - own.m1 ELSE 0 END - w * (x1 * coalesce(c0, 0) - coalesce(c2, 0)) AS u1 FROM r LEFT JOIN own ON own.half = r.half AND own.t = r.t LEFT JOIN p USING (i)),
c AS (SELECT c, sum(u0) AS u0, sum(u1) AS u1 FROM u GROUP BY 1)
SELECT 0 AS i, 0 AS j, round(sum(u0 * u0), 5) AS total FROM c UNION ALL SELECT 0, 1, round(sum(u0 * u1), 5) FROM c UNION ALL SELECT 1, 1, round(sum(u1 * u1), 5) FROM c""")
def cox_meat(spark, sf_dir):
    """Outer products of the score's shares summed by user: the middle of the robust covariance."""
    m = survival.meat(survival.score_residuals(_cox(spark, sf_dir), ["late", "value"], np.array(_B), ["half"]), 2)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i, j in ((0, 0), (0, 1), (1, 1))], "i int, j int, total double").withColumn("total", F.round("total", 5))


@query("SELECT unnest(['late', 'value']) AS term, 0.0::DOUBLE AS score, TRUE AS is_maximum")
def cox_solution(spark, sf_dir):
    """At the reported coefficients the score is zero and the log-likelihood larger than beside them."""
    terms = ["late", "value"]
    rows = _cox(spark, sf_dir)
    x = rows.select("half", "_t", "_e", F.col("_entry"), "_cluster", *terms)
    m = survival.cox(x, terms, "_t", "_e", ["half"], "_entry", "_cluster")
    ll, grad, hess = survival.cox_sums(rows, terms, m["coefficients"], ["half"])
    beside = [survival.cox_sums(rows, terms, m["coefficients"] + np.eye(2)[i] * s, ["half"])[0] for i in range(2) for s in (-0.05, 0.05)]
    ok = bool(max(beside) < ll and (np.linalg.eigvalsh(hess) > 0).all() and (m["robust_se"] > 0).all())
    return spark.createDataFrame([(t, round(float(g), 5) + 0.0, ok) for t, g in zip(terms, grad)], "term string, score double, is_maximum boolean")


_OVER = "list_sum(list_transform(range(1, len(n0) + 1), lambda i: {0}))"
_Z = "(n1[i] * exp(b) / (n0[i] + n1[i] * exp(b)))"


@query(f"""WITH RECURSIVE {_TIMES}, k AS (SELECT t, count(*) FILTER (e AND late) AS d1, count(*) FILTER (e AND NOT late) AS d0, count(*) FILTER (late) AS m1, count(*) FILTER (NOT late) AS m0 FROM times GROUP BY 1),
r AS (SELECT *, sum(m1) OVER (ORDER BY t DESC) AS n1, sum(m0) OVER (ORDER BY t DESC) AS n0 FROM k), tie AS (SELECT t, l, n0 - l / (d0 + d1) * d0 AS n0, n1 - l / (d0 + d1) * d1 AS n1 FROM (SELECT *, unnest(range(d0 + d1)) AS l FROM r WHERE d0 + d1 > 0)),
l AS (SELECT list(n0 ORDER BY t, l) AS n0, list(n1 ORDER BY t, l) AS n1, (SELECT sum(d1) FROM k) AS hits FROM tie),
newton(step, b) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT step + 1, b + (hits - {_OVER.format(_Z)}) / {_OVER.format(f"{_Z} * (1 - {_Z})")} FROM newton, l WHERE step < 20)
SELECT 'late' AS term, round(b, 6) AS coefficient, round(1 / sqrt({_OVER.format(f"{_Z} * (1 - {_Z})")}), 6) AS se, round(hits * b - {_OVER.format("ln(n0[i] + n1[i] * exp(b))")}, 4) AS loglik FROM newton, l WHERE step = 20""")
def cox_coefficient(spark, sf_dir):
    """The coefficient itself, of one yes-or-no covariate with Efron's ties; the SQL takes twenty Newton steps over the tied events."""
    x = _times(spark, sf_dir).select("t", "e", F.col("late").cast("double").alias("late"))
    m = survival.cox(x, ["late"], "t", "e")
    return spark.createDataFrame([("late", round(float(m["coefficients"][0]), 6), round(float(m["se"][0]), 6), round(float(m["loglik"]), 4))], "term string, coefficient double, se double, loglik double")


@query(f"""WITH {_TIMES}, r AS (SELECT t, e, late::INT::DOUBLE AS x, exp(0.2 * late::INT) AS w FROM times), ties AS (SELECT t, count(*) AS d, sum(w) AS e0, sum(w * x) AS e1 FROM r WHERE e GROUP BY 1),
risk AS (SELECT k.t, any_value(d) AS d, any_value(e0) AS e0, any_value(e1) AS e1, sum(w) AS s0, sum(w * x) AS s1 FROM ties k JOIN r ON r.t >= k.t GROUP BY 1),
own AS (SELECT t, avg((s1 - l / d * e1) / (s0 - l / d * e0)) AS m FROM (SELECT *, unnest(range(d)) AS l FROM risk) GROUP BY 1),
h AS (SELECT r.x - own.m AS s, rank() OVER (ORDER BY r.t) + (count(*) OVER (PARTITION BY r.t) - 1) / 2.0 AS k FROM r JOIN own USING (t) WHERE e)
SELECT 'late' AS term, count(*) AS n, round(covar_pop(k, s), 6) AS covariance, round(var_pop(k), 4) AS variance_t, round(var_pop(s), 6) AS variance_r FROM h""")
def cox_proportionality(spark, sf_dir):
    """Residuals of the mean covariate against the ranks of their times."""
    x = _times(spark, sf_dir).select("t", "e", F.col("late").cast("double").alias("late"))
    p = survival.proportionality(x, ["late"], "t", "e", np.array([0.2]))
    return p.select("term", "n", r6(F.col("covariance")).alias("covariance"), F.round("variance_t", 4).alias("variance_t"), r6(F.col("variance_r")).alias("variance_r"))


@query(f"WITH {_TIMES} SELECT law, term, 0.0::DOUBLE AS slope, (SELECT count(*) FROM times) AS n FROM (SELECT unnest(['weibull', 'lognormal']) AS law), (SELECT unnest(['constant', 'late', 'value', 'log scale']) AS term)")
def aft_solution(spark, sf_dir):
    """The likelihood's slope a row at the reported coefficients of both laws is zero; robust errors by user exist."""
    x = _times(spark, sf_dir).select((F.col("t") + 0.5).alias("t"), "e", F.col("late").cast("double").alias("late"), (F.col("value") / 100).alias("value"), "user_id")
    rows = []
    for law in ("weibull", "lognormal"):
        m = survival.aft(x, ["late", "value"], "t", "e", law, cluster="user_id")
        if not (m["robust_se"] > 0).all():
            raise ValueError("no robust errors")
        rows += [(law, t, round(float(g) / m["rows"], 4) + 0.0, m["rows"]) for t, g in zip(["constant", "late", "value", "log scale"], m["gradient"])]
    return spark.createDataFrame(rows, "law string, term string, slope double, n long")


# --- recovery, severity classes ---------------------------------------------

_RECOVERY = """e AS (SELECT event_id, user_id % 12 AS place, ts, ts::DATE AS day, event_type, value FROM events), q AS (SELECT *, value < 120 AND lead(value, 1) OVER w < 120 AND lead(value, 2) OVER w < 120 AS ok, max(ts) OVER (PARTITION BY place, day) AS last_ts FROM e WINDOW w AS (PARTITION BY place, day ORDER BY ts, event_id)),
f AS (SELECT a.event_id, a.place, a.ts, a.value, any_value(a.last_ts) AS last_ts, min(b.ts) FILTER (b.ok AND (b.ts, b.event_id) >= (a.ts, a.event_id)) AS calm, min(b.ts) FILTER (b.event_type = 'signup' AND (b.ts, b.event_id) > (a.ts, a.event_id)) AS other FROM q a JOIN q b ON a.place = b.place AND a.day = b.day WHERE a.event_type = 'error' GROUP BY 1, 2, 3, 4),
rec AS (SELECT event_id, place, value, calm IS NOT NULL AND (other IS NULL OR calm <= other) AS recovered, (epoch_us(CASE WHEN calm IS NOT NULL AND (other IS NULL OR calm <= other) THEN calm ELSE least(coalesce(other, last_ts), last_ts) END) - epoch_us(ts)) / 60000000.0 AS minutes FROM f),
sev AS (SELECT *, CASE WHEN value <= 50 THEN 'low' WHEN value <= 150 THEN 'middle' ELSE 'high' END AS class FROM rec)"""


def _recovery(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 12).alias("place"), "ts", F.col("ts").cast("date").alias("day"), "event_type", "value")
    r = survival.recovery_times(e, ["place"], "day", "ts", "event_id", F.col("event_type") == "error", F.col("value") < 120, F.col("event_type") == "signup")
    return r.withColumn("class", cut(F.col("value"), [-_INF, 50, 150, _INF], ["low", "middle", "high"]))


@query(f"WITH {_RECOVERY} SELECT event_id, round(minutes, 6) AS minutes, recovered, class FROM sev")
def recovery_censored(spark, sf_dir):
    """Time to the first of three calm values in a row the same day, ended by the next foreign event or the day's last."""
    return _recovery(spark, sf_dir).select("event_id", r6(F.col("minutes")).alias("minutes"), "recovered", "class")


@query(f"""WITH {_RECOVERY}, k AS (SELECT 'class' AS level, class AS grp, floor(minutes / 30) AS t, recovered FROM sev UNION ALL SELECT 'all', 'all', floor(minutes / 30), recovered FROM sev UNION ALL SELECT 'place', (place % 3)::VARCHAR, floor(minutes / 30), recovered FROM sev),
a AS (SELECT level, grp, t, count(*) FILTER (recovered) AS d, count(*) AS m FROM k GROUP BY 1, 2, 3), r AS (SELECT *, sum(m) OVER (PARTITION BY level, grp ORDER BY t DESC) AS n FROM a)
SELECT level, grp, t::BIGINT AS t, d, n::BIGINT AS n, round(CASE WHEN max((d >= n)::INT) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER w) END, 6) AS survival FROM r WHERE d > 0 WINDOW w AS (PARTITION BY level, grp ORDER BY t)""")
def km_grid(spark, sf_dir):
    """Recovery curves of several groupings at once, keyed by grouping and group."""
    r = _recovery(spark, sf_dir).withColumn("t", F.floor(F.col("minutes") / 30))
    keyed = r.withColumn("k", F.explode(F.array(F.struct(F.lit("class").alias("level"), F.col("class").alias("grp")), F.struct(F.lit("all").alias("level"), F.lit("all").alias("grp")), F.struct(F.lit("place").alias("level"), (F.col("place") % 3).cast("string").alias("grp"))))).select("k.level", "k.grp", "t", "recovered")
    return survival.kaplan_meier(keyed, ["level", "grp"], "t", "recovered").withColumn("survival", r6(F.col("survival")))


@query(f"""WITH {_RECOVERY}, s AS (SELECT class, count(*) AS n, median(minutes) AS m, regr_slope(minutes, value) AS slope FROM sev GROUP BY 1)
SELECT class, n, round(m, 6) AS median, round(slope, 6) AS slope, round(slope / (SELECT slope FROM s WHERE class = 'low'), 4) AS ratio FROM s""")
def class_slopes(spark, sf_dir):
    """Median recovery and its slope along the severity in each class, and the slope's ratio to the lowest class."""
    g = _recovery(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.median("minutes").alias("median"), F.regr_slope("minutes", "value").alias("slope"))
    low = g.where("class = 'low'").select(F.col("slope").alias("_low"))
    return g.crossJoin(F.broadcast(low)).select("class", "n", r6(F.col("median")).alias("median"), r6(F.col("slope")).alias("slope"), F.round(F.col("slope") / F.col("_low"), 4).alias("ratio"))


@query(f"""WITH {_RECOVERY}, w AS (SELECT draw, place, CASE WHEN draw < 0 THEN 1 ELSE {weight_sql(9, "draw", "place")} END AS w FROM (SELECT unnest(range(-1, 300)) AS draw), (SELECT DISTINCT place FROM sev)),
m AS (SELECT draw, class, CASE WHEN sum(w) > 0 THEN sum(w * recovered::INT) / sum(w) END AS p FROM sev JOIN w USING (place) GROUP BY 1, 2)
SELECT class, round(max(p) FILTER (draw < 0), 6) AS share, round(quantile_cont(p, 0.025) FILTER (draw >= 0), 6) AS lo, round(quantile_cont(p, 0.975) FILTER (draw >= 0), 6) AS hi FROM m GROUP BY 1""")
def share_bootstrap(spark, sf_dir):
    """Share recovered of each severity class with an interval over resamples of places."""
    r = _recovery(spark, sf_dir).withColumn("k", F.col("recovered").cast("double")).withColumn("n", F.lit(1.0))
    drawn = resampled_sums(r, "place", "class", ["k", "n"], 300, 9).withColumn("p", F.try_divide("k", "n"))
    return band(drawn, ["class"], "p", estimate="share").select("class", *[r6(F.col(c)).alias(c) for c in ("share", "lo", "hi")])


@query("""WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n >= 600 THEN l_suppkey::VARCHAR ELSE 'rare' END AS grp, sum(n)::BIGINT AS n FROM n GROUP BY 1""")
def rare_groups(spark, sf_dir):
    """Groups of fewer rows than a limit taken together."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("s"))
    return design.group_rare(li, "s", 600, "rare", "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, (event_type = 'click')::INT::DOUBLE AS type_click, (event_type = 'error')::INT::DOUBLE AS type_error, (event_type = 'signup')::INT::DOUBLE AS type_signup, (event_type = 'purchase')::INT::DOUBLE AS type_purchase, round((event_type = 'error')::INT * value, 6) AS error_value FROM events""")
def design_matrix(spark, sf_dir):
    """Indicators of all levels but the reference, and an interaction."""
    e = table(spark, sf_dir, "events")
    d = design.indicators(e, "event_type", "view", ["click", "error", "signup", "purchase"], "type")
    return design.interaction(d, "type_error", "value", "error_value").select("event_id", "type_click", "type_error", "type_signup", "type_purchase", r6(F.col("error_value")).alias("error_value"))
