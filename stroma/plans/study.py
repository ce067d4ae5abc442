"""Event study, co-occurrence and pair statistics on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, micros
from stroma.functions.numbers import cut, mean_interval, r6, wilson
from stroma.operators import aggregates as agg
from stroma.operators import cooccurrence as co
from stroma.operators import eventstudy as es
from stroma.operators import grid, ordered, ranges
from stroma.operators.bootstrap import weight_sql
from stroma.plans.base import query, table

_INF = float("inf")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


# purchases as events by user; hourly cells by user
_CONTROLS = """p AS (SELECT event_id, user_id, ts AS t0 FROM events WHERE event_type = 'purchase'),
c AS (SELECT event_id, user_id, t0, d, date_trunc('minute', t0) + to_days(d::INT) AS control FROM p, (SELECT unnest(range(-14, 15)) AS d) WHERE d <> 0
 AND CASE isodow(t0) WHEN 7 THEN 3 WHEN 6 THEN 2 WHEN 5 THEN 1 ELSE 0 END = CASE isodow(t0 + to_days(d::INT)) WHEN 7 THEN 3 WHEN 6 THEN 2 WHEN 5 THEN 1 ELSE 0 END),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND p.t0 BETWEEN c.control - INTERVAL 1 HOUR AND c.control + INTERVAL 4 HOURS)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY md5('11:' || event_id::VARCHAR || ':' || d::VARCHAR)) AS r, count(*) OVER (PARTITION BY event_id) AS n FROM f),
controls AS (SELECT event_id, user_id, t0, control FROM k WHERE n >= 5 AND r <= 5)"""


def _controls(spark, sf_dir) -> DataFrame:
    p = _events(spark, sf_dir).where("event_type = 'purchase'")
    events = p.select("event_id", "user_id", F.col("ts").alias("t0"))
    return es.matched_controls(events, p.select("user_id", "ts"), ["user_id"], 14, 60, 240, 5, 11)


@query(f"WITH {_CONTROLS} SELECT event_id, user_id, t0, control FROM controls")
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(spark, sf_dir)


_CELLS = """cells AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS "window", avg(value) AS mean FROM events GROUP BY 1, 2)"""
_CURVES = f"""{_CONTROLS}, {_CELLS}, o AS (SELECT unnest(range(-120, 241, 60)) AS m),
ev AS (SELECT e.event_id, m, mean FROM (SELECT DISTINCT event_id, user_id, t0 FROM controls) e CROSS JOIN o LEFT JOIN cells ON cells.user_id = e.user_id AND "window" = time_bucket(INTERVAL 1 HOUR, t0) + to_minutes(m::INT)),
ct AS (SELECT e.event_id, m, avg(mean) AS mean FROM controls e CROSS JOIN o LEFT JOIN cells ON cells.user_id = e.user_id AND "window" = time_bucket(INTERVAL 1 HOUR, control) + to_minutes(m::INT) GROUP BY 1, 2),
diff AS (SELECT ev.event_id, ev.m AS rel_min, ev.mean - ct.mean AS difference FROM ev LEFT JOIN ct ON ev.event_id = ct.event_id AND ev.m = ct.m)"""


def _difference(spark, sf_dir) -> DataFrame:
    e, c = _events(spark, sf_dir), _controls(spark, sf_dir)
    cells = e.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window")).agg(F.avg("value").alias("mean"))
    offsets = range(-120, 241, 60)
    mine = es.aligned_curves(c.select("event_id", "user_id", "t0").distinct(), cells, ["event_id"], ["user_id"], "t0", 60, offsets, "mean")
    theirs = es.aligned_curves(c, cells, ["event_id", "control"], ["user_id"], "control", 60, offsets, "mean")
    return es.response(mine, theirs, "mean")


@query(f"""WITH {_CURVES} SELECT event_id, rel_min::INT AS rel_min, round(difference, 6) AS difference FROM diff""")
def event_curves(spark, sf_dir):
    return _difference(spark, sf_dir).select("event_id", "rel_min", r6(F.col("difference")).alias("difference"))


@query(f"""WITH {_CURVES}, b AS (SELECT event_id, avg(difference) AS base FROM diff WHERE rel_min BETWEEN -120 AND 0 GROUP BY 1)
SELECT rel_min::INT AS rel_min, count(difference - base) AS n, round(avg(difference - base), 6) AS mean, round(stddev_samp(difference - base), 6) AS sd FROM diff LEFT JOIN b USING (event_id) GROUP BY 1""")
def baseline_corrected_response(spark, sf_dir):
    d = es.baseline_corrected(_difference(spark, sf_dir), ["event_id"], "difference", -120, 0)
    return d.groupBy("rel_min").agg(F.count("difference").alias("n"), r6(F.avg("difference")).alias("mean"), r6(F.stddev_samp("difference")).alias("sd"))


@query(f"""WITH e AS (SELECT ts::DATE::VARCHAR AS day, hour(ts) AS hour, value FROM events), w AS (SELECT draw, day, CASE WHEN draw < 0 THEN 1 ELSE {weight_sql(42, "draw", "day")} END AS w FROM (SELECT unnest(range(-1, 1000)) AS draw), (SELECT DISTINCT day FROM e)), c AS (SELECT day, hour, sum(value) AS s, count(value) AS n FROM e GROUP BY 1, 2),
m AS (SELECT draw, hour, CASE WHEN sum(w * n) > 0 THEN sum(w * s) / sum(w * n) END AS m FROM c JOIN w USING (day) GROUP BY 1, 2)
SELECT hour, round(max(m) FILTER (draw < 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (draw >= 0), 6) AS lo, round(quantile_cont(m, 0.975) FILTER (draw >= 0), 6) AS hi FROM m GROUP BY 1""")
def cluster_bootstrap_band(spark, sf_dir):
    """Mean value by hour of the day, with a band by resampling days."""
    e = _events(spark, sf_dir)
    d = e.select(F.col("ts").cast("date").cast("string").alias("day"), F.hour("ts").alias("hour"), "value")
    b = es.cluster_bootstrap(d, "day", "hour", "value", 1000, 42)
    return b.select("hour", *[r6(F.col(c)).alias(c) for c in ("mean", "lo", "hi")])


@query("""WITH s AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS s FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 10800000000)::INT AS b FROM events)),
w AS (SELECT user_id, s, event_type, count(*) AS votes, count(DISTINCT event_id) AS n, min(ts) AS t0, max(ts) AS t1 FROM s GROUP BY 1, 2, 3)
SELECT user_id, event_type, t0, t1, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY votes DESC, event_type) AS k FROM w) WHERE k = 1 AND n >= 2""")
def clustered_events(spark, sf_dir):
    return es.cluster_events(_events(spark, sf_dir), "user_id", "event_type", "event_id", "ts", 180, 2).select("user_id", "event_type", "t0", "t1", "n")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS places, count(DISTINCT ts::DATE) AS days, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1""")
def code_inventory(spark, sf_dir):
    return co.inventory(_events(spark, sf_dir), "event_type", "user_id", "ts")


@query("""SELECT event_type, hour, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share, round(rush / n, 6) AS rush FROM (SELECT event_type, hour(ts)::INT AS hour, count(*) AS n, count(*) FILTER (hour(ts) IN (6, 7, 8, 9, 15, 16, 17, 18, 19)) AS rush FROM events GROUP BY 1, 2)""")
def temporal_crosstab(spark, sf_dir):
    from stroma.functions.calendar import rush_hour

    c = _events(spark, sf_dir).groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(rush_hour(F.col("ts"))).alias("_r"))
    return c.select("event_type", "hour", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("event_type"))).alias("share"), r6(F.col("_r") / F.col("n")).alias("rush"))


_ACTIVE = """active AS (SELECT DISTINCT event_type, unnest(generate_series(time_bucket(INTERVAL 30 MINUTES, ts), CASE WHEN time_bucket(INTERVAL 30 MINUTES, e) = e THEN e ELSE time_bucket(INTERVAL 30 MINUTES, e) + INTERVAL 30 MINUTES END, INTERVAL 30 MINUTES)) AS "window" FROM (SELECT event_type, ts, ts + to_minutes(least(value, 90)::INT) AS e FROM events))"""


def _active(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("end", F.col("ts") + F.make_dt_interval(mins=F.rint(F.least(F.col("value"), F.lit(90.0))).cast("int")))
    return ranges.active_windows(e, ["event_type"], "ts", "end", 30)


@query(f"""WITH {_ACTIVE} SELECT event_type, count(*) AS windows FROM active GROUP BY 1""")
def active_windows(spark, sf_dir):
    return _active(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"))


@query(f"""WITH {_ACTIVE} SELECT n_active, count(*) AS windows FROM (SELECT "window", count(*) AS n_active FROM active GROUP BY 1) GROUP BY 1""")
def simultaneously_active(spark, sf_dir):
    return co.simultaneous(_active(spark, sf_dir), "event_type")


@query(f"""WITH {_ACTIVE}, t AS (SELECT count(DISTINCT "window") AS t FROM active), n AS (SELECT event_type, count(*) AS n FROM active GROUP BY 1)
SELECT a.event_type AS code_a, b.event_type AS code_b, count(*) AS joint, round(count(*) * any_value(t.t) / (any_value(x.n) * any_value(y.n)), 6) AS lift FROM active a JOIN active b ON a."window" = b."window" AND a.event_type < b.event_type
JOIN n x ON x.event_type = a.event_type JOIN n y ON y.event_type = b.event_type CROSS JOIN t GROUP BY 1, 2""")
def lift_pairs(spark, sf_dir):
    a = _active(spark, sf_dir)
    return co.lift_pairs(a, "event_type", a.agg(F.count_distinct("window"))).withColumn("lift", r6(F.col("lift")))


@query("""WITH t AS (SELECT event_type AS code_a, count(DISTINCT (user_id, ts)) AS n_a FROM events GROUP BY 1)
SELECT a.event_type AS code_a, b.event_type AS code_b, any_value(n_a) AS n_a, count(DISTINCT (a.user_id, a.ts)) AS n_followed, round(count(DISTINCT (a.user_id, a.ts)) / any_value(n_a), 6) AS rate
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS JOIN t ON code_a = a.event_type GROUP BY 1, 2""")
def follow_rate(spark, sf_dir):
    return co.follow_rates(_events(spark, sf_dir), "event_type", "user_id", "ts", 360, 20).withColumn("rate", r6(F.col("rate")))


@query("""SELECT event_type, count(*) AS isolated FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE a.user_id = b.user_id AND a.event_type <> b.event_type AND b.ts BETWEEN a.ts - INTERVAL 6 HOURS AND a.ts + INTERVAL 6 HOURS) GROUP BY 1""")
def isolated_share(spark, sf_dir):
    return co.isolated(_events(spark, sf_dir), "event_id", "event_type", "user_id", "ts", 360).groupBy("event_type").agg(F.count(F.lit(1)).alias("isolated"))


# --- pairs of neighbours ----------------------------------------------------

_PAIRS = """pairs AS (SELECT *, (epoch_us(ts) - epoch_us(pt)) / 3600000000.0 AS gap, CASE WHEN (epoch_us(ts) - epoch_us(pt)) / 3600000000.0 <= 2 THEN 'short' WHEN (epoch_us(ts) - epoch_us(pt)) / 3600000000.0 <= 8 THEN 'medium' WHEN (epoch_us(ts) - epoch_us(pt)) / 3600000000.0 <= 24 THEN 'long' ELSE 'open' END AS band
 FROM (SELECT event_id, user_id, event_type, ts, value, lag(ts) OVER w AS pt, lag(value) OVER w AS pv, lag(event_type) OVER w AS ptype FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pt IS NOT NULL)"""


def _pairs(spark, sf_dir, k: int = 1) -> DataFrame:
    p = ordered.lag_pairs(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["ts", "value", "event_type"], k)
    gap = (micros("ts") - micros("ts_prev")) / (3600.0 * MICROS)
    return p.withColumn("gap", gap).withColumn("band", cut(F.col("gap"), [-_INF, 2, 8, 24, _INF], ["short", "medium", "long", "open"]))


_OLS = """SELECT {by} n, round(r, 6) AS r, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS r_lo, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS r_hi, round(slope, 6) AS slope, round(se, 6) AS slope_se, round(slope - 1.96 * se, 6) AS slope_lo, round(slope + 1.96 * se, 6) AS slope_hi FROM
(SELECT {by} count(*) AS n, any_value(r) AS r, any_value(slope) AS slope, sqrt(sum(pow(pv - mx, 2) * pow(value - my - slope * (pv - mx), 2)) * count(*) / (count(*) - 2)) / sum(pow(pv - mx, 2)) AS se
FROM (SELECT {by} pv, value, avg(pv) OVER w AS mx, avg(value) OVER w AS my, corr(value, pv) OVER w AS r, regr_slope(value, pv) OVER w AS slope FROM {src} WINDOW w AS (PARTITION BY {part})) GROUP BY {group})"""


@query(f"WITH {_PAIRS} " + _OLS.format(by="band,", src="pairs", part="band", group="band"))
def headway_pairs(spark, sf_dir):
    """Correlation and robust slope of a value on its predecessor's, by the gap between them."""
    return _rounded(agg.correlate(_pairs(spark, sf_dir), ["band"], "value_prev", "value"), ["band"])


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "n", *[r6(F.col(c)).alias(c) for c in df.columns if c not in (*keys, "n")])


@query(" UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n, round(corr(value, pv), 6) AS r, round(median((epoch_us(ts) - epoch_us(pt)) / 3600000000.0), 3) AS median_gap FROM (SELECT ts, value, lag(ts, {k}) OVER w AS pt, lag(value, {k}) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pt IS NOT NULL AND epoch_us(ts) - epoch_us(pt) <= 864000000000" for k in (1, 2, 3, 5, 10)))
def lag_k_corr(spark, sf_dir):
    """All lags in one pass."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    ks = (1, 2, 3, 5, 10)
    lagged = _events(spark, sf_dir).withColumns({f"_v{k}": F.lag("value", k).over(w) for k in ks} | {f"_t{k}": F.lag("ts", k).over(w) for k in ks})
    gap = lambda k: (micros("ts") - micros(f"_t{k}")) / (3600.0 * MICROS)
    long = lagged.select("value", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_v{k}").alias("v"), gap(k).alias("gap")) for k in ks])).alias("p")).select("value", "p.*").where("gap <= 240")
    return long.groupBy("k").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("value", "v")).alias("r"), F.round(F.median("gap"), 3).alias("median_gap"))


@query(f"""WITH {_PAIRS} SELECT band, event_type, n, round(m, 6) AS mean, round(m - 1.96 * sd / sqrt(n), 6) AS lo, round(m + 1.96 * sd / sqrt(n), 6) AS hi FROM (SELECT band, event_type, count(*) AS n, avg(value - pv) AS m, stddev_samp(value - pv) AS sd FROM pairs GROUP BY 1, 2) WHERE n >= 2""")
def delta_by_bin(spark, sf_dir):
    c = _pairs(spark, sf_dir).groupBy("band", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value") - F.col("value_prev")).alias("mean"), F.stddev_samp(F.col("value") - F.col("value_prev")).alias("sd")).where("n >= 2")
    lo, hi = mean_interval(F.col("mean"), F.col("sd"), F.col("n"))
    return c.select("band", "event_type", "n", r6(F.col("mean")).alias("mean"), r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(f"WITH {_PAIRS}, same AS (SELECT *, event_type = ptype AS same_type FROM pairs) " + _OLS.format(by="same_type,", src="same", part="same_type", group="same_type"))
def same_group_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("same_type", F.col("event_type") == F.col("event_type_prev"))
    return _rounded(agg.correlate(p, ["same_type"], "value_prev", "value"), ["same_type"])


@query(f"""WITH {_PAIRS} SELECT band, high, n, k, round(CASE WHEN n >= 30 THEN (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) END, 6) AS lo,
round(CASE WHEN n >= 30 THEN (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) END, 6) AS hi
FROM (SELECT band, pv > 60 AS high, count(*) AS n, count(*) FILTER (event_type = 'error') AS k FROM pairs WHERE ptype <> 'error' GROUP BY 1, 2)""")
def rate_cells_wilson(spark, sf_dir):
    p = _pairs(spark, sf_dir).where("event_type_prev <> 'error'")
    c = p.groupBy("band", (F.col("value_prev") > 60).alias("high")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return c.select("band", "high", "n", "k", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("""WITH m AS (SELECT hour(ts)::INT AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, avg(value) AS typical FROM events GROUP BY 1), o AS (SELECT hour(ts)::INT AS hour, avg(value) AS observed FROM events GROUP BY 1)
SELECT hour, round(any_value(observed), 6) AS observed, round(sum(n * typical) / sum(n), 6) AS expected, round(any_value(observed) - sum(n * typical) / sum(n), 6) AS residual FROM m JOIN t USING (event_type) JOIN o USING (hour) GROUP BY hour""")
def composition_expectation(spark, sf_dir):
    """What an hour's mix of types would lead to expect, and what is left over."""
    e = _events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    typical = e.groupBy("event_type").agg(F.avg("value").alias("t"))
    mix = e.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).join(F.broadcast(typical), "event_type")
    g = mix.groupBy("hour").agg((F.sum("s") / F.sum("n")).alias("o"), (F.sum(F.col("n") * F.col("t")) / F.sum("n")).alias("x"))
    return g.select("hour", r6(F.col("o")).alias("observed"), r6(F.col("x")).alias("expected"), r6(F.col("o") - F.col("x")).alias("residual"))


@query("""WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT round(sum(n)::BIGINT, 0)::BIGINT AS cells, (SELECT count(*) FROM events) AS source FROM g""")
def grid_reconciliation(spark, sf_dir):
    """The grid's counts add up to the source's rows."""
    e = _events(spark, sf_dir)
    cells = grid.state_grid(e, "event_type", "ts", "value", 60, 100.0).agg(F.sum("n").alias("cells"))
    return cells.crossJoin(e.agg(F.count(F.lit(1)).alias("source")))
