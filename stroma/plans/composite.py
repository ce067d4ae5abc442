"""Composite operators: outage days, loads, severity, placebo times, recovery of lines, strata, audits, forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, floor_to, from_micros, micros
from stroma.functions.numbers import cut, r6
from stroma.operators import evaluate, eventstudy, ordered, ranges, var
from stroma.plans import models
from stroma.plans.base import query, table

HOUR = 3600 * MICROS
_INF = float("inf")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("""SELECT e.event_id, count(DISTINCT o.user_id) AS load FROM events e LEFT JOIN events o ON o.event_type = e.event_type AND o.user_id <> e.user_id AND o.ts >= e.ts - INTERVAL 30 MINUTES AND o.ts <= e.ts WHERE e.event_type = 'error' GROUP BY 1""")
def disturbance_load(spark, sf_dir):
    """Distinct other users with an error in [t - 30 min, t]."""
    e = _events(spark, sf_dir).where("event_type = 'error'")
    return ranges.distinct_others(e, ["event_type"], "ts", "user_id", HOUR // 2, "load").select("event_id", "load")


@query("""WITH b AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n, avg((value < 30)::INT) AS low FROM events GROUP BY 1, 2)
SELECT h::DATE AS day, round(avg((n >= 2 AND low >= 0.5)::INT), 6) AS affected, count(*) AS blocks, avg((n >= 2 AND low >= 0.5)::INT) >= 0.25 AS full_outage FROM b WHERE hour(h) >= 5 AND hour(h) < 23 GROUP BY 1""")
def outage_days(spark, sf_dir):
    """Share of each day's hourly blocks, from 5 to 23, that are conspicuous."""
    b = _events(spark, sf_dir).groupBy("event_type", floor_to("ts", 60).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") < 30).cast("int")).alias("low"))
    bad = ((F.col("n") >= 2) & (F.col("low") >= 0.5)).cast("int")
    return b.where((F.hour("h") >= 5) & (F.hour("h") < 23)).groupBy(F.col("h").cast("date").alias("day")).agg(r6(F.avg(bad)).alias("affected"), F.count(F.lit(1)).alias("blocks"), (F.avg(bad) >= 0.25).alias("full_outage"))


@query("""WITH r AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM (SELECT *, sum((NOT (value < 60))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM events) WHERE value < 60 GROUP BY user_id, r HAVING count(*) >= 3 AND max(ts) - min(ts) >= INTERVAL 1 HOUR),
h AS (SELECT DISTINCT user_id, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b), INTERVAL 1 HOUR)) AS hour FROM r),
n AS (SELECT date_trunc('hour', ts) AS hour FROM events GROUP BY 1 HAVING count(*) >= 20)
SELECT hour, count(*) AS users FROM h WHERE hour NOT IN (SELECT hour FROM n) GROUP BY 1""")
def zero_run_hours(spark, sf_dir):
    """Runs of low values, expanded to every hour they touch, without the busy hours."""
    e = _events(spark, sf_dir)
    r = ordered.runs(e, ["user_id"], ["ts", "event_id"], F.col("value") < 60)
    g = r.groupBy("user_id", "run").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 3").where(micros("b") - micros("a") >= HOUR)
    start = lambda c: micros(floor_to(c, 60))
    h = g.select("user_id", F.explode(F.sequence(start("a"), start("b"), F.lit(HOUR))).alias("us")).distinct().select("user_id", from_micros(F.col("us")).alias("hour"))
    busy = e.groupBy(floor_to("ts", 60).alias("hour")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("hour")
    return h.join(busy, "hour", "left_anti").groupBy("hour").agg(F.count(F.lit(1)).alias("users"))


@query("""WITH p AS (SELECT user_id, ts, event_id, value, lag(ts) OVER w AS pt, lag(event_type) OVER w AS ptype, event_type FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY hour(ts), event_id)),
c AS (SELECT CASE WHEN ts = pt THEN 'same time' WHEN ts < pt AND event_type = ptype THEN 'back, same type' WHEN ts < pt THEN 'back' ELSE 'forward' END AS kind, abs(epoch_us(ts) - epoch_us(pt)) <= 60000000 AS within_a_minute FROM p WHERE pt IS NOT NULL)
SELECT kind, within_a_minute, count(*) AS n FROM c GROUP BY 1, 2""")
def headway_audit(spark, sf_dir):
    """Neighbours in a coarse order whose times run backwards, by kind."""
    w = W.partitionBy("user_id", F.col("ts").cast("date")).orderBy(F.hour("ts"), "event_id")
    p = _events(spark, sf_dir).withColumn("pt", F.lag("ts").over(w)).withColumn("ptype", F.lag("event_type").over(w)).where("pt is not null")
    kind = F.when(F.col("ts") == F.col("pt"), "same time").when((F.col("ts") < F.col("pt")) & (F.col("event_type") == F.col("ptype")), "back, same type").when(F.col("ts") < F.col("pt"), "back").otherwise("forward")
    return p.groupBy(kind.alias("kind"), (F.abs(micros("ts") - micros("pt")) <= 60 * MICROS).alias("within_a_minute")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT user_id, ts::DATE AS day, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1, 2), m AS (SELECT user_id % 10 AS line, (epoch_us(b) - epoch_us(a)) / 60000000.0 AS minutes FROM t)
SELECT line, count(*) AS pairs, count(*) FILTER (minutes > 0 AND minutes < 600) AS plausible, round(median(minutes) FILTER (minutes > 0 AND minutes < 600), 3) AS median, round(quantile_cont(minutes, 0.1) FILTER (minutes > 0 AND minutes < 600), 3) AS p10 FROM m WHERE minutes IS NOT NULL GROUP BY 1""")
def travel_times(spark, sf_dir):
    """Time from the first stop of one kind to the first of another by user and day, with a plausibility range."""
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts")))
    t = _events(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(first("view").alias("a"), first("purchase").alias("b")).where("a is not null and b is not null")
    m = t.select((F.col("user_id") % 10).alias("line"), ((micros("b") - micros("a")) / (60.0 * MICROS)).alias("minutes"))
    good = F.when((F.col("minutes") > 0) & (F.col("minutes") < 600), F.col("minutes"))
    return m.groupBy("line").agg(F.count(F.lit(1)).alias("pairs"), F.count(good).alias("plausible"), F.round(F.median(good), 3).alias("median"), F.round(F.percentile(good, 0.1), 3).alias("p10"))


@query("""SELECT e.event_id, round(avg(o.value) FILTER (o.ts >= e.ts - INTERVAL 6 HOURS AND o.ts <= e.ts), 6) AS preload, round(max(o.value) FILTER (o.ts >= e.ts AND o.ts < e.ts + INTERVAL 3 HOURS), 6) AS severity, count(o.event_id) FILTER (o.ts >= e.ts + INTERVAL 3 HOURS AND o.ts < e.ts + INTERVAL 27 HOURS) AS later
FROM events e JOIN events o ON o.user_id = e.user_id AND o.ts >= e.ts - INTERVAL 6 HOURS AND o.ts < e.ts + INTERVAL 27 HOURS WHERE e.event_type = 'error' GROUP BY 1""")
def severity_windows(spark, sf_dir):
    """Mean before, maximum soon after and count later, around each error: one range join, three windows."""
    e = _events(spark, sf_dir)
    a = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    o = e.select("user_id", F.col("ts").alias("ts2"), F.col("value").alias("v2"))
    p = ranges.range_pairs(a, o, ["user_id"], -6 * HOUR, 27 * HOUR - 1, "ts", "ts2").withColumn("d", micros("ts2") - micros("ts"))
    return p.groupBy("event_id").agg(r6(F.avg(F.when(F.col("d") <= 0, F.col("v2")))).alias("preload"), r6(F.max(F.when((F.col("d") >= 0) & (F.col("d") < 3 * HOUR), F.col("v2")))).alias("severity"), F.count_if(F.col("d") >= 3 * HOUR).alias("later"))


_DAILY = """d AS (SELECT user_id, ts::DATE AS day, min(ts) FILTER (value < 40) AS calm, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2)"""


@query(f"""WITH {_DAILY}, u AS (SELECT user_id % 15 AS line, day, CASE WHEN calm IS NOT NULL THEN (epoch_us(calm) - epoch_us(day::TIMESTAMP)) / 60000000.0 ELSE (epoch_us(last_ts) - epoch_us(day::TIMESTAMP)) / 60000000.0 END AS t, calm IS NOT NULL AS ok FROM d)
SELECT line, day, count(*) AS places, CASE WHEN count(*) >= 2 THEN round(max(t), 3) END AS minutes, CASE WHEN count(*) >= 2 THEN bool_and(ok) END AS recovered FROM u GROUP BY 1, 2""")
def line_recovery(spark, sf_dir):
    """A line's recovery: the latest over its places, all recovered, undefined below two places."""
    d = _events(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.min(F.when(F.col("value") < 40, F.col("ts"))).alias("calm"), F.max("ts").alias("last_ts"))
    t = (micros(F.coalesce("calm", "last_ts")) - micros(F.col("day").cast("timestamp_ntz"))) / (60.0 * MICROS)
    enough = lambda c: F.when(F.count(F.lit(1)) >= 2, c)
    return d.groupBy((F.col("user_id") % 15).alias("line"), "day").agg(F.count(F.lit(1)).alias("places"), enough(F.round(F.max(t), 3)).alias("minutes"), enough(F.bool_and(F.col("calm").isNotNull())).alias("recovered"))


@query("""WITH p AS (SELECT event_id, user_id, ts AS t0 FROM events WHERE event_type = 'error'), c AS (SELECT *, date_trunc('minute', t0) + to_days(d::INT) AS control FROM p, (SELECT unnest(range(-14, 15)) AS d) WHERE d <> 0
 AND CASE isodow(t0) WHEN 7 THEN 3 WHEN 6 THEN 2 WHEN 5 THEN 1 ELSE 0 END = CASE isodow(t0 + to_days(d::INT)) WHEN 7 THEN 3 WHEN 6 THEN 2 WHEN 5 THEN 1 ELSE 0 END),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = c.user_id AND o.ts BETWEEN c.control - INTERVAL 1 HOUR AND c.control + INTERVAL 1 HOUR)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY md5('5:' || event_id::VARCHAR || ':' || d::VARCHAR)) AS r, count(*) OVER (PARTITION BY event_id) AS n FROM f) SELECT event_id, control FROM k WHERE n >= 3 AND r <= 3""")
def placebo_times(spark, sf_dir):
    """Matched times at which nothing of any kind happened near by, drawn by hash."""
    e = _events(spark, sf_dir)
    errors = e.where("event_type = 'error'").select("event_id", "user_id", F.col("ts").alias("t0"))
    return eventstudy.matched_controls(errors, e.select("user_id", "ts"), ["user_id"], 14, 60, 60, 3, 5).select("event_id", "control")


@query("""WITH s AS (SELECT user_id, s, min(ts) AS a, max(ts) AS b FROM (SELECT *, coalesce(sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS s FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 10800000000)::INT AS g FROM events)) GROUP BY 1, 2)
SELECT stratum, count(*) AS n FROM (SELECT CASE WHEN m > 0 AND m <= 60 THEN 'short' WHEN m > 60 AND m <= 240 THEN 'medium' WHEN m > 240 THEN 'long' END AS stratum FROM (SELECT (epoch_us(b) - epoch_us(a)) / 60000000.0 AS m FROM s)) GROUP BY 1""")
def duration_strata(spark, sf_dir):
    """Sessions by duration; those of no duration are in no stratum."""
    s = ordered.sessionize(_events(spark, sf_dir), ["user_id"], "ts", "event_id", 180, "s").groupBy("user_id", "s").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    m = (micros("b") - micros("a")) / (60.0 * MICROS)
    return s.groupBy(cut(m, [0, 60, 240, _INF], ["short", "medium", "long"]).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM events WHERE event_type = 'view'), w AS (SELECT * FROM g WHERE ts - pt >= INTERVAL 4 DAYS)
SELECT w.user_id, w.pt AS gap_start, w.ts AS gap_end, count(o.event_id) AS meanwhile FROM w LEFT JOIN events o ON o.user_id = w.user_id AND o.event_type <> 'view' AND o.ts > w.pt AND o.ts < w.ts GROUP BY 1, 2, 3""")
def gap_finder(spark, sf_dir):
    """Long gaps of one kind, with how many others happened meanwhile: running counts at both ends, no range join."""
    e = _events(spark, sf_dir)
    others = F.col("event_type") != "view"
    upto = F.sum(others.cast("long")).over(W.partitionBy("user_id").orderBy(micros("ts")).rangeBetween(W.unboundedPreceding, 0))
    before = F.sum(others.cast("long")).over(W.partitionBy("user_id").orderBy(micros("ts")).rangeBetween(W.unboundedPreceding, -1))
    c = e.withColumn("_upto", upto).withColumn("_before", F.coalesce(before, F.lit(0))).where("event_type = 'view'")
    g = ordered.lag_pairs(c, ["user_id"], ["ts", "event_id"], ["ts", "_upto"])
    return g.where(micros("ts") - micros("ts_prev") >= 96 * HOUR).select("user_id", F.col("ts_prev").alias("gap_start"), F.col("ts").alias("gap_end"), (F.col("_before") - F.col("_upto_prev")).alias("meanwhile"))


@query("""WITH n AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), best AS (SELECT user_id, day FROM n ORDER BY n DESC, user_id, day LIMIT 1)
SELECT row_number() OVER (ORDER BY first_ts, event_type) AS rank, event_type FROM (SELECT event_type, min(ts) AS first_ts FROM events e JOIN best ON e.user_id = best.user_id AND e.ts::DATE = best.day GROUP BY 1)""")
def route_order(spark, sf_dir):
    """The order of stops along the longest trip."""
    e = _events(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))
    best = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id", "day").limit(1).select("user_id", "day")
    stops = e.join(F.broadcast(best), ["user_id", "day"]).groupBy("event_type").agg(F.min("ts").alias("first_ts"))
    return stops.select(F.row_number().over(W.orderBy("first_ts", "event_type")).cast("long").alias("rank"), "event_type")


@query("""SELECT n_name AS place, count(*) AS traffic, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 0 AND 8000 GROUP BY 1 ORDER BY traffic DESC, place LIMIT 12""")
def busiest_places(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    x = o.join(c.where(F.col("c_acctbal").between(0, 8000)), o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    g = x.groupBy(F.col("n_name").alias("place")).agg(F.count(F.lit(1)).alias("traffic"), F.count_distinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))
    return g.orderBy(F.desc("traffic"), "place").limit(12)


@query()
def platt_calibration(spark, sf_dir):
    a, b = evaluate.platt(models._forecast(spark, sf_dir), "p", "y")
    return spark.createDataFrame([(a, b)], "slope double, offset double")


@query()
def var_forecast_errors(spark, sf_dir):
    b = models._blocks(spark, sf_dir)
    return var.forecast_errors(b, var.fit_var(b, models.TYPES, 1), (1, 3))


@query()
def var_of_differences(spark, sf_dir):
    """The autoregression of first differences, with responses added up along the steps."""
    m = var.fit_var(var.difference(models._blocks(spark, sf_dir), models.TYPES), models.TYPES, 1)
    r = m.responses(6).cumsum(0)
    return spark.createDataFrame([(s, of, to, float(r[s, i, j])) for s in range(7) for i, of in enumerate(models.TYPES) for j, to in enumerate(models.TYPES)], "step int, of string, to string, cumulated double")


@query()
def var_by_daytime(spark, sf_dir):
    """The autoregression fitted apart on two halves of the day."""
    b = models._blocks(spark, sf_dir)
    rows = []
    for name, part in (("day", F.hour("window").between(6, 17)), ("night", ~F.hour("window").between(6, 17))):
        cutout = b.where(part).drop("episode", "step")
        m = var.fit_var(var.episodes(cutout, models.TYPES, "window", 180, 2), models.TYPES, 1)
        rows += [(name, m.rows, t, float(m.lag(1)[i, i])) for i, t in enumerate(models.TYPES)]
    return spark.createDataFrame(rows, "part string, rows int, series string, own_lag double")
