"""Grids, sessions, runs, pairs and range joins on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, floor_to, micros
from stroma.functions.numbers import r6
from stroma.operators import grid, ordered, ranges
from stroma.operators.components import connected_components
from stroma.plans.base import query, table

HOUR = 3600 * MICROS

_GRID = """axis AS (SELECT unnest(generate_series((SELECT time_bucket(INTERVAL 15 MINUTES, min(ts)) FROM events), (SELECT time_bucket(INTERVAL 15 MINUTES, max(ts)) FROM events), INTERVAL 15 MINUTES)) AS "window"),
types AS (SELECT DISTINCT event_type FROM events),
cells AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS "window", event_type, count(*) FILTER (value >= 2) AS n, avg(value) FILTER (value >= 2) AS mean, median(value) FILTER (value >= 2) AS median,
 quantile_cont(value, 0.9) FILTER (value >= 2) AS p90, avg((value > 100)::INT) FILTER (value >= 2) AS share_over, count(*) FILTER (value < 2) AS n_cancelled FROM events GROUP BY 1, 2)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute state of each event type; values below 2 stand for cancelled events."""
    return grid.state_grid(table(spark, sf_dir, "events"), "event_type", "ts", "value", 15, 100.0, F.col("value") < 2)


@query(f"""WITH {_GRID} SELECT "window", event_type, n, round(mean, 6) AS mean, round(median, 6) AS median, round(p90, 6) AS p90, round(share_over, 6) AS share_over, n_cancelled
FROM (SELECT * FROM axis, types) LEFT JOIN cells USING ("window", event_type)""")
def state_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("window", "event_type", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "p90", "share_over")], "n_cancelled")


@query("""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS "window", count(g) AS n_gaps, round(CASE WHEN count(g) >= 2 AND avg(g) > 0 THEN stddev_samp(g) / avg(g) END, 6) AS cv FROM
(SELECT user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 60000000.0 AS g FROM events) WHERE g IS NOT NULL GROUP BY 1, 2""")
def gap_cv(spark, sf_dir):
    return grid.gap_variation(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 1440).withColumn("cv", r6(F.col("cv")))


@query("""SELECT event_type, CASE WHEN time_bucket(INTERVAL 5 MINUTES, ts) = ts THEN ts ELSE time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES END AS "window", count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def right_closed_grid(spark, sf_dir):
    return grid.right_closed(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", 5).withColumn("total", r6(F.col("total")))


@query(f"""WITH {_GRID} SELECT "window", event_type, round(coalesce(mean, last_value(mean IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY "window" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)), 6) AS filled
FROM (SELECT * FROM axis, types) LEFT JOIN cells USING ("window", event_type)""")
def ffill_limit(spark, sf_dir):
    return ordered.forward_fill(_cells(spark, sf_dir), ["event_type"], ["window"], "mean", 6, "filled").select("window", "event_type", r6(F.col("filled")).alias("filled"))


@query(f"""WITH {_GRID}, g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY "window") AS i FROM (SELECT * FROM axis, types) LEFT JOIN cells USING ("window", event_type)),
b AS (SELECT *, last_value(CASE WHEN mean IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(mean IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN mean IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni, first_value(mean IGNORE NULLS) OVER q AS nv
 FROM g WINDOW p AS (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT "window", event_type, round(CASE WHEN mean IS NOT NULL THEN mean WHEN pi IS NOT NULL AND ni IS NOT NULL AND i - pi <= 12 THEN pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS filled FROM b""")
def interp_limit(spark, sf_dir):
    return ordered.interpolate(_cells(spark, sf_dir), ["event_type"], ["window"], "mean", 12, "filled").select("window", "event_type", r6(F.col("filled")).alias("filled"))


@query(f"""WITH {_GRID}, g AS (SELECT "window", event_type, coalesce(n, 0) AS n FROM (SELECT * FROM axis, types) LEFT JOIN cells USING ("window", event_type))
SELECT "window", event_type, sum(n) OVER (PARTITION BY event_type ORDER BY "window" ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)::BIGINT AS sum12, max(n) OVER (PARTITION BY event_type ORDER BY "window" ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS max13 FROM g""")
def rolling_windows(spark, sf_dir):
    g = _cells(spark, sf_dir).select("window", "event_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return grid.rolling(grid.rolling(g, ["event_type"], "window", "n", 11, 0, "sum12"), ["event_type"], "window", "n", 6, 6, "max13", "max").drop("n")


@query("""SELECT event_id, user_id, 1 + coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS session FROM
(SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000)::INT AS b FROM events)""")
def sessionize(spark, sf_dir):
    return ordered.sessionize(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 30, "session").select("event_id", "user_id", "session")


@query("""WITH s AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS s FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 7200000000)::INT AS b FROM events)),
c AS (SELECT user_id, event_type, s, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM s GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY event_type ORDER BY t0, user_id ROWS UNBOUNDED PRECEDING), 0) AS ep FROM (SELECT *, (epoch_us(t0) - lag(epoch_us(t0)) OVER (PARTITION BY event_type ORDER BY t0, user_id) > 900000000)::INT AS b FROM c))
SELECT event_type, min(t0) AS t0, max(t1) AS t1, count(DISTINCT user_id) AS users, sum(n)::BIGINT AS n, round((epoch_us(max(t1)) - epoch_us(min(t0))) / 60000000.0, 3) AS minutes FROM e GROUP BY event_type, ep""")
def two_level_episodes(spark, sf_dir):
    """Clusters of each user and type (gap two hours), then episodes of each type over all users (gap 15 minutes)."""
    s = ordered.sessionize(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 120, "s")
    clusters = s.groupBy("user_id", "event_type", "s").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n"))
    e = ordered.sessionize_by_days(clusters, ["event_type"], "t0", "user_id", 15, "ep")
    return e.groupBy("event_type", "ep").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count_distinct("user_id").alias("users"), F.sum("n").alias("n"), F.round((micros(F.max("t1")) - micros(F.min("t0"))) / (60.0 * MICROS), 3).alias("minutes")).drop("ep")


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM
(SELECT *, sum((NOT (value < 60))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM events) WHERE value < 60 GROUP BY user_id, r HAVING count(*) >= 3 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 3600000000""")
def zero_runs(spark, sf_dir):
    r = ordered.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 60)
    g = r.groupBy("user_id", "run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    span = micros("last_ts") - micros("first_ts")
    return g.where((F.col("n") >= 3) & (span >= HOUR)).select("user_id", "first_ts", "last_ts", "n", r6(span / 1e6).alias("seconds"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, s) AS n, min(l_linenumber) OVER (PARTITION BY l_orderkey, s) AS f FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3))) QUALIFY f = first_value(f) OVER (PARTITION BY l_orderkey ORDER BY n DESC, f ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def longest_path_segment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <> 3").select("l_orderkey", "l_linenumber").distinct()
    return ordered.longest_run(li, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""WITH o AS (SELECT *, max((value >= 10)::INT) OVER w AS ran FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, max((value < 10 AND ran = 1)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS gone FROM o""")
def absorbing_state(spark, sf_dir):
    return ordered.absorbing(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 10, "gone").select("event_id", "gone")


@query("""SELECT event_id, event_id_prev, round((epoch_us(ts) - epoch_us(ts_prev)) / 60000000.0, 3) AS gap_minutes, round(value - value_prev, 6) AS change FROM
(SELECT event_id, ts, value, lag(event_id) OVER w AS event_id_prev, lag(ts) OVER w AS ts_prev, lag(value) OVER w AS value_prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_id_prev IS NOT NULL""")
def lag_pairs(spark, sf_dir):
    p = ordered.lag_pairs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "ts", "value"])
    return p.select("event_id", "event_id_prev", F.round((micros("ts") - micros("ts_prev")) / (60.0 * MICROS), 3).alias("gap_minutes"), r6(F.col("value") - F.col("value_prev")).alias("change"))


@query("""SELECT p.event_id, p.user_id, s.event_id AS asof_event_id, round(s.value, 6) AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) s ON p.user_id = s.user_id AND p.ts > s.ts""")
def asof_strict(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = ranges.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", ["event_id", "value"], "event_id")
    return found.select("event_id", "user_id", "asof_event_id", r6(F.col("asof_value")).alias("asof_value"))


@query("""WITH p AS (SELECT p.event_id, p.ts, s.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) s ON p.user_id = s.user_id AND p.ts > s.ts),
n AS (SELECT event_id AS before, lead(value) OVER w AS nv, lead(ts) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT p.event_id, p.before, round(CASE WHEN n.nt < p.ts THEN n.nv END, 6) AS known_next FROM p LEFT JOIN n USING (before)""")
def asof_then_probe(spark, sf_dir):
    """The row found as-of, then what followed it, as far as it was known before the probe's time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    following = e.select(F.col("event_id").alias("before"), F.lead("value").over(w).alias("_v"), F.lead("ts").over(w).alias("_t"))
    found = ranges.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", ["event_id"], "event_id").withColumnRenamed("asof_event_id", "before")
    return found.join(following, "before", "left").select("event_id", "before", r6(F.when(F.col("_t") < F.col("ts"), F.col("_v"))).alias("known_next"))


@query("""SELECT e.event_id, (SELECT min(o.ts) FROM events o WHERE o.user_id = e.user_id AND o.event_type <> e.event_type AND o.ts > e.ts) AS next_other FROM events e""")
def asof_forward_other_id(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return ranges.forward_other(e, ["user_id"], "ts", "event_type", "next_other").select("event_id", "next_other")


@query("""SELECT e.event_id, count(o.event_id) AS n, count(DISTINCT o.event_type) FILTER (o.event_type <> e.event_type) AS other_types FROM events e LEFT JOIN events o
ON o.user_id = e.user_id AND epoch_us(o.ts) >= epoch_us(e.ts) - 43200000000 AND epoch_us(o.ts) < epoch_us(e.ts) GROUP BY e.event_id""")
def window_counts(spark, sf_dir):
    """Events in [t - 12 h, t) and the distinct other types among them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    counted = ranges.range_count(e, e, ["user_id"], "ts", -12 * HOUR, -1, "n")
    o = e.select("user_id", F.col("ts").alias("ts2"), F.col("event_type").alias("type2"))
    pairs = ranges.range_pairs(e, o, ["user_id"], -12 * HOUR, -1, "ts", "ts2").where("type2 <> event_type")
    kinds = pairs.groupBy("event_id").agg(F.count_distinct("type2").alias("other_types"))
    return counted.join(kinds, "event_id", "left").select("event_id", "n", F.coalesce("other_types", F.lit(0)).cast("long").alias("other_types"))


@query("""WITH i AS (SELECT user_id, ts AS s, ts + to_minutes((value)::INT) AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum((r IS NULL OR s > r)::INT) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY user_id, g""")
def interval_merge(spark, sf_dir):
    return ranges.merge_intervals(_intervals(spark, sf_dir), ["user_id"], "s", "e")


def _intervals(spark, sf_dir) -> DataFrame:
    minutes = F.rint("value").cast("int")
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("e"))


@query("""WITH b AS (SELECT user_id, ts AS s, ts + to_minutes((value)::INT) AS e FROM events WHERE event_type = 'error'), p AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 2 HOURS AS e FROM events WHERE event_type = 'purchase')
SELECT event_id, EXISTS (SELECT 1 FROM b WHERE b.user_id = p.user_id AND b.s < p.e AND b.e > p.s AND b.s < b.e) AS overlaps FROM p""")
def interval_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    blocks = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.make_dt_interval(mins=F.rint("value").cast("int"))).alias("e")).where("s < e")
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("e"))
    return ranges.overlaps(probes, ranges.merge_intervals(blocks, ["user_id"], "s", "e"), ["user_id"], "s", "e").select("event_id", "overlaps")


@query("""SELECT event_id, ts FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS p, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS n FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts))
WHERE (p IS NULL OR p > 3600000000) AND (n IS NULL OR n > 14400000000)""")
def drop_overlapping_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return ranges.drop_close(e, ["user_id"], "ts", F.lit(HOUR), F.lit(4 * HOUR)).select("event_id", "ts")


@query("""WITH r AS (SELECT user_id, ts, event_id, value, ts::DATE AS d, row_number() OVER w AS i, value < 80 AND lead(value, 1) OVER w < 80 AND lead(value, 2) OVER w < 80 AND lead(ts, 2) OVER w - ts <= INTERVAL 3 DAYS AS ok, lead(ts, 2) OVER w AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a.event_id, round((epoch_us(min(b.ts)) - epoch_us(any_value(a.ts))) / 60000000.0, 3) AS minutes FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.i >= a.i AND b.ok WHERE a.value >= 200 GROUP BY a.event_id""")
def next_triple_recovery(spark, sf_dir):
    """Minutes until the first of three values in a row below 80, the third at most three days after the first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    soon = F.lead("ts", 2).over(w) - F.col("ts") <= F.expr("INTERVAL 3 DAYS")
    marked = ordered.triple(e.withColumn("_soon", soon).withColumn("_k", F.lit(1)), ["user_id"], ["ts", "event_id"], F.col("value") < 80, F.col("_k"), "ok")
    marked = marked.withColumn("ok", F.col("ok") & F.coalesce("_soon", F.lit(False)))
    found = ordered.next_with(marked, ["user_id"], ["ts", "event_id"], F.col("ok"), ["ts"])
    return found.where("value >= 200").select("event_id", F.round((micros("next_ts") - micros("ts")) / (60.0 * MICROS), 3).alias("minutes"))


@query("""WITH g AS (SELECT o_orderdate::DATE AS d, c_nationkey AS n, o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
p AS (SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.d = b.d AND a.n = b.n AND a.c < b.c GROUP BY 1, 2 HAVING count(*) >= 2),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
t AS (WITH RECURSIVE r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a) SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT component, count(*) AS members, round(sum(c_acctbal), 2) AS balance, bool_and(c_acctbal < 0) AS all_negative FROM (SELECT c_custkey, coalesce(component, c_custkey) AS component, c_acctbal FROM customer LEFT JOIN t ON c_custkey = node) GROUP BY 1""")
def convoy_components(spark, sf_dir):
    """Customers of one nation with orders on two common days or more, closed transitively, collapsed to one row a component."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    g = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderdate").cast("date").alias("d"), F.col("c_nationkey").alias("n"), F.col("o_custkey").alias("c")).distinct()
    # two common days are one common pair of days: its customers are linked with the first of them, so no key makes all its pairs
    days = g.groupBy("c", "n").agg(F.array_sort(F.collect_list("d")).alias("days"))  # a customer's own days
    twice = days.select("c", "n", F.explode("days").alias("d1"), "days").select("c", "n", "d1", F.explode(F.filter("days", lambda d: d > F.col("d1"))).alias("d2"))
    hubs = twice.groupBy("n", "d1", "d2").agg(F.min("c").alias("a"), F.max("c").alias("_far")).where("a <> _far").drop("_far")
    pairs = twice.join(hubs, ["n", "d1", "d2"]).where("c <> a").select("a", F.col("c").alias("b"))
    named = c.join(connected_components(pairs, "convoys"), F.col("c_custkey") == F.col("node"), "left").withColumn("component", F.coalesce("component", "c_custkey"))
    return named.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.bool_and(F.col("c_acctbal") < 0).alias("all_negative"))


_QUIET = f"""WITH {_GRID}, g AS (SELECT (epoch_us("window") // 900000000)::BIGINT AS slot, max(coalesce(n, 0)) OVER (ORDER BY "window" ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)::BIGINT AS score,
 count(*) OVER (ORDER BY "window" ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS ahead FROM axis LEFT JOIN (SELECT * FROM cells WHERE event_type = 'click') USING ("window")), w AS (SELECT slot, score FROM g WHERE ahead = 12)"""
for _k in range(5):
    _free = " AND ".join(f"abs(slot - (SELECT slot FROM p{j})) >= 12" for j in range(_k)) or "TRUE"
    _QUIET += f", p{_k} AS (SELECT slot, score FROM w WHERE {_free} ORDER BY score, slot LIMIT 1)"
_QUIET += " " + " UNION ALL ".join(f"SELECT * FROM p{_k}" for _k in range(5))


@query(_QUIET)
def quiet_periods(spark, sf_dir):
    """The quietest non-overlapping stretches of 12 windows, by their busiest window, picked greedily."""
    g = _cells(spark, sf_dir).where("event_type = 'click'").select("window", F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("event_type", F.lit("click"))
    scored = grid.rolling(grid.rolling(g, ["event_type"], "window", "n", 0, 11, "score", "max"), ["event_type"], "window", "n", 0, 11, "_ahead", "count").where("_ahead = 12")
    scored = scored.select(F.floor(micros("window") / (15 * 60 * MICROS)).cast("long").alias("slot"), F.col("score").cast("long").alias("score"))
    return ordered.greedy_windows(scored, "slot", "score", 12, 5, ascending=True)


@query("""SELECT "window"::TIMESTAMP AS "window", (timezone('Europe/Berlin', timezone('UTC', "window")))::TIMESTAMP AS window_local FROM (SELECT unnest(generate_series(timezone('UTC', timezone('Europe/Berlin', TIMESTAMP '2025-03-29')), timezone('UTC', timezone('Europe/Berlin', TIMESTAMP '2025-04-01')) - INTERVAL 5 MINUTES, INTERVAL 5 MINUTES)) AS "window")""")
def local_day_grid(spark, sf_dir):
    return grid.local_axis(spark, "2025-03-29", "2025-03-31", "Europe/Berlin", 5)


@query("""SELECT event_type, day, n, low, CASE WHEN n >= 2 AND low >= 0.5 THEN 'A' WHEN n >= 5 AND low < 0.05 THEN 'B' END AS kind FROM (SELECT event_type, date_trunc('hour', ts) AS day, count(*) AS n, round(avg((value < 40)::INT), 6) AS low FROM events GROUP BY 1, 2)""")
def outage_hours(spark, sf_dir):
    """Hourly blocks by the share of conspicuous values, classified by count and share."""
    h = table(spark, sf_dir, "events").groupBy("event_type", floor_to("ts", 60).alias("day")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("value") < 40).cast("int"))).alias("low"))
    return h.withColumn("kind", F.when((F.col("n") >= 2) & (F.col("low") >= 0.5), "A").when((F.col("n") >= 5) & (F.col("low") < 0.05), "B"))
