"""Features of transitions, their splits, calibration, and the evaluation of simulated runs on the test tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, micros
from stroma.functions.numbers import r6
from stroma.operators import evaluate, features, ranges, simulate
from stroma.plans.base import query, table
from stroma.plans.models import _stops as _plain_stops
from stroma.sources.tables import materialise

HOUR = 3600 * MICROS

# users are vehicles, types places; a cancelled stop has no delay
_STOPS = """s AS (SELECT ts::DATE AS day, user_id AS vehicle, user_id % 7 AS line, user_id % 2 AS way, event_type AS place, ts AS sched, value / 20 AS delay, value > 150 AS cancelled, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""
_FEATURES = f"""{_STOPS}, r AS (SELECT *, CASE WHEN NOT cancelled THEN make_timestamp(epoch_us(sched) + trunc(delay * 60000000)::BIGINT) END AS t FROM s),
l AS (SELECT *, lag(CASE WHEN NOT cancelled THEN delay END) OVER w AS d_km1 FROM r WINDOW w AS (PARTITION BY day, vehicle ORDER BY pos)),
k AS (SELECT day, vehicle, line, way, pos AS next_pos, place, sched, delay, cancelled, lag(pos) OVER w AS pos, lag(place) OVER w AS here, lag(sched) OVER w AS sched_k, lag(delay) OVER w AS d_k, lag(cancelled) OVER w AS gone_k, lag(t) OVER w AS t, lag(d_km1) OVER w AS d_km1 FROM l WINDOW w AS (PARTITION BY day, vehicle ORDER BY pos)),
b AS (SELECT * FROM k WHERE pos IS NOT NULL AND NOT gone_k), ran AS (SELECT day, place, t, vehicle, sched, delay FROM r WHERE NOT cancelled), gone AS (SELECT day, place, way, sched AS t FROM r WHERE cancelled),
p1 AS (SELECT b.day, b.vehicle, b.pos, arg_max({{'s': x.sched, 'd': x.delay, 't': x.t}}, (x.t, x.vehicle)) AS x FROM b JOIN ran x ON x.day = b.day AND x.place = b.place AND x.t < b.t GROUP BY 1, 2, 3),
p0 AS (SELECT b.day, b.vehicle, b.pos, arg_max(x.delay, (x.t, x.vehicle)) AS d FROM b JOIN ran x ON x.day = b.day AND x.place = b.here AND x.t < b.t GROUP BY 1, 2, 3),
n AS (SELECT b.day, b.vehicle, b.pos, count(*) AS n, avg(x.delay) AS m FROM b JOIN ran x ON x.day = b.day AND x.t < b.t AND x.t >= b.t - INTERVAL 15 MINUTES GROUP BY 1, 2, 3),
c AS (SELECT b.day, b.vehicle, b.pos, count(*) AS n, count(*) FILTER (x.place = b.here AND x.way = b.way) AS h FROM b JOIN gone x ON x.day = b.day AND x.t < b.t AND x.t >= b.t - INTERVAL 30 MINUTES GROUP BY 1, 2, 3),
f AS (SELECT b.day, b.vehicle, b.pos, b.t AS T, d_k, d_km1, b.pos AS rank, way, line, hour(sched_k) AS hour, hour(sched_k) IN (6, 7, 8, 9, 15, 16, 17, 18, 19) AS rush, CASE isodow(sched_k) WHEN 7 THEN 'sunday' WHEN 6 THEN 'saturday' WHEN 5 THEN 'friday' ELSE 'workday' END AS day_kind,
 (epoch_us(sched) - epoch_us(p1.x.s)) / 60000000.0 AS plan_gap_pred, (epoch_us(b.t) - epoch_us(p1.x.t)) / 60000000.0 AS act_gap_pred, p0.d AS d_pred_k, p1.x.d AS d_pred_k1, n.m AS net_mean15, coalesce(n.n, 0) AS net_n15, coalesce(c.h, 0) AS cancel_here30, coalesce(c.n, 0) AS cancel_net30,
 (epoch_us(sched) - epoch_us(sched_k)) / 60000000.0 AS plan_run, cancelled AS cancelled_next, CASE WHEN NOT cancelled THEN delay END AS d_next, CASE WHEN NOT cancelled THEN delay END - d_k AS delta
 FROM b LEFT JOIN p1 USING (day, vehicle, pos) LEFT JOIN p0 USING (day, vehicle, pos) LEFT JOIN n USING (day, vehicle, pos) LEFT JOIN c USING (day, vehicle, pos))"""
_MINUTES = ["plan_gap_pred", "act_gap_pred", "plan_run"]
_REAL = ["d_k", "d_km1", "d_pred_k", "d_pred_k1", "net_mean15", "d_next", "delta"]


def _stops(spark, sf_dir) -> DataFrame:
    return _plain_stops(spark, sf_dir).withColumn("line", F.col("vehicle") % 7).withColumn("way", F.col("vehicle") % 2).withColumn("pos", F.col("pos").cast("long"))


def _features(spark, sf_dir) -> DataFrame:
    return features.transition_features(_stops(spark, sf_dir))


@query(f"WITH {_FEATURES} SELECT * REPLACE ({', '.join([*(f'round({c}, 6) AS {c}' for c in _REAL if c != 'net_mean15'), 'round(net_mean15 * net_n15, 6) AS net_mean15', *(f'round({c} * 60000000)::BIGINT AS {c}' for c in _MINUTES)])}) FROM f")
def transition_features(spark, sf_dir):
    """All that is known strictly before each step's decision; spans of time in microseconds, the mean of the network as a sum, so that no exact half is rounded."""
    return _features(spark, sf_dir).withColumns({c: r6(F.col(c) * (F.col("net_n15") if c == "net_mean15" else 1)) for c in _REAL} | {c: F.round(F.col(c) * 60_000_000).cast("long") for c in _MINUTES})


@query(f"WITH {_FEATURES} SELECT CASE WHEN day(day) <= 17 THEN 'fit' WHEN day(day) <= 20 THEN 'stop' WHEN day(day) <= 23 THEN 'check' ELSE 'test' END AS part, count(*) AS n, count(*) FILTER (cancelled_next) AS cancelled, round(avg(delta), 6) AS mean_change FROM f WHERE plan_run <= 600 GROUP BY 1")
def feature_split(spark, sf_dir):
    """Rows of the four parts by day, long planned runs left out."""
    parts = {"fit": [*range(1, 18)], "stop": [18, 19, 20], "check": [21, 22, 23], "test": [*range(24, 32)]}
    s = features.split_by_period(_features(spark, sf_dir).withColumn("_d", F.dayofmonth("day")), "_d", parts, 600)
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("cancelled_next").alias("cancelled"), r6(F.avg("delta")).alias("mean_change"))


@query(f"WITH {_FEATURES} SELECT CASE WHEN delta < -3.5 THEN 'below' ELSE 'above' END AS tail, count(*) AS n, round(median(delta), 6) AS median, round(quantile_cont(delta, 0.1), 6) AS q10, round(quantile_cont(delta, 0.9), 6) AS q90 FROM f WHERE delta < -3.5 OR delta >= 15.5 GROUP BY 1")
def tail_changes(spark, sf_dir):
    """Changes that the classes clip, at either end."""
    t = _features(spark, sf_dir).where("delta < -3.5 or delta >= 15.5")
    return t.groupBy(F.when(F.col("delta") < -3.5, "below").otherwise("above").alias("tail")).agg(F.count(F.lit(1)).alias("n"), r6(F.median("delta")).alias("median"), r6(F.percentile("delta", 0.1)).alias("q10"), r6(F.percentile("delta", 0.9)).alias("q90"))


_RARE = f"{_FEATURES}, z AS (SELECT least(floor(greatest(d_k, 0) / 3), 4)::INT AS own, CASE WHEN d_pred_k1 IS NULL THEN -1 ELSE least(floor(greatest(d_pred_k1, 0) / 3), 4)::INT END AS before, d_k FROM f), m AS (SELECT own, before, count(*) AS n FROM z GROUP BY 1, 2)"


@query(f"WITH {_RARE} SELECT own, before, n, n < 30 AS rare FROM m")
def rare_cells(spark, sf_dir):
    """Cells of own and predecessor's delay that hardly ever occur."""
    bin_ = lambda c: F.least(F.floor(F.greatest(F.col(c), F.lit(0.0)) / 3), F.lit(4)).cast("int")
    z = _features(spark, sf_dir).select(bin_("d_k").alias("own"), F.coalesce(F.when(F.col("d_pred_k1").isNotNull(), bin_("d_pred_k1")), F.lit(-1)).alias("before"))
    return z.groupBy("own", "before").agg(F.count(F.lit(1)).alias("n")).withColumn("rare", F.col("n") < 30)


@query(f"""WITH {_RARE}, j AS (SELECT own, before, count(*) AS n FROM (SELECT 0 AS own, before FROM z) GROUP BY 1, 2) SELECT sum(j.n)::BIGINT AS n, coalesce(sum(j.n) FILTER (m.n IS NULL OR m.n < 30), 0)::BIGINT AS in_rare FROM j LEFT JOIN m USING (own, before)""")
def on_time_entry(spark, sf_dir):
    """All vehicles entering on time: how many steps then fall into cells that were rarely seen."""
    cells = rare_cells(spark, sf_dir)
    bin_ = F.least(F.floor(F.greatest(F.col("d_pred_k1"), F.lit(0.0)) / 3), F.lit(4)).cast("int")
    forced = _features(spark, sf_dir).select(F.lit(0).alias("own"), F.coalesce(F.when(F.col("d_pred_k1").isNotNull(), bin_), F.lit(-1)).alias("before"))
    j = forced.groupBy("own", "before").agg(F.count(F.lit(1)).alias("m")).join(cells, ["own", "before"], "left")
    return j.agg(F.sum("m").alias("n"), F.coalesce(F.sum(F.when(F.coalesce("rare", F.lit(True)), F.col("m"))), F.lit(0)).alias("in_rare"))


@query(f"""WITH {_FEATURES}, kk AS (SELECT count(*) AS n, count(*) FILTER (d_pred_k IS NOT NULL AND floor(d_pred_k) <> d_pred_k) AS a, count(*) FILTER (d_km1 IS NOT NULL) AS b FROM f) SELECT 'd_k' AS "column", n, 0::BIGINT AS different, 0::BIGINT AS only_a, 0::BIGINT AS only_b FROM kk UNION ALL SELECT 'd_pred_k', n, a, 0, 0 FROM kk UNION ALL SELECT 'd_km1', n, b, 0, 0 FROM kk""")
def forced_differences(spark, sf_dir):
    """Two tables of features compared column by column, as when a rollout is fed what really happened."""
    f = _features(spark, sf_dir).select("day", "vehicle", "pos", "d_k", "d_pred_k", "d_km1")
    other = f.withColumn("d_pred_k", F.floor("d_pred_k").cast("double")).withColumn("d_km1", F.lit(None).cast("double"))
    return features.difference_counts(f, other, ["day", "vehicle", "pos"], ["d_k", "d_pred_k", "d_km1"], 0.0)


@query("""WITH d AS (SELECT user_id AS vehicle, ts::DATE AS day, count(*) AS n, user_id || '|' || ts::DATE AS key FROM events GROUP BY 1, 2), s AS (SELECT *, CASE WHEN n <= 2 THEN 'short' WHEN n <= 4 THEN 'middle' ELSE 'long' END AS stratum FROM d)
SELECT stratum, vehicle, day FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('13:' || key), key) AS r FROM s) WHERE r <= 10""")
def stratified_days(spark, sf_dir):
    """Ten vehicle days of each length, drawn by hash."""
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vehicle"), F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.concat_ws("|", "vehicle", "day"))
    d = d.withColumn("stratum", F.when(F.col("n") <= 2, "short").when(F.col("n") <= 4, "middle").otherwise("long"))
    return features.stratified(d, ["stratum"], "key", 10, 13).select("stratum", "vehicle", "day")


_TEMPERED = """c AS (SELECT event_id, ts::DATE AS day, event_type AS now, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), k AS (SELECT * FROM c WHERE nxt IS NOT NULL), t AS (SELECT DISTINCT event_type AS cls FROM events),
g AS (SELECT now, nxt AS cls, count(*) AS n FROM k GROUP BY 1, 2), law AS (SELECT a.now, t.cls, (coalesce(g.n, 0) + 1) / (sum(coalesce(g.n, 0) + 1) OVER (PARTITION BY a.now)) AS p FROM (SELECT DISTINCT now FROM k) a CROSS JOIN t LEFT JOIN g ON g.now = a.now AND g.cls = t.cls),
q AS (SELECT CASE WHEN day(k.day) % 2 = 1 THEN 'odd' ELSE 'even' END AS half, event_id, temperature, sum(pow(p, 1 / temperature)) AS z, max(CASE WHEN cls = nxt THEN pow(p, 1 / temperature) END) AS hit FROM k JOIN law USING (now) CROSS JOIN (SELECT unnest([0.5, 1, 2]::DOUBLE[]) AS temperature) GROUP BY 1, 2, 3),
grid AS (SELECT half, temperature, count(*) AS n, round(avg(-ln(hit / z)), 6) AS log_loss FROM q GROUP BY 1, 2)"""


@query(f"WITH {_TEMPERED} SELECT half, temperature, n, log_loss, temperature = (SELECT arg_min(temperature, (log_loss, temperature)) FROM grid WHERE half = 'odd') AS picked FROM grid")
def temperature_calibration(spark, sf_dir):
    """Log loss at several temperatures, picked on odd days and looked at on even ones."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = table(spark, sf_dir, "events").select("event_id", F.when(F.dayofmonth("ts") % 2 == 1, "odd").otherwise("even").alias("half"), F.col("event_type").alias("now"), F.lead("event_type").over(w).alias("nxt")).where("nxt is not null")
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("cls")).distinct()
    g = k.groupBy("now", F.col("nxt").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    law = k.select("now").distinct().crossJoin(F.broadcast(types)).join(g, ["now", "cls"], "left")  # types squared
    law = law.withColumn("m", F.coalesce("n", F.lit(0)) + 1).withColumn("p", F.col("m") / F.sum("m").over(W.partitionBy("now"))).select("now", "cls", "p")
    grid = evaluate.temperature_grid(k.join(F.broadcast(law), "now"), ["half"], ["event_id"], "cls", "p", "nxt", [0.5, 1, 2]).withColumn("log_loss", r6(F.col("log_loss")))
    best = evaluate.best_temperature(grid.where("half = 'odd'"), []).select(F.col("temperature").alias("_t"))
    return grid.crossJoin(F.broadcast(best)).select("half", "temperature", "n", "log_loss", (F.col("temperature") == F.col("_t")).alias("picked"))


_SPLIT = f"{_STOPS}, sim AS (SELECT * FROM s WHERE vehicle % 3 <> 0), re AS (SELECT * FROM s WHERE vehicle % 3 = 0)"


def _criteria_sql() -> str:
    stats = lambda t: f"SELECT place, avg(delay) FILTER (NOT cancelled) AS a, avg((delay > 4)::INT) FILTER (NOT cancelled) AS c, avg(cancelled::INT) AS d, stddev_samp(delay) FILTER (NOT cancelled) AS e FROM {t} GROUP BY 1"
    rows = [("a", "x.a", "y.a", "abs(x.a - y.a) <= 1"), ("b", "0.9", "i.b", "i.b >= 0.8"), ("c", "x.c", "y.c", "abs(x.c - y.c) <= 0.05"), ("d", "x.d", "y.d", "abs(x.d - y.d) <= 0.02"), ("e", "x.e", "y.e", "abs(x.e - y.e) <= 0.25 * y.e")]
    edges = "SELECT place, quantile_cont(delay, 0.05) FILTER (NOT cancelled) AS lo, quantile_cont(delay, 0.95) FILTER (NOT cancelled) AS hi FROM sim GROUP BY 1"
    inside = f"SELECT place, avg((delay BETWEEN lo AND hi)::INT) AS b FROM re JOIN ({edges}) USING (place) WHERE NOT cancelled GROUP BY 1"
    return f"WITH {_SPLIT}, x AS ({stats('sim')}), y AS ({stats('re')}), i AS ({inside}) " + " UNION ALL ".join(f"SELECT x.place, '{n}' AS criterion, round({s}, 6)::DOUBLE AS simulated, round({r}, 6) AS real, {m} AS met FROM x JOIN y USING (place) JOIN i USING (place)" for n, s, r, m in rows)


@query(_criteria_sql())
def simulation_criteria(spark, sf_dir):
    """The five criteria by place, one part of the vehicles standing for runs and the other for what happened."""
    s = _stops(spark, sf_dir)
    c = evaluate.criteria(s.where("vehicle % 3 <> 0"), s.where("vehicle % 3 = 0"), ["place"], "delay", "cancelled", 4.0)
    return c.select("place", "criterion", r6(F.col("simulated")).alias("simulated"), r6(F.col("real")).alias("real"), "met")


@query(f"WITH {_STOPS} SELECT place, pos % 3 AS pos, count(*) AS runs, round(avg(cancelled::INT), 6) AS cancelled_share, round(quantile_cont(delay, 0.05), 6) AS q05, round(quantile_cont(delay, 0.5), 6) AS q50, round(quantile_cont(delay, 0.95), 6) AS q95 FROM s GROUP BY 1, 2")
def result_quantiles(spark, sf_dir):
    """The table of results: quantiles of the delay and the share cancelled."""
    t = simulate.result_table(_stops(spark, sf_dir).withColumn("pos", F.col("pos") % 3), ["place", "pos"], "delay")
    return t.select("place", "pos", "runs", *[r6(F.col(c)).alias(c) for c in ("cancelled_share", "q05", "q50", "q95")])


@query(f"""WITH {_STOPS}, b AS (SELECT place, (date_part('hour', sched) // 2)::BIGINT AS block, avg(delay - 2.5) AS mean, stddev_samp(delay) / sqrt(count(*)) AS se FROM s GROUP BY 1, 2), o AS (SELECT *, abs(mean) < 0.1 OR abs(mean) <= 1.96 * coalesce(se, 0) AS over FROM b)
SELECT place, CASE WHEN max(block) FILTER (NOT over) IS NULL THEN 0 WHEN max(block) FILTER (NOT over) < max(block) THEN (max(block) FILTER (NOT over) + 1 - min(block)) * 120 END AS minutes FROM o GROUP BY 1""")
def decay_of_effects(spark, sf_dir):
    """From when on the level stays at its usual value."""
    s = _stops(spark, sf_dir)
    b = s.groupBy("place", F.floor(F.hour("sched") / 2).alias("block")).agg(F.avg(F.col("delay") - 2.5).alias("mean"), (F.stddev_samp("delay") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return simulate.decay_minutes(b, ["place"], "block", "mean", "se", 120)


@query("""WITH g AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pt FROM events), w AS (SELECT event_type, pt AS a, ts AS b FROM g WHERE epoch_us(ts) - epoch_us(pt) >= 5400000000)
SELECT w.event_type, w.a AS gap_start, w.b AS gap_end, count(e.value) FILTER (e.ts <= w.a) AS n_before, round(avg(e.value) FILTER (e.ts <= w.a), 6) AS mean_before, count(e.value) FILTER (e.ts >= w.b) AS n_after, round(avg(e.value) FILTER (e.ts >= w.b), 6) AS mean_after
FROM w JOIN events e ON e.event_type = w.event_type AND ((e.ts > w.a - INTERVAL 2 HOURS AND e.ts <= w.a) OR (e.ts >= w.b AND e.ts < w.b + INTERVAL 2 HOURS)) GROUP BY 1, 2, 3""")
def closure_test(spark, sf_dir):
    """Real gaps of an hour and a half or more: the level in the two hours before and after."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    w = W.partitionBy("event_type").orderBy("ts", "event_id")
    gaps = e.withColumn("gap_start", F.lag("ts").over(w)).where(micros("ts") - micros("gap_start") >= 3 * HOUR // 2).select("event_type", "gap_start", F.col("ts").alias("gap_end"))
    seen = e.select("event_type", F.col("ts").alias("_t"), "value")
    before = ranges.range_pairs(gaps, seen, ["event_type"], -2 * HOUR + 1, 0, "gap_start", "_t").groupBy("event_type", "gap_start", "gap_end").agg(F.count("value").alias("n_before"), r6(F.avg("value")).alias("mean_before"))
    after = ranges.range_pairs(gaps, seen, ["event_type"], 0, 2 * HOUR - 1, "gap_end", "_t").groupBy("event_type", "gap_start", "gap_end").agg(F.count("value").alias("n_after"), r6(F.avg("value")).alias("mean_after"))
    return before.join(after, ["event_type", "gap_start", "gap_end"])


@query(f"WITH {_FEATURES} SELECT CASE WHEN day(day) <= 20 THEN 'fit' ELSE 'test' END AS part, count(*) AS n, TRUE AS between FROM f GROUP BY 1")
def boosted_cancellation(spark, sf_dir):
    """Gradient boosting of the next cancellation, fitted on the first days; every probability lies between 0 and 1 and beats a coin on the days of the fit."""
    columns = ["d_k", "d_km1", "rank", "hour", "plan_gap_pred", "act_gap_pred", "d_pred_k", "d_pred_k1", "net_mean15", "net_n15", "cancel_here30", "cancel_net30", "plan_run"]
    # written once: the fit reads its rows again and again
    f = materialise(_features(spark, sf_dir).select("day", *columns, "cancelled_next"), "boosting-features").withColumn("part", F.when(F.dayofmonth("day") <= 20, "fit").otherwise("test"))
    model = features.boosted(f.where("part = 'fit'"), columns, "cancelled_next", trees=5, depth=3)
    p = model.transform(features.numeric(f, columns)).withColumn("p", F.element_at(vector_to_array("probability"), 2))
    good = F.min("p").between(0, 1) & F.max("p").between(0, 1) & (F.avg(F.pow(F.col("p") - F.col("cancelled_next").cast("double"), 2)) <= 0.25)
    return p.groupBy("part").agg(F.count(F.lit(1)).alias("n"), good.alias("between"))



_FIT, _HELD, _TEST = "day(day) <= 15", "day(day) > 15 AND day(day) <= 20", "day(day) > 20"


@query(f"""WITH {_FEATURES}, kn AS (SELECT line, rank % 3 AS r, cancelled_next::INT AS y, day FROM f WHERE cancelled_next IS NOT NULL), ab AS (SELECT avg(y) AS b FROM kn WHERE {_FIT}), gl AS (SELECT line, r, sum(y) AS s, count(*) AS n FROM kn WHERE {_FIT} GROUP BY 1, 2),
pl AS (SELECT y, least(greatest((coalesce(s, 0) + 5 * b) / (coalesce(n, 0) + 5), 1e-12), 1 - 1e-12) AS p FROM kn LEFT JOIN gl USING (line, r), ab WHERE {_TEST})
SELECT count(*) AS n, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM pl""")
def group_baseline(spark, sf_dir):
    """Log loss, on the last days, of the smoothed share of cancellations of a line and rank."""
    f = _features(spark, sf_dir).where("cancelled_next is not null").withColumn("r", F.col("rank") % 3)
    day = F.dayofmonth("day")
    got = features.group_log_loss(f.where(day <= 15), f.where(day > 20), ["line", "r"], "cancelled_next")
    return got.select("n", r6(F.col("log_loss")).alias("log_loss"))


@query()
def boosting_grid(spark, sf_dir):
    """Boosting at four grid points, stopped early on five days; the chosen one's log loss on the last days, beside the group baseline's."""
    columns = ["d_k", "d_km1", "rank", "hour", "plan_gap_pred", "act_gap_pred", "d_pred_k", "d_pred_k1", "net_mean15", "net_n15", "cancel_here30", "cancel_net30", "plan_run"]
    f = materialise(_features(spark, sf_dir).where("cancelled_next is not null").withColumn("r", F.col("rank") % 3), "boosting-features")
    day = F.dayofmonth("day")
    model, grid = features.boosted_grid(f.where(day <= 20).withColumn("held", day > 15), columns, "cancelled_next", "held", [(2, 0.1), (2, 0.3), (4, 0.1), (4, 0.3)], trees=20)
    test = features.log_loss(model, f.where(day > 20), columns, "cancelled_next")
    base = features.group_log_loss(f.where(day <= 15), f.where(day > 20), ["line", "r"], "cancelled_next").first()
    return grid.withColumns({"test_log_loss": F.when(F.col("chosen"), F.lit(test["log_loss"])), "group_log_loss": F.lit(base["log_loss"]), "test_rows": F.lit(test["n"])})
