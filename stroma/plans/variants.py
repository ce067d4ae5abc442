"""Variants of the event study: all controls, local clocks, episodes over all places, durations, several codes at once, tests for artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, micros, to_local
from stroma.functions.numbers import r6
from stroma.operators import eventstudy as es
from stroma.operators import ranges, routes
from stroma.plans.base import query, table
from stroma.plans.study import _CONTROLS

HOUR = 3600 * MICROS


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query(f"WITH {_CONTROLS} SELECT event_id, control FROM k WHERE r <= 30")
def controls_at_most(spark, sf_dir):
    """Up to 30 controls of every event that has any."""
    p = _events(spark, sf_dir).where("event_type = 'purchase'")
    events = p.select("event_id", "user_id", F.col("ts").alias("t0"))
    return es.matched_controls(events, p.select("user_id", "ts"), ["user_id"], 14, 60, 240, 30, 11, at_most=True).select("event_id", "control")


# the events moved to a spring in which clocks change on 31 March
_LOCAL = """p AS (SELECT event_id, user_id, ts + INTERVAL 75 DAYS AS t0, timezone('Europe/Berlin', timezone('UTC', ts + INTERVAL 75 DAYS)) AS l0 FROM events WHERE event_type = 'purchase'),
c AS (SELECT event_id, user_id, t0, l0, d, date_trunc('minute', l0) + to_days(d::INT) AS lc FROM p, (SELECT unnest(range(-14, 15)) AS d) WHERE d <> 0
 AND CASE isodow(l0) WHEN 7 THEN 3 WHEN 6 THEN 2 WHEN 5 THEN 1 ELSE 0 END = CASE isodow(l0 + to_days(d::INT)) WHEN 7 THEN 3 WHEN 6 THEN 2 WHEN 5 THEN 1 ELSE 0 END),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND p.l0 BETWEEN c.lc - INTERVAL 1 HOUR AND c.lc + INTERVAL 4 HOURS)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY md5('11:' || event_id::VARCHAR || ':' || d::VARCHAR)) AS r, count(*) OVER (PARTITION BY event_id) AS n FROM f),
local_controls AS (SELECT event_id, t0, timezone('UTC', timezone('Europe/Berlin', lc)) AS control FROM k WHERE n >= 5 AND r <= 5)"""


def _local_controls(spark, sf_dir) -> DataFrame:
    p = _events(spark, sf_dir).where("event_type = 'purchase'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 75 DAYS"))
    return es.matched_controls(p.select("event_id", "user_id", F.col("ts").alias("t0")), p.select("user_id", "ts"), ["user_id"], 14, 60, 240, 5, 11, zone="Europe/Berlin")


@query(f"WITH {_LOCAL} SELECT event_id, control::TIMESTAMP AS control FROM local_controls")
def local_time_controls(spark, sf_dir):
    """Controls at the same local minute, also across a change of clocks."""
    return _local_controls(spark, sf_dir).select("event_id", "control")


@query(f"""WITH {_LOCAL}, o AS (SELECT (epoch_us(timezone('Europe/Berlin', timezone('UTC', control))) - epoch_us(control) - epoch_us(timezone('Europe/Berlin', timezone('UTC', t0))) + epoch_us(t0)) // 60000000 AS moved,
 (epoch_us(control) - epoch_us(date_trunc('minute', t0))) % 86400000000 <> 0 AS other_utc_minute FROM local_controls)
SELECT moved::BIGINT AS moved_minutes, other_utc_minute, count(*) AS pairs FROM o GROUP BY 1, 2""")
def straddling_pairs(spark, sf_dir):
    """Pairs of events and controls by how far the clocks moved between them."""
    c = _local_controls(spark, sf_dir)
    shift = lambda x: micros(to_local(F.col(x), "Europe/Berlin")) - micros(x)
    minute = 60 * MICROS
    return c.groupBy(((shift("control") - shift("t0")) / minute).cast("long").alias("moved_minutes"), (F.pmod(micros("control") - (micros("t0") - F.pmod(micros("t0"), F.lit(minute))), F.lit(24 * HOUR)) != 0).alias("other_utc_minute")).agg(F.count(F.lit(1)).alias("pairs"))


@query("""WITH p AS (SELECT event_id, ts FROM events WHERE event_type = 'error' AND value > 100), b AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 900000000, TRUE) AS b FROM p WINDOW w AS (ORDER BY ts, event_id)),
n AS (SELECT *, sum(b::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM b)
SELECT event_id, first_value(ts) OVER w AS episode_t0, first_value(event_id) OVER w AS representative FROM n WINDOW w AS (PARTITION BY ep ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def episodes_across_places(spark, sf_dir):
    """Events of all places in episodes by gaps of 15 minutes; the first event stands for its episode."""
    e = _events(spark, sf_dir).where("event_type = 'error' and value > 100").select("event_id", F.col("ts").alias("t0"))
    return es.across_places(e, 15, "event_id").select("event_id", "episode_t0", "representative")


@query("""WITH p AS (SELECT event_id, user_id % 6 AS place, ts AS t0 FROM events WHERE event_type = 'error'), h AS (SELECT user_id % 6 AS place, ts FROM events),
n AS (SELECT p.event_id, p.t0, h.ts, epoch_us(h.ts) - coalesce(lag(epoch_us(h.ts)) OVER (PARTITION BY p.event_id ORDER BY h.ts), epoch_us(p.t0)) AS gap FROM p JOIN h ON h.place = p.place AND h.ts BETWEEN p.t0 AND p.t0 + INTERVAL 6 HOURS),
k AS (SELECT *, max((gap > 2700000000)::INT) OVER (PARTITION BY event_id ORDER BY ts) AS broken FROM n)
SELECT event_id, round((epoch_us(max(ts) FILTER (broken = 0)) - epoch_us(any_value(t0))) / 60000000.0, 6) AS minutes FROM k GROUP BY 1""")
def event_durations(spark, sf_dir):
    """Minutes from an event until its place's first gap of more than 45 minutes, within six hours."""
    e = _events(spark, sf_dir).withColumn("place", F.col("user_id") % 6)
    p = e.where("event_type = 'error'").select("event_id", "place", F.col("ts").alias("t0"))
    return es.event_duration(p, e.select("place", "ts"), "place", "ts", 45, 6).select("event_id", r6(F.col("minutes")).alias("minutes"))


_CODES = """t AS (SELECT event_id, event_type AS code, user_id % 5 AS place, ts AS t0 FROM events WHERE event_type IN ('error', 'signup', 'purchase')), c AS (SELECT user_id % 5 AS place, date_trunc('hour', ts) AS w, avg(value) AS mean FROM events GROUP BY 1, 2),
a AS (SELECT t.event_id, t.code, m.rel AS rel_min, c.mean AS v FROM t CROSS JOIN (SELECT unnest(range(-120, 241, 60)) AS rel) m LEFT JOIN c ON c.place = t.place AND c.w = date_trunc('hour', t.t0) + to_minutes(m.rel::INT))"""


def _code_curves(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("place", F.col("user_id") % 5)
    times = e.where(F.col("event_type").isin("error", "signup", "purchase")).select("event_id", F.col("event_type").alias("code"), "place", F.col("ts").alias("t0"))
    cells = e.groupBy("place", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window")).agg(F.avg("value").alias("mean"))
    return es.aligned_curves(times, cells, ["event_id", "code"], ["place"], "t0", 60, range(-120, 241, 60), "mean")


@query(f"WITH {_CODES} SELECT code, rel_min::INT AS rel_min, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM a GROUP BY 1, 2")
def curves_by_code(spark, sf_dir):
    """Raw curves of several codes in one pass: how many, mean and spread at each minute."""
    return _code_curves(spark, sf_dir).groupBy("code", "rel_min").agg(F.count("mean").alias("n"), r6(F.avg("mean")).alias("mean"), r6(F.stddev_samp("mean")).alias("sd"))


@query(f"""WITH {_CODES}, b AS (SELECT event_id, code, v AS base FROM a WHERE rel_min = -60 AND v IS NOT NULL), q AS (SELECT code, quantile_cont(base, 1 / 3) AS q1, quantile_cont(base, 2 / 3) AS q2 FROM b GROUP BY 1),
g AS (SELECT event_id, 1 + (base > q1)::INT + (base > q2)::INT AS tercile, ('0x' || substr(md5('7:' || event_id::VARCHAR), 1, 8))::UBIGINT % 3 AS third FROM b JOIN q USING (code))
SELECT code, 'tercile ' || tercile AS part, rel_min::INT AS rel_min, count(v) AS n, round(avg(v), 6) AS mean FROM a JOIN g USING (event_id) GROUP BY 1, 2, 3 UNION ALL SELECT code, 'third ' || third, rel_min::INT, count(v), round(avg(v), 6) FROM a JOIN g USING (event_id) GROUP BY 1, 2, 3""")
def artefact_splits(spark, sf_dir):
    """Curves by terciles of the level an hour before, and by a random split into thirds that should show nothing."""
    a = _code_curves(spark, sf_dir)
    base = a.where("rel_min = -60 and mean is not null").select("event_id", "code", F.col("mean").alias("base"))
    edges = base.groupBy("code").agg(F.percentile("base", [1 / 3, 2 / 3]).alias("q"))
    third = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 3
    tercile = 1 + (F.col("base") > F.col("q")[0]).cast("int") + (F.col("base") > F.col("q")[1]).cast("int")
    parts = base.join(edges, "code").select("event_id", F.explode(F.array(F.concat(F.lit("tercile "), tercile.cast("string")), F.concat(F.lit("third "), third.cast("string")))).alias("part"))
    return a.join(parts, "event_id").groupBy("code", "part", "rel_min").agg(F.count("mean").alias("n"), r6(F.avg("mean")).alias("mean"))


@query("""WITH t AS (SELECT event_id, event_type AS code, user_id, ts FROM events), o AS (SELECT t.event_id, count(x.event_id) AS others FROM t LEFT JOIN events x ON x.user_id = t.user_id AND x.event_type <> t.code AND x.ts BETWEEN t.ts - INTERVAL 60 MINUTES AND t.ts + INTERVAL 240 MINUTES GROUP BY 1)
SELECT code, count(*) AS n, count(*) FILTER (others > 0) AS contaminated, count(*) FILTER (others > 0 AND isodow(ts) >= 6) AS on_weekends, round(avg(others), 6) AS mean_others FROM t JOIN o USING (event_id) GROUP BY 1""")
def contamination_by_code(spark, sf_dir):
    """How many events of each code have others in their window."""
    t = _events(spark, sf_dir)
    o = t.select("user_id", F.col("ts").alias("ts2"), F.col("event_type").alias("type2"))
    n = ranges.range_pairs(t, o, ["user_id"], -HOUR, 4 * HOUR, "ts", "ts2").where("type2 <> event_type").groupBy("event_id").agg(F.count(F.lit(1)).alias("others"))
    j = t.join(n, "event_id", "left").withColumn("others", F.coalesce("others", F.lit(0)))
    return j.groupBy(F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("others") > 0).alias("contaminated"), F.count_if((F.col("others") > 0) & (F.weekday("ts") >= 5)).alias("on_weekends"), r6(F.avg("others")).alias("mean_others"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, event_type, ts, row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts, event_id) AS r FROM events), f AS (SELECT user_id, day, event_type, ts FROM d WHERE r = 1), n AS (SELECT user_id, day, count(*) AS stops FROM f GROUP BY 1, 2),
best AS (SELECT user_id, day FROM n ORDER BY stops DESC, user_id, day LIMIT 1), r AS (SELECT row_number() OVER (ORDER BY f.ts, event_type) AS rank, event_type FROM f JOIN best USING (user_id, day)),
p AS (SELECT a.event_type AS a, b.event_type AS b, median((epoch_us(y.ts) - epoch_us(x.ts)) / 60000000.0) AS minutes, count(*) AS n, avg((y.ts > x.ts)::INT) AS forward FROM r a JOIN r b ON b.rank = a.rank + 1 JOIN f x ON x.event_type = a.event_type JOIN f y ON y.event_type = b.event_type AND y.user_id = x.user_id AND y.day = x.day GROUP BY 1, 2)
SELECT r.rank::BIGINT AS rank, r.event_type, p.b AS next_type, n AS trips, round(minutes, 6) AS median_minutes, CASE WHEN forward >= 0.6 THEN 'sure' WHEN forward >= 0.45 THEN 'likely' WHEN forward IS NOT NULL THEN 'doubtful' END AS confidence FROM r LEFT JOIN p ON p.a = r.event_type""")
def route_confidence(spark, sf_dir):
    """The order of the trip with the most stops, and how well all trips bear out each step of it."""
    e = _events(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))
    f = e.groupBy("user_id", "day", "event_type").agg(F.min(F.struct("ts", "event_id"))["ts"].alias("ts"))
    best = f.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("stops")).orderBy(F.desc("stops"), "user_id", "day").limit(1).select("user_id", "day")
    along = W.orderBy("ts", "event_type")  # one trip's stops
    r = f.join(F.broadcast(best), ["user_id", "day"]).select(F.row_number().over(along).cast("long").alias("rank"), "event_type", F.lead("event_type").over(along).alias("next_type"))
    steps = r.where("next_type is not null").select(F.col("event_type").alias("a"), F.col("next_type").alias("b"))
    x, y = f.select("user_id", "day", F.col("event_type").alias("a"), F.col("ts").alias("_x")), f.select("user_id", "day", F.col("event_type").alias("b"), F.col("ts").alias("_y"))
    p = x.join(F.broadcast(steps), "a").join(y, ["user_id", "day", "b"]).groupBy("a").agg(F.count(F.lit(1)).alias("trips"), F.median((micros("_y") - micros("_x")) / (60.0 * MICROS)).alias("_m"), F.avg((F.col("_y") > F.col("_x")).cast("int")).alias("_f"))
    level = F.when(F.col("_f") >= 0.6, "sure").when(F.col("_f") >= 0.45, "likely").when(F.col("_f").isNotNull(), "doubtful")
    return r.join(p, F.col("event_type") == F.col("a"), "left").select("rank", "event_type", "next_type", "trips", r6(F.col("_m")).alias("median_minutes"), level.alias("confidence"))


def _picks(steps: int) -> str:
    """Of the places left, one after the other: the one that the fewest precede, then that precedes most, then by the anchor and by name."""
    left, out = "w", []
    for k in range(1, steps + 1):
        out.append(
            f"pick{k} AS (SELECT l.p, {k} AS position FROM {left} l LEFT JOIN anchor USING (p) ORDER BY (SELECT count(*) FROM pairs JOIN {left} q ON q.p = pairs.b WHERE pairs.a = l.p AND m > n), "
            f"(SELECT count(*) FROM pairs JOIN {left} q ON q.p = pairs.b WHERE pairs.a = l.p AND n > m) DESC, r NULLS LAST, l.p LIMIT 1), left{k} AS (SELECT * FROM {left} WHERE p NOT IN (SELECT p FROM pick{k}))"
        )
        left = f"left{k}"
    return ", ".join(out) + ", placed AS (" + " UNION ALL ".join(f"SELECT * FROM pick{k}" for k in range(1, steps + 1)) + ")"


@query("""WITH f AS (SELECT user_id, ts::DATE AS day, event_type AS p, min((ts, event_id)) AS k FROM events GROUP BY 1, 2, 3), v AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY k) AS i, count(*) OVER (PARTITION BY user_id, day) AS n FROM f),
anchor AS (SELECT p, i AS r FROM v WHERE (user_id, day) = (SELECT (user_id, day) FROM v ORDER BY n DESC, user_id, day LIMIT 1)), x AS (SELECT user_id, day, i, r FROM v JOIN anchor USING (p)),
m AS (SELECT unnest(range(1, 32)) AS mask), s AS (SELECT user_id, day, mask, count(*) AS k, list(i ORDER BY r) AS seq FROM x, m WHERE (mask >> (r - 1)) & 1 = 1 GROUP BY 1, 2, 3), l AS (SELECT user_id, day, max(k) FILTER (seq = list_sort(seq)) AS forward, max(k) FILTER (seq = list_reverse_sort(seq)) AS backward FROM s GROUP BY 1, 2),
o AS (SELECT v.user_id, v.day, p, CASE WHEN backward > forward THEN -i ELSE i END AS i FROM v LEFT JOIN l USING (user_id, day)), pairs AS (SELECT a.p AS a, b.p AS b, count(*) FILTER (a.i < b.i) AS n, count(*) FILTER (a.i > b.i) AS m FROM o a JOIN o b ON a.user_id = b.user_id AND a.day = b.day AND a.p <> b.p GROUP BY 1, 2),
w AS (SELECT o.p, count(*) AS trips, coalesce(any_value(before), 0) AS before FROM o LEFT JOIN (SELECT a AS p, count_if(n > m) AS before FROM pairs GROUP BY 1) USING (p) GROUP BY 1), """ + _picks(5) + """, z AS (SELECT w.*, r AS anchor_rank, position FROM w JOIN placed USING (p) LEFT JOIN anchor USING (p)),
g AS (SELECT a AS p, sum(CASE WHEN za.position < zb.position THEN n ELSE m END) / sum(n + m) AS agreed FROM pairs JOIN z za ON za.p = a JOIN z zb ON zb.p = b GROUP BY 1)
SELECT z.p AS event_type, position::INT AS position, anchor_rank::INT AS anchor_rank, trips, before::BIGINT AS before, round(agreed, 6) AS agreed FROM z LEFT JOIN g USING (p)""")
def route_from_trips(spark, sf_dir):
    """The order of the types along the days of the users, by votes of all days, those against the anchor turned round."""
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return routes.route_order(e, ["user_id", "day"], "event_type", ["ts", "event_id"]).withColumn("agreed", r6(F.col("agreed")))
