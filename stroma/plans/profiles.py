"""Checks of ranks and repeats, inventories, isolation and profiles of codes on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, micros
from stroma.functions.names import logit, resolve_aliases, tempered, with_separators
from stroma.functions.numbers import r6
from stroma.operators import cooccurrence as co
from stroma.operators import ordered, ranges, var
from stroma.plans.base import query, table
from stroma.sources.files import choose_source, register

HOUR = 3600 * MICROS
MINUTE = 60 * MICROS


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem")
def full_row_dedup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_marked, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN bool_or(o_orderstatus = 'F' AND r = 1) END AS marked_is_last FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) GROUP BY 1""")
def marked_not_last(spark, sf_dir):
    """Customers whose latest order isn't one of those marked final."""
    return ordered.marked_not_last(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "F")


@query("""SELECT l_orderkey, l_linenumber, l_linenumber_prev, round(l_quantity - l_quantity_prev, 6) AS change FROM (SELECT *, lag(l_linenumber) OVER w AS l_linenumber_prev, lag(l_quantity) OVER w AS l_quantity_prev
FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) WHERE l_linenumber = l_linenumber_prev + 1""")
def consecutive_pairs(spark, sf_dir):
    """Lines with the line before them, only where no number is missing between."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <> 3").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    p = ordered.consecutive_pairs(li, ["l_orderkey"], "l_linenumber", ["l_quantity"])
    return p.select("l_orderkey", "l_linenumber", "l_linenumber_prev", r6(F.col("l_quantity") - F.col("l_quantity_prev")).alias("change"))


@query("""SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS n, round(avg((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6), 6) AS mean_seconds FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id < b.user_id AND b.ts BETWEEN a.ts - INTERVAL 60 SECONDS AND a.ts + INTERVAL 60 SECONDS GROUP BY 1, 2""")
def aligned_pairs(spark, sf_dir):
    """Pairs of users whose events of one type lie within a minute of each other."""
    p = ranges.close_pairs(_events(spark, sf_dir), "event_type", "user_id", "ts", MINUTE)
    return p.select(F.col("a").alias("user_a"), F.col("b").alias("user_b"), "n", r6(F.col("mean")).alias("mean_seconds"))


_CODE = "(json_extract(props, '$.k')::BIGINT)"


@query(f"""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS "window", count(*) AS n, count(*) FILTER ({_CODE} >= 50) AS coded, min(floor(value / 100)) AS lo, max(floor(value / 100)) AS hi FROM events GROUP BY 1, 2),
net AS (SELECT "window", sum(n) AS all_n, sum(coded) AS all_coded FROM h GROUP BY 1)
SELECT event_type, "window", n, CASE WHEN all_coded = 0 AND all_n >= 4 THEN 'D' WHEN n >= 2 AND lo = hi AND lo <> 0 THEN 'E' END AS kind FROM h JOIN net USING ("window")""")
def silent_or_constant(spark, sf_dir):
    """Hours without any code in the whole network, and hours of one type whose level never changes and isn't zero."""
    level = F.floor(F.col("value") / 100)
    coded = F.get_json_object("props", "$.k").cast("long") >= 50
    h = _events(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window")).agg(F.count(F.lit(1)).alias("n"), F.count_if(coded).alias("_c"), F.min(level).alias("_lo"), F.max(level).alias("_hi"))
    net = h.groupBy("window").agg(F.sum("n").alias("_all"), F.sum("_c").alias("_coded"))
    kind = F.when((F.col("_coded") == 0) & (F.col("_all") >= 4), "D").when((F.col("n") >= 2) & (F.col("_lo") == F.col("_hi")) & (F.col("_lo") != 0), "E")
    return h.join(net, "window").select("event_type", "window", "n", kind.alias("kind"))


@query(f"SELECT event_id, user_id, ts, {_CODE} AS code FROM events WHERE event_type = 'error' AND {_CODE} IN (34, 57, 80)")
def code_hits(spark, sf_dir):
    """Rows of one kind that report one of several codes."""
    code = F.get_json_object("props", "$.k").cast("long")
    return _events(spark, sf_dir).where((F.col("event_type") == "error") & code.isin(34, 57, 80)).select("event_id", "user_id", "ts", code.alias("code"))


_MEANINGS = [("error", "something failed"), ("purchase", "something was bought"), ("signup", "someone came")]


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS places, count(DISTINCT ts::DATE) AS days, min(ts) AS first_ts, max(ts) AS last_ts,
CASE event_type WHEN 'error' THEN 'something failed' WHEN 'purchase' THEN 'something was bought' WHEN 'signup' THEN 'someone came' ELSE 'unknown' END AS meaning, event_type IN ('error', 'purchase', 'signup') AS meaning_known, event_type = 'error' AS is_flagged FROM events GROUP BY 1""")
def inventory_meanings(spark, sf_dir):
    meanings = spark.createDataFrame(_MEANINGS, "event_type string, meaning string")
    return co.with_meanings(co.inventory(_events(spark, sf_dir), "event_type", "user_id", "ts"), "event_type", meanings, ["error"])


_EPISODES = """numbered AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS ep FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) > 900000000)::INT AS b FROM events)),
ep AS (SELECT event_type, ep, min(ts) AS t0, max(ts) AS t1, count(DISTINCT user_id) AS breadth, count(*) AS size, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 AS minutes FROM numbered GROUP BY 1, 2)"""


def _numbered(spark, sf_dir) -> DataFrame:
    """Events with the number of their episode: over all places of a type, a gap of more than 15 minutes ends one."""
    return ordered.sessionize_by_days(_events(spark, sf_dir), ["event_type"], "ts", "event_id", 15, "ep")


def _episodes(spark, sf_dir) -> DataFrame:
    # places are counted, never listed: an episode may have any number
    s = _numbered(spark, sf_dir).groupBy("event_type", "ep", "user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("size"))
    g = s.groupBy("event_type", "ep").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("user_id").alias("breadth"), F.sum("size").alias("size"))
    return g.withColumn("minutes", (micros("t1") - micros("t0")) / (60.0 * MICROS))


@query(f"""WITH {_EPISODES} SELECT event_type, count(*) AS episodes, round(median(minutes), 6) AS minutes_median, round(quantile_cont(minutes, 0.25), 6) AS minutes_q25, round(quantile_cont(minutes, 0.75), 6) AS minutes_q75, round(max(minutes), 6) AS minutes_max,
median(breadth) AS breadth_median, max(breadth) AS breadth_max, median(size) AS size_median, sum(size)::BIGINT AS size_sum FROM ep GROUP BY 1""")
def episode_summary(spark, sf_dir):
    s = co.episode_summary(_episodes(spark, sf_dir), "event_type", "minutes", "breadth", "size")
    return s.withColumns({c: r6(F.col(c)) for c in ("minutes_median", "minutes_q25", "minutes_q75", "minutes_max")})


@query(f"""WITH {_EPISODES} SELECT e.event_type, count(*) AS episodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM numbered p JOIN events o ON o.user_id = p.user_id WHERE p.event_type = e.event_type AND p.ep = e.ep AND o.event_type <> e.event_type
 AND o.ts BETWEEN e.t0 - INTERVAL 60 MINUTES AND e.t1 + INTERVAL 60 MINUTES)) AS isolated FROM ep e GROUP BY 1""")
def isolated_episodes(spark, sf_dir):
    """Episodes that no other type was near to, at any of their places."""
    ident = F.concat_ws("|", "event_type", "ep").alias("id")
    e = _episodes(spark, sf_dir).withColumn("id", ident)
    members = _numbered(spark, sf_dir).select(ident, "user_id").distinct()
    near = co.not_alone(e, members, "id", "event_type", "t0", "t1", _events(spark, sf_dir), "user_id", "ts", 60)
    alone = e.join(near, "id", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("isolated"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("episodes")).join(alone, "event_type", "left").select("event_type", "episodes", F.coalesce("isolated", F.lit(0)).cast("long").alias("isolated"))


@query("""WITH t AS (SELECT event_type AS code_a, count(DISTINCT (user_id, ts)) AS n_a FROM events GROUP BY 1), c AS (SELECT DISTINCT event_type AS code_b FROM events),
f AS (SELECT a.event_type AS code_a, b.event_type AS code_b, count(DISTINCT (a.user_id, a.ts)) AS n_followed FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 MINUTE GROUP BY 1, 2)
SELECT code_a, code_b, n_a, coalesce(n_followed, 0) AS n_followed, round(coalesce(n_followed, 0) / n_a, 6) AS rate FROM t JOIN c ON code_a <> code_b LEFT JOIN f USING (code_a, code_b) WHERE n_a >= 20""")
def follow_table(spark, sf_dir):
    """Follow rates of all ordered pairs, those that never follow included."""
    return co.follow_table(_events(spark, sf_dir), "event_type", "user_id", "ts", 1, 20).withColumn("rate", r6(F.col("rate")))


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), near AS (SELECT o.event_id, max(1) AS near FROM events o JOIN e ON e.user_id = o.user_id AND o.event_type <> 'error' AND o.ts BETWEEN e.ts - INTERVAL 6 HOURS AND e.ts + INTERVAL 6 HOURS GROUP BY 1)
SELECT 'hour' AS measure, hour(ts)::VARCHAR AS of, count(*)::DOUBLE AS value FROM e GROUP BY 2 UNION ALL SELECT 'weekday', (isodow(ts) - 1)::VARCHAR, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'mean value', CASE WHEN near = 1 THEN 'near' ELSE 'far' END, round(avg(value), 6) FROM events LEFT JOIN near USING (event_id) WHERE event_type <> 'error' GROUP BY 2
UNION ALL SELECT 'follows', a.event_type, count(DISTINCT (a.user_id, a.ts)) FROM events a JOIN e ON e.user_id = a.user_id AND a.event_type <> 'error' AND e.ts > a.ts AND e.ts <= a.ts + INTERVAL 6 HOURS GROUP BY 2
UNION ALL SELECT 'followed by', b.event_type, count(DISTINCT (e.user_id, e.ts)) FROM e JOIN events b ON e.user_id = b.user_id AND b.event_type <> 'error' AND b.ts > e.ts AND b.ts <= e.ts + INTERVAL 6 HOURS GROUP BY 2""")
def code_profile(spark, sf_dir):
    """One code's hours and weekdays, what follows it and what it follows, and others' mean value near it and far from it."""
    e = _events(spark, sf_dir)
    mine = e.where("event_type = 'error'")
    row = lambda df, measure, of, value: df.select(F.lit(measure).alias("measure"), F.col(of).cast("string").alias("of"), F.col(value).cast("double").alias("value"))
    count = F.count(F.lit(1)).alias("v")
    a, b = mine.select("user_id", F.col("ts").alias("_ta")), e.where("event_type <> 'error'").select("user_id", F.col("ts").alias("_tb"), "event_id", F.col("event_type").alias("other"))
    near = ranges.range_pairs(a, b, ["user_id"], -6 * HOUR, 6 * HOUR, "_ta", "_tb")
    beside = near.select("event_id").distinct().withColumn("_near", F.lit("near"))
    means = e.where("event_type <> 'error'").join(beside, "event_id", "left").groupBy(F.coalesce("_near", F.lit("far")).alias("of")).agg(r6(F.avg("value")).alias("v"))
    after, before = near.where("_tb > _ta"), near.where("_tb < _ta")
    return (
        row(mine.groupBy(F.hour("ts").alias("of")).agg(count), "hour", "of", "v")
        .unionByName(row(mine.groupBy(F.weekday("ts").alias("of")).agg(count), "weekday", "of", "v"))
        .unionByName(row(means, "mean value", "of", "v"))
        .unionByName(row(before.groupBy("other").agg(F.count_distinct(F.struct("user_id", "_tb")).alias("v")), "follows", "other", "v"))
        .unionByName(row(after.groupBy("other").agg(F.count_distinct(F.struct("user_id", "_ta")).alias("v")), "followed by", "other", "v"))
    )


@query("SELECT event_type, count(*) AS n FROM events WHERE value >= 100 GROUP BY 1")
def registered_relation(spark, sf_dir):
    """A relation registered from a frame and read by SQL."""
    register(_events(spark, sf_dir), "stroma_registered_events")
    return spark.sql("SELECT event_type, count(*) AS n FROM stroma_registered_events WHERE value >= 100 GROUP BY event_type")


@query("""SELECT 'raw' AS source, count(*) AS n FROM events WHERE ts::DATE <> DATE '2024-01-05' UNION ALL SELECT 'cleaned', count(*) FROM events WHERE value >= 2 AND ts::DATE NOT IN (DATE '2024-01-05', DATE '2024-01-06')""")
def source_switch(spark, sf_dir):
    """Counts of both sources with their own excluded days."""
    e = _events(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))
    raw = choose_source(e, "day", ["2024-01-05"])
    cleaned = choose_source(e, "day", ["2024-01-05"], e.where("value >= 2"), ["2024-01-06"])
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")
    return one(raw, "raw").unionByName(one(cleaned, "cleaned"))


@query("""SELECT canonical, n_name FROM (VALUES ('germany', 'DE'), ('france', 'FR')) a(alias, canonical) JOIN nation ON lower(trim(n_name)) = alias UNION ALL SELECT 'first', n_name FROM nation WHERE n_nationkey = 0""")
def alias_lookup(spark, sf_dir):
    """Entries by their aliases, each of which must fit exactly one."""
    n = table(spark, sf_dir, "nation")
    first = n.where("n_nationkey = 0").first()["n_name"]
    known = {r["n_name"].strip().lower() for r in n.select("n_name").collect()}  # the aliases asked for are those the table has
    wanted = {c: [a] for a, c in (("germany", "DE"), ("france", "FR")) if a in known}
    return resolve_aliases(n, "n_name", wanted | {"first": [f" {first.upper()} ", "nobody"]})


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price FROM orders")
def formatted_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", with_separators(F.round("o_totalprice", 2), 2).alias("price"))


@query("""WITH c AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT event_type, hour, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
SELECT event_type, hour, round(p, 6) AS p, round(ln(p / (1 - p)), 6) AS logit, round(pow(p, 0.5) / sum(pow(p, 0.5)) OVER (PARTITION BY event_type), 6) AS tempered FROM p""")
def tempered_shares(spark, sf_dir):
    """Shares of the hours of each type, their log odds, and the shares at temperature 2."""
    c = _events(spark, sf_dir).groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("event_type")))
    return p.select("event_type", "hour", r6(F.col("p")).alias("p"), r6(logit(F.col("p"))).alias("logit"), r6(tempered(F.col("p"), ["event_type"], 2.0)).alias("tempered"))


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS w, avg(value) AS mean FROM events GROUP BY 1, 2), c AS (SELECT event_type, w, mean - avg(mean) OVER (PARTITION BY event_type) AS c, var_pop(mean) OVER (PARTITION BY event_type) AS v FROM h),
l AS (SELECT event_type, v, k.lag, c * CASE k.lag """ + " ".join(f"WHEN {k} THEN lag(c, {k}) OVER q" for k in range(1, 5)) + """ ELSE c END AS p FROM c CROSS JOIN (SELECT unnest(range(5)) AS lag) k WINDOW q AS (PARTITION BY event_type, k.lag ORDER BY w))
SELECT event_type, lag::INT AS lag, count(p) AS n, round(avg(p) / any_value(v), 6) AS acf FROM l WHERE p IS NOT NULL GROUP BY 1, 2""")
def curve_acf(spark, sf_dir):
    """Unbiased autocorrelation of each type's hourly curve, all types and lags in one pass."""
    h = _events(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", "ts").alias("w")).agg(F.avg("value").alias("mean"))
    return var.curve_acf(h, ["event_type"], "w", "mean", 4).withColumn("acf", r6(F.col("acf")))
