"""Scans, filters, joins, aggregates and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stroma.functions import calendar as cal
from stroma.functions.numbers import cut, haversine, r6, spline_basis
from stroma.operators import aggregates as agg
from stroma.operators.ordered import latest_per_key, quantile_bins
from stroma.plans.base import query, table

_PROFILED = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*)::BIGINT AS rows, (count(*) - count({c}))::BIGINT AS nulls, count(DISTINCT {c})::BIGINT AS distinct_values,
        {'NULL::VARCHAR' if c == 'o_totalprice' else f'min({c})::VARCHAR'} AS smallest, {'NULL::VARCHAR' if c == 'o_totalprice' else f'max({c})::VARCHAR'} AS largest,
        {'round(median(' + c + ')::DOUBLE, 6)' if c in ('o_orderkey', 'o_totalprice') else 'NULL::DOUBLE'} AS median FROM orders"""
        for c in _PROFILED
    )
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = agg.profile(table(spark, sf_dir, "orders").select(*_PROFILED))
    text = lambda c: F.when(F.col("column") != "o_totalprice", F.col(c)).alias(c)  # noqa: E731  doubles print differently
    return p.select("column", "rows", "nulls", "distinct_values", text("smallest"), text("largest"), r6(F.col("median")).alias("median"))


@query("""SELECT event_id, ts, user_id, event_type, round(value, 6) AS value FROM
(SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_record(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return latest_per_key(e, ["user_id", "event_type"], "ts", "event_id").withColumn("value", r6(F.col("value")))


@query("SELECT rows_per_key, count(*) AS keys FROM (SELECT l_orderkey, count(*) AS rows_per_key FROM lineitem GROUP BY l_orderkey) GROUP BY rows_per_key")
def dedup_message_distribution(spark, sf_dir):
    return agg.count_distribution(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderstatus <> 'O' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_orderpriority""")
def conjunction_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kept = o.where((F.col("o_orderstatus") != "O") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(list_filter(string_split(lower(text), ' '), lambda w: w IN ('the', 'der', 'la', 'los'))) AS word
FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the') OR list_contains(string_split(lower(text), ' '), 'la')) GROUP BY word""")
def array_contains_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    kept = d.where(F.array_contains("w", "the") | F.array_contains("w", "la"))
    words = kept.select("doc_id", F.explode(F.array_distinct(F.filter("w", lambda w: w.isin("the", "der", "la", "los")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))


@query("""SELECT o.o_orderkey, o.o_custkey, round(o.o_totalprice, 2) AS o_totalprice FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey IS NOT DISTINCT FROM o.o_custkey AND c.c_acctbal < 0)
AND NOT EXISTS (SELECT 1 FROM (SELECT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 4) b WHERE date_trunc('month', b.h) = date_trunc('month', o.o_orderdate + INTERVAL 24 YEARS))""")
def anti_clean(spark, sf_dir):
    """Two anti-joins: a null-safe key, and a truncated time against blocks found in another table."""
    o, c, e = (table(spark, sf_dir, t) for t in ("orders", "customer", "events"))
    overdrawn = c.where("c_acctbal < 0").select("c_custkey")
    blocks = e.where("event_type = 'error'").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    months = blocks.select(F.date_trunc("month", "h").alias("m")).distinct()
    left = o.join(overdrawn, o.o_custkey.eqNullSafe(overdrawn.c_custkey), "left_anti")
    left = left.join(months, F.date_trunc("month", F.col("o_orderdate") + F.expr("INTERVAL 24 YEARS")) == months.m, "left_anti")
    return left.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""SELECT n.n_name, count(*) AS customers, count(DISTINCT o.o_orderkey) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey
WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY n.n_name""")
def lookup_and_semi_join(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    named = c.join(urgent, "c_custkey", "left_semi").join(n, c.c_nationkey == n.n_nationkey)
    return named.join(o, named.c_custkey == o.o_custkey, "left").groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.k = b.k) GROUP BY side""")
def reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return agg.reconcile(o, c, ["k"])


@query("""SELECT * , n_new - n_old AS n_diff, round(total_new - total_old, 2) AS total_diff FROM
(SELECT o_orderpriority, count(*) AS n_old, round(sum(o_totalprice), 2) AS total_old FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
FULL JOIN (SELECT o_orderpriority, count(*) AS n_new, round(sum(o_totalprice), 2) AS total_new FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) USING (o_orderpriority)""")
def version_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.lit("1998-01-01").cast("timestamp_ntz")
    made = lambda x: x.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    both = agg.compare_runs(made(o.where(F.col("o_orderdate") < day)), made(o.where(F.col("o_orderdate") >= day)), ["o_orderpriority"], ["n", "total"])
    return both.withColumn("total_diff", F.round("total_diff", 2))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
count(DISTINCT l_suppkey) AS suppliers, round(median(l_extendedprice), 4) AS median_price, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_price, round(avg((l_discount > 0.05)::INT), 6) AS share_discounted,
round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv_quantity, round(quantile_disc(l_extendedprice, 0.25), 4) AS q25_price, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted_discount
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")
def aggregates_by_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
            F.count_distinct("l_suppkey").alias("suppliers"),
            F.round(F.median("l_extendedprice"), 4).alias("median_price"),
            F.round(F.percentile("l_extendedprice", 0.9), 4).alias("p90_price"),
            F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("share_discounted"),
            F.round(F.stddev_samp("l_quantity") / F.avg("l_quantity"), 6).alias("cv_quantity"),
            F.round(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY l_extendedprice)"), 4).alias("q25_price"),
            F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("weighted_discount"),
        )
        .where("n > 10")
    )


_STATUS = ["F", "O", "P"]


@query(
    "SELECT o_orderpriority, " + ", ".join(f"round(count(*) FILTER (o_orderstatus = '{s}') / count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')), 6) AS \"{s}\"" for s in _STATUS) + " FROM orders GROUP BY o_orderpriority"
)
def crosstab(spark, sf_dir):
    shares = agg.crosstab_shares(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", _STATUS)
    return shares.select("o_orderpriority", *[F.round(F.col(s), 6).alias(s) for s in _STATUS])


@query("""SELECT user_id, event_type, n AS votes FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1""")
def majority_value(spark, sf_dir):
    return agg.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""WITH a AS (SELECT event_type, count(*) / (SELECT count(*) FROM events WHERE value > 50) AS s FROM events WHERE value > 50 GROUP BY 1),
b AS (SELECT event_type, count(*) / (SELECT count(*) FROM events WHERE value <= 50) AS s FROM events WHERE value <= 50 GROUP BY 1)
SELECT event_type, round(coalesce(a.s, 0), 6) AS share_a, round(coalesce(b.s, 0), 6) AS share_b, round(coalesce(a.s, 0) - coalesce(b.s, 0), 6) AS difference FROM a FULL JOIN b USING (event_type)""")
def share_differences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return agg.share_difference(e.where("value > 50"), e.where("value <= 50"), "event_type").select("event_type", *[r6(F.col(c)).alias(c) for c in ("share_a", "share_b", "difference")])


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1)
SELECT l_suppkey, a AS rank_n, b AS rank_revenue, c AS rank_discount, a + b + c AS rank_sum FROM (SELECT l_suppkey,
 rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS a, rank() OVER (ORDER BY revenue DESC) + (count(*) OVER (PARTITION BY revenue) - 1) / 2 AS b,
 rank() OVER (ORDER BY discount) + (count(*) OVER (PARTITION BY discount) - 1) / 2 AS c FROM s)""")
def rank_sum_ranking(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return agg.rank_sum(s, "l_suppkey", {"n": True, "revenue": True, "discount": False})


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('7:' || l_linenumber::VARCHAR), l_linenumber, l_suppkey) AS k FROM lineitem) WHERE k = 1""")
def one_row_per_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return agg.one_per_group(li, ["l_orderkey"], "l_linenumber", 7)


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 5)) GROUP BY 1, 2""")
def top_n_restriction(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    top = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(5).select("l_suppkey")
    return li.join(F.broadcast(top), "l_suppkey", "left_semi").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT k, source FROM (SELECT c_custkey AS k, 'customer' AS source FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_suppkey AS k, 'supplier' AS source FROM supplier WHERE s_acctbal > 5000)
UNION ALL (SELECT k, 'difference' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders))""")
def set_operations(spark, sf_dir):
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    rich = c.where("c_acctbal > 9000").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("source")).unionByName(s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("source")))
    none = c.select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct().withColumn("source", F.lit("difference"))
    return rich.unionByName(none)


@query("""SELECT l_orderkey, first_position, last_position, CASE WHEN n >= 2 AND last_position <> first_position THEN sign(last_position - first_position)::INT END AS direction FROM
(SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS first_position, arg_max(l_suppkey, (l_linenumber, l_suppkey)) AS last_position, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)""")
def direction_by_first_last(spark, sf_dir):
    return agg.direction(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_suppkey"))


@query("""SELECT band, status, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN 'low' WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN 'mid' WHEN o_totalprice > 150000 THEN 'high' END AS band, o_orderstatus AS status FROM orders) GROUP BY 1, 2""")
def fixed_bins(spark, sf_dir):
    inf = float("inf")
    return table(spark, sf_dir, "orders").select(cut(F.col("o_totalprice"), [0, 50000, 150000, inf], ["low", "mid", "high"]).alias("band"), F.col("o_orderstatus").alias("status")).groupBy("band", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, [0, 1.0/3, 2.0/3, 1]) AS e FROM events GROUP BY 1)
SELECT event_type, tercile, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, CASE WHEN value <= e[2] THEN 1 WHEN value <= e[3] THEN 2 ELSE 3 END AS tercile FROM events JOIN q USING (event_type)) GROUP BY 1, 2""")
def quantile_terciles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    return quantile_bins(e, ["event_type"], "value", [1 / 3, 2 / 3], "tercile").groupBy("event_type", "tercile").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@query("""SELECT least(floor(value / 25), 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1""")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.least(F.floor(F.col("value") / 25), F.lit(10)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS q1, max(l_quantity) FILTER (l_linenumber = 2) AS q2, max(l_quantity) FILTER (l_linenumber = 2) - max(l_quantity) FILTER (l_linenumber = 1) AS difference,
 bool_and(l_returnflag = 'N') AS all_n, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS first_flag, list_sort(list(DISTINCT l_returnflag))::VARCHAR[] AS flags FROM lineitem GROUP BY 1""")
def conditional_pivot(spark, sf_dir):
    q = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(q(1).alias("q1"), q(2).alias("q2"), (q(2) - q(1)).alias("difference"), F.bool_and(F.col("l_returnflag") == "N").alias("all_n"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("first_flag"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("""SELECT day::DATE AS day, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) = 0 AS missing FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS day)
LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) USING (day)""")
def calendar_audit(spark, sf_dir):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-04").cast("date"))).alias("day"))
    seen = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(seen, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("missing"))


@query("""SELECT ts::DATE AS day, count(*) AS n, round(avg((value IS NULL)::INT), 6) AS null_share, round(avg((value < 5)::INT), 6) AS low_share, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def daily_feed_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("value").isNull().cast("int"))).alias("null_share"), r6(F.avg((F.col("value") < 5).cast("int"))).alias("low_share"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))


@query("""SELECT o_orderkey % 7 AS line, round(avg((v < 100000)::INT), 6) AS punctual, round(avg(cancelled::INT), 6) AS cancelled, count(*) AS n FROM
(SELECT o_orderkey, o_orderstatus = 'P' AS cancelled, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders) GROUP BY 1""")
def punctuality_rates(spark, sf_dir):
    """Share below a strict limit among rows that ran; share cancelled among all."""
    o = table(spark, sf_dir, "orders")
    gone = F.col("o_orderstatus") == "P"
    return o.groupBy((F.col("o_orderkey") % 7).alias("line")).agg(r6(F.avg(F.when(~gone, (F.col("o_totalprice") < 100000).cast("int")))).alias("punctual"), r6(F.avg(gone.cast("int"))).alias("cancelled"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey * 2.0 - 10 AS lat, s_suppkey % 40 - 20.0 AS lon FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 2) AS metres
FROM s a JOIN s b ON a.lat = b.lat AND a.s_suppkey < b.s_suppkey WHERE abs(a.lon - b.lon) <= 3""")
def great_circle(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") * 2.0 - 10).alias("lat"), (F.col("s_suppkey") % 40 - 20.0).alias("lon"))
    # within 3 degrees of longitude: a stands in its strip of 3 degrees and both beside it, b in its own
    strip = F.floor(F.col("lon") / 3)
    a = s.select(F.col("s_suppkey").alias("a"), "lat", F.col("lon").alias("lon_a"), F.explode(F.sequence(strip - 1, strip + 1)).alias("strip"))
    b = s.select(F.col("s_suppkey").alias("b"), "lat", F.col("lon").alias("lon_b"), strip.alias("strip"))
    return a.join(b, ["lat", "strip"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("lon_a") - F.col("lon_b")) <= 3)).select("a", "b", F.round(haversine(F.col("lat"), F.col("lon_a"), F.col("lat"), F.col("lon_b")), 2).alias("metres"))


@query("""SELECT event_id, isodow(ts)::INT AS weekday, CASE WHEN isodow(ts) = 7 OR ts::DATE = DATE '2024-01-01' THEN 'sunday' WHEN isodow(ts) = 6 THEN 'saturday' WHEN isodow(ts) = 5 THEN 'friday' ELSE 'workday' END AS day_type,
 hour(ts) IN (6, 7, 8, 9, 15, 16, 17, 18, 19) AS rush, (ts - INTERVAL 3 HOURS)::DATE AS operating_day, strftime(ts, '%H:%M') AS clock, (time_bucket(INTERVAL 5 MINUTES, ts)) AS floor5 FROM events""")
def calendar_columns(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", cal.weekday(ts).alias("weekday"), cal.day_type(ts, ["2024-01-01"]).alias("day_type"), cal.rush_hour(ts).alias("rush"), cal.operating_day(ts).alias("operating_day"), F.date_format("ts", "HH:mm").alias("clock"), cal.floor_to(ts, 5).alias("floor5"))


@query("""SELECT c_custkey, regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g') AS alias, regexp_replace(substr(c_name, 9), '^#?', '#') AS tag, starts_with(c_name, 'Customer') AS named, trim(replace(c_name, 'Customer', ' ')) AS rest FROM customer""")
def string_functions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.regexp_replace(F.lower("c_mktsegment"), "[^a-z0-9]", "").alias("alias"), F.regexp_replace(F.substring("c_name", 9, 1000), "^#?", "#").alias("tag"), F.startswith("c_name", F.lit("Customer")).alias("named"), F.trim(F.replace("c_name", F.lit("Customer"), F.lit(" "))).alias("rest"))


@query("""SELECT event_id, (json_extract(props, '$.k')::BIGINT) AS k, round(ln(1 + value), 6) AS log_value, round(greatest(-3, least(15, value / 10)), 6) AS clipped, round(tanh(value / 100), 6) AS squashed FROM events WHERE (json_extract(props, '$.k')::BIGINT) >= 50""")
def json_and_math(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    v = F.col("value")
    return table(spark, sf_dir, "events").where(k >= 50).select("event_id", k.alias("k"), r6(F.log1p(v)).alias("log_value"), r6(F.greatest(F.lit(-3), F.least(F.lit(15), v / 10))).alias("clipped"), r6(F.tanh(v / 100)).alias("squashed"))


@query("""SELECT doc, user_id, event_id FROM (SELECT u.doc, e.user_id, arg_min(e.event_id, struct_pack(d := abs(epoch_us(e.ts) - epoch_us(TIMESTAMP '2024-01-10 08:00:00' + to_hours(u.doc::INT))), i := e.event_id)) AS event_id
FROM events e, (SELECT unnest(range(3)) AS doc) u GROUP BY 1, 2)""")
def nearest_in_time(spark, sf_dir):
    """Of each entity the row nearest to each of a few given times."""
    times = spark.range(3).select(F.col("id").alias("doc"), (F.lit("2024-01-10 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("t"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(times))
    return e.groupBy("doc", "user_id").agg(F.min_by("event_id", F.struct(F.abs(cal.micros("ts") - cal.micros("t")).alias("d"), F.col("event_id"))).alias("event_id"))


@query("""SELECT event_id, round(value, 6) AS s1, round((pow(greatest(value - 10, 0), 3) - pow(greatest(value - 60, 0), 3) * (120.0 - 10) / (120.0 - 60) + pow(greatest(value - 120, 0), 3) * (60.0 - 10) / (120.0 - 60)) / pow(110.0, 2), 6) AS s2 FROM events""")
def spline_columns(spark, sf_dir):
    s1, s2 = spline_basis(F.col("value"), [10.0, 60.0, 120.0])
    return table(spark, sf_dir, "events").select("event_id", r6(s1).alias("s1"), r6(s2).alias("s2"))
