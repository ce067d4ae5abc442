"""Robust two-sample tests, placebo times and resampled slopes on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.functions.numbers import cut, r6
from stroma.operators import placebo, ranges, survival, var
from stroma.operators.bootstrap import band, resampled_moments, weight_sql
from stroma.plans.base import SQL, query, table
from stroma.plans.inference import _RECOVERY, _recovery
from stroma.plans.models import _HOURLY, _TIMES, _hourly, _times
from stroma.sources import builder
from stroma.sources.tables import materialise, new_folder

_INF = float("inf")


@query(f"""WITH {_TIMES}, r AS (SELECT user_id // 3 % 2 AS half, late::INT AS z, t, e::INT AS e, user_id AS c FROM times),
u AS (SELECT half, t, sum(e) AS d, count(*) AS m, sum(z) AS mz FROM r GROUP BY 1, 2),
k AS (SELECT half, t, d, sum(m) OVER w AS n, sum(mz) OVER w / sum(m) OVER w AS s FROM u WINDOW w AS (PARTITION BY half ORDER BY t DESC)),
l AS (SELECT *, sum(d / n) OVER w AS h, sum(s * d / n) OVER w AS a FROM k WINDOW w AS (PARTITION BY half ORDER BY t)),
p AS (SELECT half, c, e, e * (z - s) - CASE WHEN z = 1 THEN h - a ELSE -a END AS psi FROM r JOIN l USING (half, t)),
g AS (SELECT half, c, count(*) AS n, sum(e) AS e, sum(psi) AS u FROM p GROUP BY 1, 2),
s AS (SELECT half, sum(n)::BIGINT AS n, sum(e)::BIGINT AS events, sum(u) AS score, sum(u * u) AS robust FROM g GROUP BY 1),
v AS (SELECT half, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * s * (1 - s) ELSE 0 END) AS information FROM l GROUP BY 1)
SELECT half, n, events, round(score, 6) AS score, round(information, 6) AS information, round(score * score / robust, 6) AS chi2, round(score / information, 6) AS log_ratio, round(sqrt(robust) / information, 6) AS robust_se FROM s JOIN v USING (half)""")
def logrank_robust(spark, sf_dir):
    """Late against early purchases, errors by user, in two halves of the users at once."""
    x = _times(spark, sf_dir).withColumn("half", F.floor(F.col("user_id") / 3) % 2)
    got = survival.logrank_robust(x, ["half"], "late", "t", "e", "user_id")
    return got.select("half", "n", "events", *[r6(F.col(c)).alias(c) for c in ("score", "information", "chi2", "log_ratio", "robust_se")])


# --- placebo times ----------------------------------------------------------

_K, _DAYS, _SEED = 5, 14, 17
#: Seconds before and after a placebo time that must be without a hit.
_BEFORE, _AFTER = 3600, 14_400

_KIND = "CASE isodow({0}) WHEN 7 THEN 3 WHEN 6 THEN 2 WHEN 5 THEN 1 ELSE 0 END"
_DRAW = "('0x' || substr(md5('17:' || event_id::VARCHAR || ':' || draw::VARCHAR{0}), 1, 13))::UBIGINT::BIGINT"
_HOURS = f"""ev AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), known AS (SELECT DISTINCT user_id, (ts - INTERVAL 3 HOURS)::DATE AS day FROM events),
ask AS (SELECT event_id, user_id, (ts - INTERVAL 3 HOURS)::DATE AS own, date_trunc('hour', ts) + to_days(d::INT) AS h FROM ev, (SELECT unnest(range(-{_DAYS}, {_DAYS} + 1)) AS d) WHERE d <> 0),
hours AS (SELECT event_id, ask.user_id, epoch_us(h) // 1000000 AS hour FROM ask JOIN known ON known.user_id = ask.user_id AND known.day = (h - INTERVAL 3 HOURS)::DATE WHERE (h - INTERVAL 3 HOURS)::DATE <> own AND {_KIND.format("(h - INTERVAL 3 HOURS)::DATE")} = {_KIND.format("own")}),
draws AS (SELECT unnest(range({_K})) AS draw)"""


def _placebo(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return e, e.where("event_type = 'error'")


@query(f"""WITH {_HOURS}, slots AS (SELECT DISTINCT user_id, hour FROM hours),
ruled AS (SELECT s.user_id, s.hour, greatest(s.hour, (epoch_us(ts) + 999999) // 1000000 - {_AFTER}) AS a, least(s.hour + 3600, epoch_us(ts) // 1000000 + {_BEFORE} + 1) AS b FROM slots s JOIN ev ON ev.user_id = s.user_id AND (epoch_us(ts) + 999999) // 1000000 - {_AFTER} < s.hour + 3600 AND epoch_us(ts) // 1000000 + {_BEFORE} + 1 > s.hour
 UNION ALL SELECT user_id, hour, hour, hour FROM slots UNION ALL SELECT user_id, hour, hour + 3600, hour + 3600 FROM slots),
free AS (SELECT user_id, hour, p AS s, a AS e FROM (SELECT *, max(b) OVER (PARTITION BY user_id, hour ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ruled) WHERE a > p),
pieces AS (SELECT event_id, user_id, s, e, sum(e - s) OVER (PARTITION BY event_id ORDER BY s) AS upto, sum(e - s) OVER (PARTITION BY event_id) AS total FROM hours JOIN free USING (user_id, hour))
SELECT event_id, user_id, draw::INT AS draw, make_timestamp(((s + x - (upto - (e - s))) * 1000000)::BIGINT) AS at FROM (SELECT *, {_DRAW.format("")} % total AS x FROM pieces, draws) WHERE x < upto AND x >= upto - (e - s)""")
def placebo_uniform(spark, sf_dir):
    """Five seconds for each error, uniform over the admissible ones of its hour on like days of its user."""
    e, errors = _placebo(spark, sf_dir)
    return placebo.placebo_uniform(errors, e, errors, ["user_id"], "event_id", "ts", _K, _DAYS, _BEFORE, _AFTER, _SEED)


@query(f"""WITH {_HOURS}, slots AS (SELECT DISTINCT user_id, hour FROM hours),
anchors AS (SELECT s.user_id, s.hour, o.event_id AS anchor, o.ts, o.ts + INTERVAL 120 SECONDS AS at, EXISTS (SELECT 1 FROM ev x WHERE x.user_id = o.user_id AND x.ts BETWEEN o.ts + INTERVAL 120 SECONDS - INTERVAL {_BEFORE} SECONDS AND o.ts + INTERVAL 120 SECONDS + INTERVAL {_AFTER} SECONDS) AS near FROM slots s JOIN events o ON o.user_id = s.user_id AND epoch_us(o.ts) // 1000000 >= s.hour AND epoch_us(o.ts) // 1000000 < s.hour + 3600),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY near, ts, anchor) - 1 AS nth FROM anchors),
w AS (SELECT user_id, hour, count_if(NOT near) AS free, count_if(NOT near) / count(*) AS w FROM anchors GROUP BY 1, 2 HAVING count_if(NOT near) > 0),
c AS (SELECT event_id, user_id, hour, free, sum(w) OVER (PARTITION BY event_id ORDER BY hour) AS upto, sum(w) OVER (PARTITION BY event_id) AS total FROM hours JOIN w USING (user_id, hour)),
d AS (SELECT event_id, user_id, draw, min_by(hour, upto) AS hour, min_by(free, upto) AS free FROM (SELECT *, {_DRAW.format("")} / 4503599627370496.0 * total AS u FROM c, draws) WHERE upto > u GROUP BY 1, 2, 3)
SELECT event_id, d.user_id, draw::INT AS draw, anchor, n."at" FROM d JOIN n ON n.user_id = d.user_id AND n.hour = d.hour AND nth = {_DRAW.format(" || ':row'")} % free""")
def placebo_anchored(spark, sf_dir):
    """Five times for each error, two minutes after a row of its user in its hour on like days."""
    e, errors = _placebo(spark, sf_dir)
    return placebo.placebo_anchored(errors, e, errors, ["user_id"], "event_id", "event_id", "ts", _K, _DAYS, _BEFORE, _AFTER, 120, _SEED)


_TABLE = "kind string, event_id long, user_id long, draw int, at timestamp_ntz, day string"


@query("""WITH p AS (""" + SQL["placebo_uniform"] + """) SELECT 'event' AS kind, event_id, user_id, NULL::INT AS draw, ts AS at, ts::DATE::VARCHAR AS day FROM events WHERE event_type = 'error' UNION ALL SELECT 'placebo', event_id, user_id, draw, "at", ("at")::DATE::VARCHAR FROM p""")
def episode_tables(spark, sf_dir):
    """Events and their placebos as one table built by days: in two runs, of which the second makes some days of the first anew."""
    e, errors = _placebo(spark, sf_dir)
    drawn = placebo.placebo_uniform(errors, e, errors, ["user_id"], "event_id", "ts", _K, _DAYS, _BEFORE, _AFTER, _SEED)
    rows = errors.select(F.lit("event").alias("kind"), "event_id", "user_id", F.lit(None).cast("int").alias("draw"), F.col("ts").alias("at"))
    rows = rows.unionByName(drawn.select(F.lit("placebo").alias("kind"), "event_id", "user_id", "draw", "at"))
    rows = materialise(rows.withColumn("day", F.col("at").cast("date").cast("string")), "episode-rows")
    path = new_folder(spark, "episode-tables")
    builder.build(rows.where("dayofmonth(at) <= 20"), path, "day")
    builder.build(rows.where("dayofmonth(at) > 10"), path, "day")
    return builder.read(spark, path, _TABLE)


# --- slopes by resampling ---------------------------------------------------

_SLOPE_DRAWS = 1000


@query(f"""WITH {_RECOVERY}, m AS (SELECT place, class, count(*) AS n, sum(value) AS x, sum(minutes) AS y, sum(value * value) AS xx, sum(value * minutes) AS xy FROM sev WHERE value IS NOT NULL AND minutes IS NOT NULL GROUP BY 1, 2),
w AS (SELECT draw, place, CASE WHEN draw < 0 THEN 1 ELSE {weight_sql(21, "draw", "place")} END AS w FROM (SELECT unnest(range(-1, {_SLOPE_DRAWS})) AS draw), (SELECT DISTINCT place FROM m)),
s AS (SELECT draw, class, sum(w * n) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * xx) AS xx, sum(w * xy) AS xy FROM m JOIN w USING (place) GROUP BY 1, 2),
b AS (SELECT draw, class, CASE WHEN n * xx - x * x > 1e-9 * n * xx THEN (n * xy - x * y) / (n * xx - x * x) END AS slope FROM s),
r AS (SELECT a.draw, b.class, b.slope, CASE WHEN a.slope <> 0 THEN b.slope / a.slope END AS ratio FROM b a JOIN b ON a.draw = b.draw WHERE a.class = 'low' AND b.class <> 'low')
SELECT class, round(max(slope) FILTER (draw < 0), 6) AS slope, round(quantile_cont(slope, 0.025) FILTER (draw >= 0), 6) AS slope_lo, round(quantile_cont(slope, 0.975) FILTER (draw >= 0), 6) AS slope_hi,
round(max(ratio) FILTER (draw < 0), 5) AS ratio, round(quantile_cont(ratio, 0.1) FILTER (draw >= 0), 5) AS ratio_lo, round(quantile_cont(ratio, 0.9) FILTER (draw >= 0), 5) AS ratio_hi, count(ratio) FILTER (draw >= 0) AS valid FROM r GROUP BY 1""")
def slope_ratio_bootstrap(spark, sf_dir):
    """Slope of the recovery along the severity, and its ratio to the lowest class's, with intervals over resamples of places."""
    draws = resampled_moments(_recovery(spark, sf_dir), "place", "class", "value", "minutes", _SLOPE_DRAWS, 21)
    low = draws.where("class = 'low'").select("draw", F.col("slope").alias("_low"))
    ratio = draws.where("class <> 'low'").join(low, "draw").withColumn("ratio", F.try_divide("slope", "_low"))
    slopes = band(ratio, ["class"], "slope", estimate="slope").withColumnsRenamed({"lo": "slope_lo", "hi": "slope_hi"})
    ratios = band(ratio, ["class"], "ratio", 0.8, estimate="ratio").withColumnsRenamed({"lo": "ratio_lo", "hi": "ratio_hi"})
    valid = ratio.where("draw >= 0").groupBy("class").agg(F.count("ratio").alias("valid"))
    rounded = [r6(F.col(c)).alias(c) for c in ("slope", "slope_lo", "slope_hi")] + [F.round(c, 5).alias(c) for c in ("ratio", "ratio_lo", "ratio_hi")]
    return slopes.join(ratios, "class").join(valid, "class").select("class", *rounded, "valid")


_EDGES, _LABELS = [-_INF, 50, 100, 150, _INF], ["a", "b", "c", "d"]


@query(f"""WITH {_RECOVERY}, k AS (SELECT place, CASE WHEN value <= 50 THEN 'a' WHEN value <= 100 THEN 'b' WHEN value <= 150 THEN 'c' ELSE 'd' END AS class, floor(minutes / 15)::BIGINT AS t, recovered, value FROM rec),
w AS (SELECT draw, place, CASE WHEN draw < 0 THEN 1 ELSE {weight_sql(11, "draw", "place")} END AS w FROM (SELECT unnest(range(-1, 400)) AS draw), (SELECT DISTINCT place FROM k)),
c AS (SELECT place, class, t, count_if(recovered) AS d, count(*) AS m FROM k GROUP BY 1, 2, 3),
a AS (SELECT draw, class, t, sum(w * d) AS d, sum(w * m) AS m FROM c JOIN w USING (place) GROUP BY 1, 2, 3), r AS (SELECT *, sum(m) OVER (PARTITION BY draw, class ORDER BY t DESC) AS n FROM a),
s AS (SELECT draw, class, t, CASE WHEN max((d >= n)::INT) OVER q = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER q) END AS s FROM r WHERE d > 0 WINDOW q AS (PARTITION BY draw, class ORDER BY t)),
fq AS (SELECT draw, class, coalesce(min(t) FILTER (s <= 0.5 + 1e-12), 'inf'::DOUBLE)::DOUBLE AS q FROM s GROUP BY 1, 2), l AS (SELECT class, list_sort(list(q) FILTER (draw >= 0)) AS x, max(q) FILTER (draw < 0) AS median FROM fq GROUP BY 1),
g AS (SELECT class, count(*) AS n, avg((NOT recovered)::INT) AS censored, median(value) AS severity FROM k GROUP BY 1)
SELECT class, n, round(censored, 6) AS censored, round(severity, 6) AS severity, median, x[floor((len(x) - 1) * 0.025 + 0.5)::INT + 1] AS lo, x[floor((len(x) - 1) * 0.975 + 0.5)::INT + 1] AS hi FROM g JOIN l USING (class)""")
def class_medians(spark, sf_dir):
    """Median recovery of each severity class with its interval over resamples of places, all classes in one pass."""
    k = _recovery(spark, sf_dir).select("place", cut(F.col("value"), _EDGES, _LABELS).alias("class"), F.floor(F.col("minutes") / 15).alias("t"), "recovered", "value")
    medians = survival.km_bootstrap(k, "place", "t", "recovered", 0.5, 400, 11, by=["class"])
    shares = k.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("recovered")).cast("int")).alias("censored"), F.median("value").alias("severity"))
    return shares.join(medians, "class").select("class", "n", r6(F.col("censored")).alias("censored"), r6(F.col("severity")).alias("severity"), F.col("estimate").alias("median"), "lo", "hi")


# --- hazards early and late, side peaks, network-wide blocks -----------------


def _newton_sql(name: str, rows: str) -> str:
    """CTEs that end in ``name`` (b, se): Cox's coefficient of the boolean z on rows (t, e, z), by Newton steps over tied events."""
    over = "list_sum(list_transform(range(1, len(n0) + 1), lambda i: {0}))"
    z = "(n1[i] * exp(b) / (n0[i] + n1[i] * exp(b)))"
    return f"""{name}_k AS (SELECT t, count(*) FILTER (e AND z) AS d1, count(*) FILTER (e AND NOT z) AS d0, count(*) FILTER (z) AS m1, count(*) FILTER (NOT z) AS m0 FROM ({rows}) GROUP BY 1),
{name}_r AS (SELECT *, sum(m1) OVER (ORDER BY t DESC) AS n1, sum(m0) OVER (ORDER BY t DESC) AS n0 FROM {name}_k), {name}_t AS (SELECT t, l, n0 - l / (d0 + d1) * d0 AS n0, n1 - l / (d0 + d1) * d1 AS n1 FROM (SELECT *, unnest(range(d0 + d1)) AS l FROM {name}_r WHERE d0 + d1 > 0)),
{name}_l AS (SELECT list(n0 ORDER BY t, l) AS n0, list(n1 ORDER BY t, l) AS n1, (SELECT sum(d1) FROM {name}_k) AS hits FROM {name}_t),
{name}_n(step, b) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT step + 1, b + (hits - {over.format(z)}) / {over.format(f"{z} * (1 - {z})")} FROM {name}_n, {name}_l WHERE step < 20),
{name} AS (SELECT b, 1 / sqrt({over.format(f"{z} * (1 - {z})")}) AS se FROM {name}_n, {name}_l WHERE step = 20)"""


@query(f"""WITH RECURSIVE {_TIMES}, cut_ AS (SELECT median(t)::DOUBLE AS s FROM times WHERE e), {_newton_sql("early", "SELECT least(t, s) AS t, e AND t <= s AS e, late AS z FROM times, cut_")}, {_newton_sql("later", "SELECT t, e, late AS z FROM times, cut_ WHERE t > s")}
SELECT 'late' AS term, s AS split, round(early.b, 5) AS early, round(early.se, 5) AS early_se, round(later.b, 5) AS later, round(later.se, 5) AS later_se, round(later.b - early.b, 5) AS log_ratio FROM cut_, early, later""")
def hazards_early_late(spark, sf_dir):
    """A covariate's coefficient up to the median time of the events, and after it."""
    x = _times(spark, sf_dir).select("t", "e", F.col("late").cast("double").alias("late"))
    split, rows = survival.early_late(x, ["late"], "t", "e")
    found = spark.createDataFrame([(c, split, *map(float, r)) for c, *r in rows], "term string, split double, early double, early_se double, later double, later_se double")
    return found.select("term", "split", *[F.round(c, 5).alias(c) for c in ("early", "early_se", "later", "later_se")], F.round(F.col("later") - F.col("early"), 5).alias("log_ratio"))


@query(f"""WITH {_HOURLY}, x AS (SELECT event_type, "window"::DATE AS day, "window" AS w, mean - avg(mean) OVER q AS c, var_pop(mean) OVER q AS v, count(*) OVER q AS n FROM hourly WINDOW q AS (PARTITION BY event_type, "window"::DATE)),
l AS (SELECT event_type, day, v, n, lag, sum(c * p) AS s FROM (SELECT *, CASE lag {" ".join(f"WHEN {k} THEN lag(c, {k}) OVER q" for k in range(9))} END AS p FROM x CROSS JOIN (SELECT unnest(range(9)) AS lag) WINDOW q AS (PARTITION BY event_type, day, lag ORDER BY w)) GROUP BY ALL),
a AS (SELECT event_type, lag, sum(s / v) / sum(n - lag) AS acf FROM l WHERE v > 0 AND n > lag GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(acf, 9) DESC, lag) AS k FROM a WHERE lag >= 3 AND acf IS NOT NULL)
SELECT event_type, lag::INT AS lag, round(acf, 6) AS acf FROM r WHERE k = 1""")
def acf_side_peak(spark, sf_dir):
    """Where each type's hourly autocorrelation is largest from three hours on."""
    h = _hourly(spark, sf_dir).withColumn("day", F.col("window").cast("date"))
    acf = var.pooled_acf(h, ["event_type", "day"], "window", "mean", 8, ["event_type"])
    return var.side_peak(acf, ["event_type"], 3).select("event_type", F.col("lag").cast("int").alias("lag"), r6(F.col("acf")).alias("acf"))


@query("""WITH own AS (SELECT user_id, ts AS a, ts + INTERVAL 2 HOURS AS b FROM events WHERE event_type = 'signup'), h AS (SELECT date_trunc('hour', ts) AS a, count(*) AS n FROM events GROUP BY 1), net AS (SELECT a, a + INTERVAL 1 HOUR AS b FROM h WHERE n <= (SELECT quantile_disc(n, 0.02) FROM h)),
p AS (SELECT event_id, user_id, ts - INTERVAL 10 MINUTES AS a, ts + INTERVAL 40 MINUTES AS b FROM events WHERE event_type = 'error')
SELECT event_id, EXISTS (SELECT 1 FROM own WHERE own.user_id = p.user_id AND own.a < p.b AND own.b > p.a) OR EXISTS (SELECT 1 FROM net WHERE net.a < p.b AND net.b > p.a) AS hit FROM p""")
def overlap_with_network(spark, sf_dir):
    """Whether errors lie near a block of their own user or one of the quietest hours, which hold for all."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    shift = lambda minutes: F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
    own = ranges.merge_intervals(e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("a"), shift(120).alias("b")), ["user_id"], "a", "b")
    h = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    low = h.agg(F.expr("percentile_disc(0.02) within group (order by n)").alias("_low"))
    net = h.join(F.broadcast(low), F.col("n") <= F.col("_low")).select(F.col("ts").alias("a"), shift(60).alias("b"))  # one row
    probes = e.where("event_type = 'error'").select("event_id", "user_id", shift(-10).alias("a"), shift(40).alias("b"))
    return ranges.overlaps_anywhere(probes, own, ["user_id"], "a", "b", net, "hit").select("event_id", "hit")
