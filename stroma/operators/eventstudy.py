"""Event study: clusters of hits, matched controls, aligned curves, bootstrap by clusters of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, day_type, floor_to, from_micros, micros, to_local, to_utc
from stroma.operators.bootstrap import band, resampled_sums
from stroma.operators.ordered import sessionize

DAY = 86_400 * MICROS
MINUTE = 60 * MICROS


def cluster_events(hits: DataFrame, place: str, way: str, ident: str, ts: str, gap_minutes: float, least: int) -> DataFrame:
    """Events (event_id, place, way, t0, n, t1): sessions of each place over all ways.

    The way is the most frequent in the session (of equals the smallest); n counts its
    distinct idents and must reach ``least``; t0 is its first hit. Null times drop out.
    """
    s = sessionize(hits.where(F.col(ts).isNotNull()), [place], ts, ident, gap_minutes, "_s")
    by_way = s.groupBy(place, "_s", way).agg(F.count(F.lit(1)).alias("_votes"), F.count_distinct(ident).alias("n"), F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    best = by_way.where(F.col(way).isNotNull()).groupBy(place, "_s").agg(F.min(F.struct((-F.col("_votes")).alias("v"), F.col(way).alias("way"), "n", "t0", "t1")).alias("b"))
    out = best.select(place, F.col("b.way").alias(way), "b.t0", "b.t1", "b.n").where(F.col("n") >= least)
    return out.withColumn("event_id", F.concat_ws("|", F.col(place).cast("string"), F.date_format("t0", "yyyyMMddHHmmssSSSSSS")))


def matched_controls(events: DataFrame, blockers: DataFrame, keys: list[str], days: int, before: int, after: int, k: int, seed: int, holidays: list[str] | None = None, at_most: bool = False, zone: str = "UTC") -> DataFrame:
    """``k`` control times of each event: (event_id, keys, t0, control); with ``at_most`` up to ``k`` of every event that has any.

    Candidates are the same minute of the day on other days within ``days`` of the same
    kind of day; one is rejected if a ``blockers`` time (keys, ts) lies in
    [candidate - before, candidate + after] minutes. Of the rest the ``k`` of the smallest
    md5 of seed, event and day are taken; events with fewer drop out unless ``at_most``.
    Minutes, days and kinds of day are those of ``zone``, so that a control on the other
    side of a change of clocks stands at the same local minute. Days are exploded
    (2 * days a event) and the rejection is an equi-join on buckets as long as the window.
    """
    if zone != "UTC":
        local = events.withColumn("t0", to_local(F.col("t0"), zone))
        found = matched_controls(local, blockers.withColumn("ts", to_local(F.col("ts"), zone)), keys, days, before, after, k, seed, holidays, at_most)
        return found.drop("t0").join(events.select("event_id", "t0"), "event_id").select("event_id", *keys, "t0", to_utc(F.col("control"), zone, strict=False).alias("control"))
    us = micros("t0")
    shift = F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_d")
    cand = events.select("event_id", *keys, "t0", shift).where("_d <> 0").withColumn("_us", us - F.pmod(us, F.lit(MINUTE)) + F.col("_d") * DAY)
    cand = cand.withColumn("control", from_micros(F.col("_us"))).where(day_type(F.col("control"), holidays) == day_type(F.col("t0"), holidays))
    width = (before + after) * MINUTE
    lo = F.col("_us") - before * MINUTE
    asked = cand.withColumn("_b", F.explode(F.array(F.floor(lo / width), F.floor((lo + width) / width))))
    b = blockers.select(*keys, micros("ts").alias("_bus")).withColumn("_b", F.floor(F.col("_bus") / width))
    hit = (F.col("_bus") >= F.col("_us") - before * MINUTE) & (F.col("_bus") <= F.col("_us") + after * MINUTE)
    rejected = asked.join(b, [*keys, "_b"]).where(hit).select("event_id", "control").distinct()
    free = cand.join(rejected, ["event_id", "control"], "left_anti")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("event_id").cast("string"), F.col("_d").cast("string")).cast("binary"))
    # at most 2 * days candidates an event, so they fit one row
    best = free.groupBy("event_id", *keys, "t0").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "control"))).alias("c")).where(F.size("c") >= (1 if at_most else k))
    return best.select("event_id", *keys, "t0", F.explode(F.slice("c", 1, k)).alias("c")).select("event_id", *keys, "t0", "c.control")


def aligned_curves(times: DataFrame, cells: DataFrame, ident: list[str], keys: list[str], ts: str, minutes: int, offsets: range, value: str) -> DataFrame:
    """(ident, rel_min, value): the cell values at the floor of ``ts`` plus each offset; NULL where there is no cell. Offsets are exploded, so the join is an equi-join."""
    at = times.select(*ident, *keys, floor_to(ts, minutes).alias("_f"), F.explode(F.array(*[F.lit(m) for m in offsets])).alias("rel_min"))
    at = at.withColumn("window", from_micros(micros("_f") + F.col("rel_min").cast("long") * MINUTE))
    return at.join(cells.select(*keys, "window", value), [*keys, "window"], "left").select(*ident, "rel_min", value)


def response(event_curves: DataFrame, control_curves: DataFrame, value: str) -> DataFrame:
    """(event_id, rel_min, difference): event less the mean of its controls, NULL if either is NULL."""
    mean = control_curves.groupBy("event_id", "rel_min").agg(F.avg(value).alias("_m"))
    return event_curves.join(mean, ["event_id", "rel_min"], "left").select("event_id", "rel_min", (F.col(value) - F.col("_m")).alias("difference"))


def cluster_bootstrap(values: DataFrame, cluster: str, by: str, value: str, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean of ``value`` for each ``by`` and the percentile band over ``draws`` resamples of the clusters, weighed on the executors."""
    known = values.where(F.col(value).isNotNull()).withColumn("_s", F.col(value).cast("double")).withColumn("_n", F.lit(1.0))
    drawn = resampled_sums(known, cluster, by, ["_s", "_n"], draws, seed).withColumn("_m", F.try_divide("_s", "_n"))
    return band(drawn, [by], "_m", level, "mean")


def baseline_corrected(curves: DataFrame, ident: list[str], value: str, first: int, last: int) -> DataFrame:
    """Each curve less its own mean over rel_min in [first, last]."""
    base = curves.where(F.col("rel_min").between(first, last)).groupBy(*ident).agg(F.avg(value).alias("_base"))
    return curves.join(base, ident, "left").withColumn(value, F.col(value) - F.col("_base")).drop("_base")


def event_duration(events: DataFrame, hits: DataFrame, place: str, ts: str, gap_minutes: int, within_hours: int) -> DataFrame:
    """``events`` (event_id, place, t0) with ``minutes`` from t0 to the last of the place's hits before the first gap of more than ``gap_minutes``, looking ``within_hours`` ahead; all ways of the place count.

    No pairs are made. Hits, each time once, stand in their bucket of ``within_hours`` and in the one
    before, so all that an event sees is in its own bucket. There it reads the first hit from t0 on with
    the end of that hit's run, and the last hit within its hours: two running frames over the same rows.
    """
    span, gap = within_hours * 3600 * MICROS, gap_minutes * MINUTE
    row = F.struct(*events.columns)
    left = events.select(place, F.floor(micros("t0") / span).alias("_b"), micros("t0").alias("_us"), F.lit(None).cast("long").alias("_hit"), row.alias("_row"))
    seen = hits.where(F.col(ts).isNotNull() & F.col(place).isNotNull()).select(place, micros(ts).alias("_us")).distinct()
    seen = seen.withColumn("_b", F.explode(F.array(F.floor(F.col("_us") / span) - 1, F.floor(F.col("_us") / span))))
    right = seen.select(place, "_b", "_us", F.col("_us").alias("_hit"), F.lit(None).cast(events.select(row).schema[0].dataType).alias("_row"))
    upto = W.unboundedPreceding
    back = W.partitionBy(place, "_b").orderBy(F.col("_us").desc(), F.col("_hit").asc_nulls_last())  # a hit at t0 is seen from t0
    ahead = W.partitionBy(place, "_b").orderBy(F.when(F.col("_hit").isNull(), F.col("_us") + span).otherwise(F.col("_us")), F.col("_hit").asc_nulls_last())
    both = left.unionByName(right).withColumn("_next", F.last("_hit", ignorenulls=True).over(back.rowsBetween(upto, -1)))
    ends = F.when(F.col("_next") - F.col("_hit") > gap, F.col("_hit"))  # the last one's run ends beyond what an event of the bucket sees
    both = both.withColumns({"_first": F.last("_hit", ignorenulls=True).over(back.rowsBetween(upto, 0)), "_end": F.last(ends, ignorenulls=True).over(back.rowsBetween(upto, 0))})
    both = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(ahead.rowsBetween(upto, 0))).where("_row is not null")
    there = (F.col("_first") - F.col("_us") <= gap) & (F.col("_first") <= F.col("_us") + span)
    minutes = (F.least("_end", "_last") - F.col("_us")) / (1.0 * MINUTE)
    return both.select("_row.*", F.coalesce(F.when(there, minutes), F.lit(0.0)).alias("minutes"))


def across_places(events: DataFrame, gap_minutes: int, tie: str) -> DataFrame:
    """Episodes over all places: ``events`` (t0, ...) numbered by gaps of more than ``gap_minutes``; the first event of an episode stands for it.

    One order over all events, so the sessions are found by days first: an episode ends
    at the latest where a day has no event near its end. Days are parts, borders are
    joined by the last time of the days before.
    """
    day = events.withColumn("_day", F.col("t0").cast("date"))
    inside = W.partitionBy("_day").orderBy("t0", tie)
    last = day.groupBy("_day").agg(F.max("t0").alias("_last"))
    before = last.select("_day", F.lag("_last").over(W.orderBy("_day")).alias("_before"))  # one row a day
    gap = micros("t0") - micros(F.coalesce(F.lag("t0").over(inside), F.col("_before")))
    begins = day.join(before, "_day").withColumn("_b", F.coalesce(gap > gap_minutes * MINUTE, F.lit(True)))
    # a row belongs to the last beginning at or before it, in its day or an earlier one
    start = F.when(F.col("_b"), F.struct("t0", F.col(tie).alias("tie")))
    own = begins.withColumn("_s", F.last(start, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    ends = own.groupBy("_day").agg(F.max("_s").alias("_e"))
    carried = ends.select("_day", F.last("_e", ignorenulls=True).over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))  # one row a day
    named = own.join(carried, "_day").withColumn("_s", F.coalesce("_s", "_c"))
    return named.withColumn("episode_t0", F.col("_s.t0")).withColumn("representative", F.col("_s.tie")).drop("_day", "_before", "_b", "_s", "_c")
