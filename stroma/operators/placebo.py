"""Placebo times: for each event, times on like days at its own hour at which nothing of its kind is near.

What rules a time out are intervals around the hits. Their complement within an hour is
worked out once for each place and hour that some event asks for. A draw picks an hour in
proportion to its weight and a time within it, by hash: a run gives what the next one
gives, and no draw is ever rejected and repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, day_type, from_micros, micros, operating_day, to_local, to_utc
from stroma.operators.ranges import merge_intervals, range_count

HOUR = 3600


def hashed(seed: int, *keys: Column | str) -> Column:
    """A whole number below 2^52 from md5 of the seed and the keys."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def candidate_hours(events: DataFrame, stream: DataFrame, keys: list[str], ident: str, ts: str, days: int, zone: str = "UTC", holidays: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """(ident, keys, hour): starts, in seconds, of the local hour of each event on the days up to ``days`` before and after.

    The operating day must be another one than the event's, of the same kind, none of ``excluded``,
    and have rows of the keys in ``stream``. An hour that the clock shows never or twice is left out.
    """
    local = to_local(F.col(ts), zone)
    asked = events.where(F.col(ts).isNotNull()).select(ident, *keys, local.alias("_local"))
    # all that an event's days share is worked out before they are listed: a day later on the clock is a day later in operation
    own = operating_day(F.col("_local"))
    asked = asked.select(ident, *keys, F.date_trunc("hour", F.col("_local")).cast("timestamp_ntz").alias("_hour"), own.alias("_own"))
    like = lambda d: day_type(F.date_add("_own", d), holidays) == day_type(F.col("_own"), holidays)
    shifts = F.filter(F.sequence(F.lit(-days), F.lit(days)), lambda d: (d != 0) & like(d))
    asked = asked.select("*", F.explode(shifts).alias("_shift")).withColumn("_day", F.date_add("_own", F.col("_shift")))
    if excluded:
        asked = asked.where(~F.col("_day").cast("string").isin(excluded))
    known = stream.where(F.col(ts).isNotNull()).select(*keys, operating_day(to_local(F.col(ts), zone)).alias("_day")).distinct()
    kept = asked.join(known, [*keys, "_day"], "left_semi")
    there = F.col("_hour") + F.make_dt_interval(F.col("_shift"))
    # the clock of UTC shows every hour once
    us = micros(F.col("_hour")) + F.col("_shift").cast("long") * (24 * HOUR * MICROS) if zone == "UTC" else micros(to_utc(there, zone))
    return kept.select(ident, *keys, F.floor(us / MICROS).alias("hour")).where("hour is not null")


def free_seconds(hours: DataFrame, hits: DataFrame, keys: list[str], ts: str, before: int, after: int) -> DataFrame:
    """(keys, hour, free): for each of ``hours`` the whole seconds [start, end) at which no hit lies from ``before`` seconds before to ``after`` seconds behind.

    A hit h rules out [h - after, h + before]. The merged intervals are dealt into the
    hours they touch; as each is as long as before + after, few touch one hour.
    """
    first, last = F.ceil(micros(F.col(ts)) / MICROS).cast("long") - after, F.floor(micros(F.col(ts)) / MICROS).cast("long") + before + 1
    ruled = merge_intervals(hits.where(F.col(ts).isNotNull()).select(*keys, first.alias("_s"), last.alias("_e")), keys, "_s", "_e")
    # hours begin at any multiple of a quarter, as some zones' do; each touches the fixed hour it begins in and the next
    dealt = ruled.withColumn("_h", F.explode(F.sequence(F.floor(F.col("_s") / HOUR) - 1, F.floor(F.col("_e") / HOUR)))).groupBy(*keys, "_h").agg(F.array_sort(F.collect_list(F.struct("_s", "_e"))).alias("_ruled"))
    wanted = hours.select(*keys, "hour").distinct().withColumn("_h", F.floor(F.col("hour") / HOUR))
    found = wanted.join(dealt, [*keys, "_h"], "left")
    end = F.col("hour") + HOUR
    ruled_out = F.filter(F.coalesce("_ruled", F.array().cast("array<struct<_s:bigint,_e:bigint>>")), lambda r: (r["_s"] < end) & (r["_e"] > F.col("hour")))
    edges = F.concat(F.array(F.col("hour")), F.transform("_r", lambda r: F.least(r["_e"], end)))
    starts = F.concat(F.transform("_r", lambda r: F.greatest(r["_s"], F.col("hour"))), F.array(end))
    free = F.filter(F.zip_with(edges, starts, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda f: f["end"] > f["start"])
    return found.withColumn("_r", ruled_out).select(*keys, "hour", free.alias("free"))


def placebo_uniform(events: DataFrame, stream: DataFrame, hits: DataFrame, keys: list[str], ident: str, ts: str, k: int, days: int, before: int, after: int, seed: int, **like) -> DataFrame:
    """(ident, keys, draw, at): ``k`` times for each event, each uniform over all admissible seconds of its candidate hours. Events without any have none."""
    hours = candidate_hours(events, stream, keys, ident, ts, days, **like)
    free = free_seconds(hours, hits, keys, ts, before, after)
    pieces = hours.join(free, [*keys, "hour"]).select(ident, *keys, F.explode("free").alias("f")).select(ident, *keys, "f.start", "f.end")
    run = W.partitionBy(ident).orderBy("start")
    pieces = pieces.withColumn("_upto", F.sum(F.col("end") - F.col("start")).over(run.rowsBetween(W.unboundedPreceding, 0)))
    # 2 * days hours an event, and a few pieces an hour
    listed = pieces.groupBy(ident, *keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_upto").alias("upto"), F.col("end").alias("end")))).alias("_p"))
    drawn = listed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    drawn = drawn.withColumn("_r", F.pmod(hashed(seed, ident, "draw"), F.element_at("_p", -1)["upto"]))
    piece = F.element_at(F.filter("_p", lambda p: p["upto"] > F.col("_r")), 1)
    second = piece["end"] - piece["upto"] + F.col("_r")
    return drawn.select(ident, *keys, "draw", from_micros(second * MICROS).alias("at"))


def placebo_anchored(events: DataFrame, stream: DataFrame, hits: DataFrame, keys: list[str], ident: str, anchor: str, ts: str, k: int, days: int, before: int, after: int, lag: int, seed: int, **like) -> DataFrame:
    """(ident, keys, draw, anchor, at): ``k`` times for each event, ``lag`` seconds after a row of ``stream`` in one of its candidate hours.

    As if an hour with rows were drawn, then one of its rows, again until no hit is near:
    an hour counts with the share of its rows that are admissible, and these alike. Rows
    are numbered within their hour; a draw joins its row by that number.
    """
    hours = candidate_hours(events, stream, keys, ident, ts, days, **like)
    wanted = hours.select(*keys, "hour").distinct()
    # a row lies in the asked hour that begins in its own fixed hour or in the one before
    second = F.floor(micros(F.col(ts)) / MICROS)
    rows = stream.where(F.col(ts).isNotNull()).select(*keys, F.col(anchor).alias("anchor"), F.col(ts).alias("_ts"), second.alias("_s"))
    rows = rows.withColumn("_h", F.explode(F.array(F.floor(F.col("_s") / HOUR), F.floor(F.col("_s") / HOUR) - 1)))
    placed = rows.join(wanted.withColumn("_h", F.floor(F.col("hour") / HOUR)), [*keys, "_h"]).where((F.col("_s") >= F.col("hour")) & (F.col("_s") < F.col("hour") + HOUR))
    at = placed.select(*keys, "hour", "anchor", "_ts", from_micros(micros(F.col("_ts")) + lag * MICROS).alias("at"))
    near = range_count(at, hits.select(*keys, F.col(ts).alias("at")), keys, "at", -before * MICROS, after * MICROS, "_near")
    order = W.partitionBy(*keys, "hour").orderBy(F.col("_near") > 0, "_ts", "anchor")
    numbered = near.withColumn("_n", F.row_number().over(order) - 1)
    shares = near.groupBy(*keys, "hour").agg(F.count_if(F.col("_near") == 0).alias("_free"), F.count(F.lit(1)).alias("_all")).where("_free > 0")
    weight = F.col("_free") / F.col("_all")
    candidates = hours.join(shares, [*keys, "hour"]).groupBy(ident, *keys).agg(F.array_sort(F.collect_list(F.struct("hour", weight.alias("w"), F.col("_free").alias("free")))).alias("_c"))
    total = F.aggregate("_c", F.lit(0.0), lambda s, c: s + c["w"])
    drawn = candidates.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_u", hashed(seed, ident, "draw") / F.lit(2.0**52) * total)
    # the first hour whose weights so far exceed the draw, the last one if rounding leaves none
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("bigint").alias("hour"), F.lit(0).cast("bigint").alias("free"))
    take = lambda s, c: F.when(s["upto"] > F.col("_u"), s).otherwise(F.struct((s["upto"] + c["w"]).alias("upto"), c["hour"].alias("hour"), c["free"].alias("free")))
    chosen = drawn.withColumn("_h", F.aggregate("_c", start, take)).select(ident, *keys, "draw", F.col("_h.hour").alias("hour"), F.pmod(hashed(seed, ident, "draw", F.lit("row")), F.col("_h.free")).alias("_n"))
    return chosen.join(numbered, [*keys, "hour", "_n"]).select(ident, *keys, "draw", "anchor", "at")
