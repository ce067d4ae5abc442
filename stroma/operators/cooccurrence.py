"""Which kinds of events are active together, follow one another, or stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, from_micros, micros
from stroma.operators.ranges import asof, range_pairs

MINUTE = 60 * MICROS


def inventory(hits: DataFrame, code: str, place: str, ts: str) -> DataFrame:
    """Occurrences, distinct places and days, first and last time of each code."""
    return hits.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(place).alias("places"), F.count_distinct(F.col(ts).cast("date")).alias("days"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def simultaneous(active: DataFrame, code: str) -> DataFrame:
    """How many windows have how many codes active (windows with any)."""
    return active.groupBy("window").agg(F.count_distinct(code).alias("n_active")).groupBy("n_active").agg(F.count(F.lit(1)).alias("windows"))


def lift_pairs(active: DataFrame, code: str, windows: int | DataFrame, least: int = 1) -> DataFrame:
    """(code_a, code_b, joint, lift) of codes active in common windows: lift = P(ab) / (P(a) P(b)).

    ``active`` has one row a code and window, so a window has at most as many pairs as
    codes squared. ``windows`` is the number of all windows, or a one-row frame with it.
    """
    a, b = active.select("window", F.col(code).alias("code_a")), active.select("window", F.col(code).alias("code_b"))
    joint = a.join(b, "window").where("code_a < code_b").groupBy("code_a", "code_b").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= least)
    each = active.groupBy(code).agg(F.count(F.lit(1)).alias("_n"))
    counted = joint.join(each.select(F.col(code).alias("code_a"), F.col("_n").alias("_a")), "code_a").join(each.select(F.col(code).alias("code_b"), F.col("_n").alias("_b")), "code_b")
    total = F.lit(windows) if isinstance(windows, int) else F.col("_windows")
    if not isinstance(windows, int):
        counted = counted.crossJoin(F.broadcast(windows.toDF("_windows")))
    return counted.select("code_a", "code_b", "joint", (F.col("joint") * total / (F.col("_a") * F.col("_b"))).alias("lift"))


def follow_rates(events: DataFrame, code: str, place: str, ts: str, minutes: int, least: int) -> DataFrame:
    """(code_a, code_b, n_a, n_followed, rate): share of a's events followed by b at the same place within (t, t + minutes].

    The denominator counts all of a's events, wherever b never occurs, too. Codes with
    fewer than ``least`` events are no a.
    """
    a = events.select(place, F.col(code).alias("code_a"), F.col(ts).alias("_ta"), F.monotonically_increasing_id().alias("_i"))
    b = events.select(place, F.col(code).alias("code_b"), F.col(ts).alias("_tb"))
    pairs = range_pairs(a, b, [place], 1, minutes * MINUTE, "_ta", "_tb").where("code_a <> code_b")
    followed = pairs.groupBy("code_a", "code_b").agg(F.count_distinct(F.struct(place, "_ta")).alias("n_followed"))
    total = events.groupBy(F.col(code).alias("code_a")).agg(F.count_distinct(F.struct(place, ts)).alias("n_a")).where(F.col("n_a") >= least)
    return followed.join(total, "code_a").select("code_a", "code_b", "n_a", "n_followed", (F.col("n_followed") / F.col("n_a")).alias("rate"))


def isolated(events: DataFrame, ident: str, code: str, place: str, ts: str, minutes: int) -> DataFrame:
    """Events with no event of another code at the same place within ``minutes`` before or after, both ends included."""
    a = events.select(ident, place, F.col(code).alias("_ca"), F.col(ts).alias("_ta"))
    b = events.select(place, F.col(code).alias("_cb"), F.col(ts).alias("_tb"))
    near = range_pairs(a, b, [place], -minutes * MINUTE, minutes * MINUTE, "_ta", "_tb").where("_ca <> _cb").select(ident).distinct()
    return events.join(near, ident, "left_anti")


def with_meanings(inventory_: DataFrame, code: str, meanings: DataFrame, flagged: list[str]) -> DataFrame:
    """An inventory with each code's meaning (``unknown`` where ``meanings`` has none), whether it is known, and whether it is one of ``flagged``."""
    joined = inventory_.join(meanings.select(code, F.col("meaning").alias("_m")), code, "left")
    return joined.select(*inventory_.columns, F.coalesce("_m", F.lit("unknown")).alias("meaning"), F.col("_m").isNotNull().alias("meaning_known"), F.col(code).isin(flagged).alias("is_flagged"))


def episode_summary(episodes: DataFrame, code: str, minutes: str, breadth: str, size: str) -> DataFrame:
    """By code: episodes, quartiles and maximum of their duration, median and maximum of their breadth, median and sum of their size."""
    q = lambda c, x: F.percentile(c, x)
    return episodes.groupBy(code).agg(
        F.count(F.lit(1)).alias("episodes"), q(minutes, 0.5).alias("minutes_median"), q(minutes, 0.25).alias("minutes_q25"), q(minutes, 0.75).alias("minutes_q75"), F.max(minutes).alias("minutes_max"),
        q(breadth, 0.5).alias("breadth_median"), F.max(breadth).alias("breadth_max"), q(size, 0.5).alias("size_median"), F.sum(size).alias("size_sum"),
    )


def isolated_anywhere(episodes: DataFrame, ident: str, code: str, places: str, begin: str, end: str, events: DataFrame, place: str, ts: str, minutes: int) -> DataFrame:
    """Episodes with no event of another code at any of their places from ``minutes`` before their begin to ``minutes`` after their end. ``places`` is an array."""
    members = episodes.select(ident, F.explode(places).alias(place))
    return episodes.join(not_alone(episodes, members, ident, code, begin, end, events, place, ts, minutes), ident, "left_anti")


def not_alone(episodes: DataFrame, members: DataFrame, ident: str, code: str, begin: str, end: str, events: DataFrame, place: str, ts: str, minutes: int) -> DataFrame:
    """(ident) of the episodes that an event of another code is near to, at a place that ``members`` (ident, place) names for them.

    No pairs with events are made: each member looks up the last event at or before its widened end that has
    another code. Of each time and place only matters whether it has one code, and which; if
    that is the episode's own, the last time before it that hasn't this code alone decides.
    """
    along = W.partitionBy(place).orderBy("_at")
    times = events.where(F.col(ts).isNotNull() & F.col(code).isNotNull() & F.col(place).isNotNull()).groupBy(place, F.col(ts).alias("_at")).agg(F.min(code).alias("_lo"), F.max(code).alias("_hi"))
    times = times.withColumn("_one", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))
    times = times.withColumns({"_before": F.lag("_at").over(along), "_same": F.coalesce(F.lag("_one").over(along) == F.col("_one"), F.lit(False))})
    changed = F.when(~F.col("_same"), F.struct(F.col("_before").alias("t")))
    times = times.select(place, "_at", "_one", F.last(changed, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0))["t"].alias("_other"), F.col("_at").alias("_when"))
    wide = episodes.select(ident, F.col(code).alias("_own"), (micros(begin) - minutes * MINUTE).alias("_from"), from_micros(micros(end) + minutes * MINUTE).alias("_at"))
    found = asof(members.where(F.col(place).isNotNull()).join(wide, ident), times, [place], "_at", ["_one", "_other", "_when"], "_when", prefix="_seen", strict=False)
    near = F.when(F.col("_seen_one") == F.col("_own"), F.col("_seen_other")).otherwise(F.col("_seen_when"))
    return found.where(F.col("_own").isNotNull() & (micros(near) >= F.col("_from"))).select(ident).distinct()


def follow_table(events: DataFrame, code: str, place: str, ts: str, minutes: int, least: int) -> DataFrame:
    """``follow_rates`` with every ordered pair of codes: those never followed have the rate 0. Codes squared are few."""
    rates = follow_rates(events, code, place, ts, minutes, least)
    total = events.groupBy(F.col(code).alias("code_a")).agg(F.count_distinct(F.struct(place, ts)).alias("n_a")).where(F.col("n_a") >= least)
    pairs = total.crossJoin(events.select(F.col(code).alias("code_b")).distinct()).where("code_a <> code_b")
    zero = F.lit(0).cast("long")
    return pairs.join(rates.drop("n_a"), ["code_a", "code_b"], "left").select("code_a", "code_b", "n_a", F.coalesce("n_followed", zero).alias("n_followed"), F.coalesce("rate", F.lit(0.0)).alias("rate"))
