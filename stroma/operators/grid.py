"""Dense time grids with honest nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, ceil_to, floor_to, from_micros, micros
from stroma.functions.numbers import no_nan
from stroma.sources.tables import materialise


def axis(df: DataFrame, ts: str, minutes: int, out: str = "window") -> DataFrame:
    """All window starts from the first to the last time: one row of bounds, exploded."""
    step = minutes * 60 * MICROS
    bounds = df.agg(F.min(micros(F.col(ts))).alias("a"), F.max(micros(F.col(ts))).alias("b"))
    floor = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(step))
    return bounds.where("a is not null").select(F.explode(F.sequence(floor("a"), floor("b"), F.lit(step))).alias("_us")).select(from_micros(F.col("_us")).alias(out))


def local_axis(spark, first: str, last: str, zone: str, minutes: int) -> DataFrame:
    """UTC and local window starts of the local days ``first`` to ``last``; a day of 23 or 25 hours has as many windows."""
    step = minutes * 60 * MICROS
    bounds = spark.range(1).select(
        F.unix_micros(F.to_utc_timestamp(F.lit(first).cast("timestamp"), zone)).alias("a"),
        F.unix_micros(F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), zone)).alias("b"),
    )
    times = bounds.select(F.explode(F.sequence(F.col("a"), F.col("b") - step, F.lit(step))).alias("us"))
    utc = F.timestamp_micros("us")
    return times.select(utc.cast("timestamp_ntz").alias("window"), F.from_utc_timestamp(utc, zone).cast("timestamp_ntz").alias("window_local"))


def dense(times: DataFrame, entities: DataFrame, sparse: DataFrame, keys: list[str]) -> DataFrame:
    """Every entity at every time, with what ``sparse`` has there and NULL where it has nothing.

    The axes are crossed, which is the size of the grid itself; Spark broadcasts the side that its statistics call small.
    """
    return times.crossJoin(entities).join(sparse, keys, "left")


def state_grid(events: DataFrame, entity: str, ts: str, value: str, minutes: int, over: float, cancelled: Column | None = None) -> DataFrame:
    """State of every entity in every window: n, mean, median, p90 and share above ``over`` of the values, n_cancelled.

    Three kinds of nothing stay apart: a cell without any event is NULL throughout; one with
    cancelled events alone has n = 0, n_cancelled > 0 and NULL statistics; one with events
    has all. NaN values are NULL values.
    """
    gone = cancelled if cancelled is not None else F.lit(False)
    at = events.select(entity, floor_to(ts, minutes).alias("window"), F.when(~gone, no_nan(F.col(value))).alias("_v"), gone.alias("_gone"))
    cells = at.groupBy("window", entity).agg(
        F.count_if(~F.col("_gone")).alias("n"),
        F.avg("_v").alias("mean"),
        F.percentile("_v", 0.5).alias("median"),
        F.percentile("_v", 0.9).alias("p90"),
        F.avg((F.col("_v") > over).cast("double")).alias("share_over"),
        F.count_if("_gone").alias("n_cancelled"),
    )
    cells = materialise(cells, "grid-cells")  # the axes come from the cells, so the events are read once
    return dense(axis(cells, "window", minutes), cells.select(entity).distinct(), cells, ["window", entity])


def gap_variation(events: DataFrame, keys: list[str], ts: str, tie: str, minutes: int) -> DataFrame:
    """Coefficient of variation of the gaps to the row before, by key and window of the later row; NULL below two gaps."""
    w = W.partitionBy(*keys).orderBy(ts, tie)
    gaps = events.withColumn("_g", (micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)) / (60.0 * MICROS)).where("_g is not null")
    return gaps.groupBy(*keys, floor_to(ts, minutes).alias("window")).agg(F.count("_g").alias("n_gaps"), F.when((F.count("_g") >= 2) & (F.avg("_g") > 0), F.stddev_samp("_g") / F.avg("_g")).alias("cv"))


def right_closed(events: DataFrame, keys: list[str], ts: str, value: str, minutes: int) -> DataFrame:
    """Counts and sums by right-closed, right-labelled windows."""
    return events.groupBy(*keys, ceil_to(ts, minutes).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def rolling(cells: DataFrame, keys: list[str], window: str, value: str, before: int, after: int, out: str, how: str = "sum") -> DataFrame:
    """Sum, mean or maximum over the rows from ``before`` before to ``after`` after, of dense cells."""
    w = W.partitionBy(*keys).orderBy(window).rowsBetween(-before, after)
    return cells.withColumn(out, getattr(F, how)(value).over(w))
