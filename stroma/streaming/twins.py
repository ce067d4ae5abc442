"""Streaming twins of the first and latest record, the state grid and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """One row a key within the watermark; later repeats are dropped, and state older than ``late`` with them."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest_per_key(stream: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The row of the latest time of each key, NULL times last; of equal times the one of the largest ``tie``. Run it in update mode; its state is one row a key."""
    rest = [c for c in stream.columns if c not in keys]
    packed = F.max(F.struct(F.col(ts).alias("_1"), F.col(tie).alias("_2"), F.struct(*rest).alias("_3"))).alias("_m")
    return stream.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_m._3.{c}").alias(c) for c in rest])


def tumbling_state(stream: DataFrame, entity: str, ts: str, value: str, minutes: int, late: str) -> DataFrame:
    """n, mean and maximum of each entity and window, in append mode once the watermark has passed the window."""
    w = F.window(ts, f"{minutes} minutes")
    return stream.withWatermark(ts, late).groupBy(w, entity).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top")).select(F.col("window.start").alias("window"), entity, "n", "mean", "top")


def sessions(stream: DataFrame, keys: list[str], ts: str, gap_minutes: int, late: str) -> DataFrame:
    """Sessions of each key: first and last time and number of rows; a gap of exactly ``gap_minutes`` still belongs."""
    w = F.session_window(ts, f"{gap_minutes} minutes")
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("session_window")
