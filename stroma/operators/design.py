"""Columns of a regression: indicators against a reference level, interactions, rare levels taken together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indicators(df: DataFrame, column: str, reference: str, levels: list[str], prefix: str) -> DataFrame:
    """0 or 1 for each level but the reference; NULL stays NULL, and a level that isn't listed raises when run."""
    known = F.col(column).isNull() | F.col(column).isin(reference, *levels)
    value = F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column}: unlisted level "), F.col(column))))
    return df.withColumns({f"{prefix}_{level}": (value == level).cast("double") for level in levels if level != reference})


def interaction(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(a) * F.col(b))


def group_rare(df: DataFrame, column: str, least: int, other: str, out: str) -> DataFrame:
    """``out``: the value where at least ``least`` rows have it, else ``other``. Counts are one row a value and are joined by size."""
    often = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(F.col(column).alias("_often"))
    return df.join(often, F.col(column) == F.col("_often"), "left").withColumn(out, F.coalesce("_often", F.lit(other))).drop("_often")
