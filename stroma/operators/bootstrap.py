"""Resampling by clusters on the executors: Poisson weights from md5, one set of sums a draw."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.sources.tables import ship_package

#: Probabilities of at most 0, 1, 2, ... of Poisson's law of mean 1 (fixed values, cut at seven digits).
POISSON = [0.3678794, 0.7357589, 0.9196986, 0.9810118, 0.9963402, 0.9994058, 0.9999168]
#: Clusters of one group of the weighing, on average.
CLUSTERS = 200


def weights(seed: int, draws: int, cluster: str) -> np.ndarray:
    """How often a cluster is in each draw: Poisson(1) of the first 32 bits of md5("seed:draw:cluster")."""
    u = np.array([int(hashlib.md5(f"{seed}:{d}:{cluster}".encode()).hexdigest()[:8], 16) for d in range(draws)]) / 2.0**32
    return np.searchsorted(POISSON, u, "right")


def weight_sql(seed: int, draw: str, cluster: str) -> str:
    """The same weight as SQL text."""
    u = f"(('0x' || substr(md5('{seed}:' || {draw}::VARCHAR || ':' || {cluster}::VARCHAR), 1, 8))::UBIGINT / 4294967296.0)"
    return "(" + " + ".join(f"({u} >= {p})::INT" for p in POISSON) + ")"


def resampled_sums(values: DataFrame, cluster: str, by: str | list[str], sums: list[str], draws: int, seed: int) -> DataFrame:
    """(draw, by, sums) of the resampled clusters; draw -1 is the table as it is. Rows with a null in ``by`` are left out.

    A cluster's sums by ``by`` are computed once. Clusters are dealt into groups of a few
    hundred; a group weighs them for every draw and gives one row a draw and value of
    ``by``, so what is shuffled then doesn't grow with the clusters in a group.
    """
    ship_package(values.sparkSession)
    names_of = [by] if isinstance(by, str) else by
    values = values.na.drop(subset=[cluster, *names_of])
    cells = values.groupBy(F.col(cluster).cast("string").alias("_cluster"), *names_of).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in sums])
    many = cells.select("_cluster").distinct().count()
    dealt = cells.withColumn("_g", F.pmod(F.xxhash64("_cluster"), F.lit(max(1, -(-many // CLUSTERS)))))
    kinds = dict(values.dtypes)

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(rows["_cluster"], return_inverse=True)
        place = rows.groupby(names_of, sort=True).ngroup().to_numpy()
        steps = rows[names_of].assign(_p=place).drop_duplicates("_p").sort_values("_p")[names_of]
        w = np.array([np.concatenate([[1], weights(seed, draws, n)]) for n in names]).T
        out = {"draw": np.repeat(np.arange(-1, draws), len(steps))} | {c: np.tile(steps[c].to_numpy(), draws + 1) for c in names_of}
        for c in sums:
            m = np.zeros((len(names), len(steps)))
            np.add.at(m, (at, place), rows[c].fillna(0.0).to_numpy())
            out[c] = (w @ m).ravel()
        return pd.DataFrame(out)

    fields = ", ".join(["draw int", *[f"`{c}` {kinds[c]}" for c in names_of], *[f"`{c}` double" for c in sums]])
    return dealt.groupBy("_g").applyInPandas(weigh, fields).groupBy("draw", *names_of).agg(*[F.sum(c).alias(c) for c in sums])


def resampled_moments(values: DataFrame, cluster: str, by: str | list[str], x: str, y: str, draws: int, seed: int) -> DataFrame:
    """(draw, by, n, slope, constant): a line of ``y`` on ``x`` in each draw, from weighted sums of 1, x, y, xx and xy a cluster, so that no draw reads the rows again.

    NULL where a draw's ``x`` don't differ. Rows with a null in ``x`` or ``y`` are left out.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = values.where(a.isNotNull() & b.isNotNull()).withColumns({"_n": F.lit(1.0), "_x": a, "_y": b, "_xx": a * a, "_xy": a * b})
    s = resampled_sums(rows, cluster, by, ["_n", "_x", "_y", "_xx", "_xy"], draws, seed)
    spread = F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")
    slope = F.when(spread > 1e-9 * F.col("_n") * F.col("_xx"), (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")) / spread)
    names = [by] if isinstance(by, str) else by
    return s.select("draw", *names, F.col("_n").alias("n"), slope.alias("slope"), ((F.col("_y") - slope * F.col("_x")) / F.col("_n")).alias("constant"))


def band(draws: DataFrame, by: list[str], value: str, level: float = 0.95, estimate: str = "estimate") -> DataFrame:
    """(by, estimate, lo, hi): draw -1 and the percentile interval of the others (linear between neighbours; NULL draws don't count)."""
    drawn = F.when(F.col("draw") >= 0, F.col(value))
    a = (1 - level) / 2
    return draws.groupBy(*by).agg(F.max(F.when(F.col("draw") < 0, F.col(value))).alias(estimate), F.percentile(drawn, a).alias("lo"), F.percentile(drawn, 1 - a).alias("hi"))
