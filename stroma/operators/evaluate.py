"""Scores of probabilistic forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stroma.functions.numbers import wilson
from stroma.operators.ordered import running_sums


def point_errors(df: DataFrame, by: list[str], forecast: str, truth: str) -> DataFrame:
    """n, MAE, RMSE and bias over rows where both are known."""
    e = F.col(forecast) - F.col(truth)
    return df.where(e.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def reliability(df: DataFrame, p: str, y: str, edges: list[float]) -> DataFrame:
    """(bin, n, mean_p, observed, lo, hi): bins [a, b) of the forecast, the last closed, with Wilson's interval of what was observed."""
    number = sum(((F.col(p) >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    g = df.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))
    lo, hi = wilson(F.col("observed") * F.col("n"), F.col("n"))
    return g.select("bin", "n", "mean_p", "observed", lo.alias("lo"), hi.alias("hi"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table."""
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("n")).alias("ece"))


def binary_scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """n, Brier score, log loss and AUC (ties count half). Ranks run over distinct forecasts, not rows."""
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    hit = F.col(y).cast("double")
    sums = df.groupBy(F.col(p).alias("_p")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"), F.sum(F.pow(F.col(p) - hit, 2)).alias("b"), F.sum(-hit * F.log(q) - (1 - hit) * F.log(1 - q)).alias("l")
    )
    t = running_sums(sums, [], "_p", {"_below": "neg"}, before=True).withColumn("_u", F.col("pos") * (F.col("_below") + F.col("neg") / 2))
    n = F.sum("pos") + F.sum("neg")
    return t.agg(n.cast("long").alias("n"), (F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("log_loss"), F.try_divide(F.sum("_u"), F.sum("pos") * F.sum("neg")).alias("auc"))


def crps(cdf: Column, truth: Column) -> Column:
    """Continuous ranked probability score of class shares summed up in ``cdf`` (array) for the true class (from 0): the sum over all classes but the last."""
    terms = F.transform(F.slice(cdf, F.lit(1), F.size(cdf) - 1), lambda f, i: F.pow(f - (truth <= i).cast("double"), 2))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def median_class(cdf: Column) -> Column:
    """First class whose summed share is at least one half."""
    return F.array_position(F.transform(cdf, lambda f: f >= 0.5), True) - 1


def platt(df: DataFrame, p: str, y: str, steps: int = 25) -> tuple[float, float]:
    """(a, b) of the calibrated forecast sigmoid(a * logit(p) + b), by Newton steps on sums over distinct forecasts."""
    import numpy as np

    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(p)))
    rows = df.groupBy(F.log(q / (1 - q)).alias("z")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("k"))
    a, b = 1.0, 0.0
    for _ in range(steps):
        s = 1 / (1 + F.exp(-(F.col("z") * a + b)))
        v = F.col("n") * s * (1 - s)
        r = F.col("k") - F.col("n") * s
        t = rows.agg(F.sum(r * F.col("z")), F.sum(r), F.sum(v * F.col("z") ** 2), F.sum(v * F.col("z")), F.sum(v)).first()
        move = np.linalg.solve(np.array([[t[2], t[3]], [t[3], t[4]]]) + 1e-9 * np.eye(2), np.array([t[0], t[1]]))
        a, b = a + float(move[0]), b + float(move[1])
        if np.abs(move).max() < 1e-10:
            break
    return a, b


def temperature_grid(df: DataFrame, by: list[str], row: list[str], cls: str, p: str, true: str, temperatures: list[float]) -> DataFrame:
    """(by, temperature, n, log_loss) of class shares made flatter or steeper: rows (``row``, ``cls``, ``p``, ``true``), one a class; shares are normalised within ``row``. All temperatures in one pass."""
    each = df.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    raised = each.withColumn("_q", F.pow(F.greatest(F.col(p), F.lit(1e-12)), 1 / F.col("temperature")))
    scored = raised.groupBy(*by, *row, "temperature").agg(F.sum("_q").alias("_all"), F.max(F.when(F.col(cls) == F.col(true), F.col("_q"))).alias("_hit"))
    return scored.groupBy(*by, "temperature").agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log(F.coalesce("_hit", F.lit(1e-12)) / F.col("_all"))).alias("log_loss"))


def best_temperature(grid: DataFrame, by: list[str]) -> DataFrame:
    """(by, temperature) of the least log loss, of equal ones the lower."""
    return grid.groupBy(*by).agg(F.min(F.struct("log_loss", "temperature"))["temperature"].alias("temperature"))


def criteria(simulated: DataFrame, real: DataFrame, cell: list[str], value: str, cancelled: str, late: float, band: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Five criteria of a simulation against what happened, by ``cell``, each with its rule's verdict.

    a: mean value, within a minute; b: share of the real values within the runs' band, at
    least 80 %; c: share above ``late``, within 5 points; d: share cancelled, within 2
    points; e: spread (standard deviation), within a quarter.
    """
    ok = lambda c: F.when(~F.col(cancelled), F.col(c))
    stats = lambda df, s: df.groupBy(*cell).agg(F.avg(ok(value)).alias(f"{s}a"), F.avg((ok(value) > late).cast("double")).alias(f"{s}c"), F.avg(F.col(cancelled).cast("double")).alias(f"{s}d"), F.stddev_samp(ok(value)).alias(f"{s}e"))
    edges = simulated.groupBy(*cell).agg(F.percentile(ok(value), band[0]).alias("_lo"), F.percentile(ok(value), band[1]).alias("_hi"))
    inside = real.join(edges, cell).where(~F.col(cancelled)).groupBy(*cell).agg(F.avg(F.col(value).between(F.col("_lo"), F.col("_hi")).cast("double")).alias("rb"))
    both = stats(simulated, "s").join(stats(real, "r"), cell).join(inside, cell, "left")
    row = lambda name, s, r, good: F.struct(F.lit(name).alias("criterion"), s.alias("simulated"), r.alias("real"), F.coalesce(good, F.lit(False)).alias("met"))
    sa, ra, sc, rc, sd, rd, se, re, rb = (F.col(c) for c in ("sa", "ra", "sc", "rc", "sd", "rd", "se", "re", "rb"))
    rows = F.array(row("a", sa, ra, F.abs(sa - ra) <= 1), row("b", F.lit(band[1] - band[0]), rb, rb >= 0.8), row("c", sc, rc, F.abs(sc - rc) <= 0.05), row("d", sd, rd, F.abs(sd - rd) <= 0.02), row("e", se, re, F.abs(se - re) <= 0.25 * re))
    return both.select(*cell, F.explode(rows).alias("c")).select(*cell, "c.*")
