"""Aggregates beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.numbers import fisher_interval
from stroma.operators.ordered import running_sums
from stroma.sources.tables import materialise


def profile(df: DataFrame) -> DataFrame:
    """One row a column: rows, nulls, distinct values, smallest and largest (as text), median of numbers. One pass over the table.

    Distinct counts of several columns in one aggregate expand each row by the number of
    columns; columns of high cardinality cost a shuffle of their values.
    """
    aggs = []
    for i, (name, kind) in enumerate(df.dtypes):
        c = F.col(f"`{name}`")
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        aggs += [
            F.count(F.when(c.isNull(), 1)).alias(f"null_{i}"),
            F.count_distinct(c).alias(f"distinct_{i}"),
            F.min(c).cast("string").alias(f"min_{i}"),
            F.max(c).cast("string").alias(f"max_{i}"),
            (F.percentile(c, 0.5) if number else F.lit(None).cast("double")).alias(f"median_{i}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    each = [
        F.struct(F.lit(name).alias("column"), F.col("rows"), F.col(f"null_{i}").alias("nulls"), F.col(f"distinct_{i}").alias("distinct_values"), F.col(f"min_{i}").alias("smallest"), F.col(f"max_{i}").alias("largest"), F.col(f"median_{i}").alias("median"))
        for i, name in enumerate(df.columns)
    ]
    return wide.select(F.explode(F.array(*each)).alias("p")).select("p.*")


def count_distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_per_key")).groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("keys"))


def crosstab_shares(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Each row value's shares over the given column values, wide; NULL columns are zero."""
    counts = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return counts.select(row, *[(F.col(f"`{v}`") / total).alias(str(v)) for v in values])


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value))).alias(value), F.max("_n").alias("votes"))


def share_difference(df: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """Shares of each value in two populations and their difference."""
    def shares(x: DataFrame, name: str) -> DataFrame:
        total = x.agg(F.count(F.lit(1)).alias("_t"))
        return x.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total)).select(value, (F.col("_n") / F.col("_t")).alias(name))
    joined = shares(df, "share_a").join(shares(other, "share_b"), value, "full")
    return joined.select(value, F.coalesce("share_a", F.lit(0.0)).alias("share_a"), F.coalesce("share_b", F.lit(0.0)).alias("share_b")).withColumn("difference", F.col("share_a") - F.col("share_b"))


def rank_sum(df: DataFrame, key: str, criteria: dict[str, bool]) -> DataFrame:
    """Sum of average ranks over the criteria (name -> larger is better), NULL ranking last. Values are counted first, and counts are summed along them in parts."""
    # written once: ranks are joined by value, and sums made anew could differ in their last bits
    df = out = materialise(df.select(key, *criteria), "rank-sum")
    for c, larger in criteria.items():
        sign = -1.0 if larger else 1.0
        at = df.groupBy((F.coalesce(F.col(c).cast("double") * sign, F.lit(float("inf")))).alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
        rank = running_sums(at, [], "_v", {"_upto": "_m"}).select(F.col("_v"), (F.col("_upto") - (F.col("_m") - 1) / 2.0).alias(f"rank_{c}"))
        out = out.withColumn("_v", F.coalesce(F.col(c).cast("double") * sign, F.lit(float("inf")))).join(rank, "_v").drop("_v")
    return out.withColumn("rank_sum", sum((F.col(f"rank_{c}") for c in list(criteria)[1:]), F.col(f"rank_{list(criteria)[0]}"))).select(key, *[f"rank_{c}" for c in criteria], "rank_sum")


def correlate(df: DataFrame, by: list[str], x: str, y: str, least: int = 30) -> DataFrame:
    """n, correlation with Fisher's interval, least-squares slope with its HC1 standard error; NULL below ``least`` pairs.

    The residuals of the robust error need the line first. Written out, the sum of
    (x - mx)^2 e^2 is a polynomial in moments of x and y around their means, so the groups
    are read twice: once for the means, once for the moments around them.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = pairs.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    centred = (pairs.join(means, by) if by else pairs.crossJoin(F.broadcast(means))).select(*by, (F.col(x) - F.col("_mx")).alias("a"), (F.col(y) - F.col("_my")).alias("b"))
    power = lambda i, j: F.sum(F.pow("a", F.lit(i)) * F.pow("b", F.lit(j))).alias(f"s{i}{j}")
    m = centred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), power(2, 0), power(1, 1), power(0, 2), power(4, 0), power(3, 1), power(2, 2))
    slope = F.col("s11") / F.col("s20")
    meat = F.col("s22") - 2 * slope * F.col("s31") + slope * slope * F.col("s40")
    se = F.sqrt(F.greatest(meat, F.lit(0.0)) * F.col("n") / (F.col("n") - 2)) / F.col("s20")
    r = F.col("s11") / F.sqrt(F.col("s20") * F.col("s02"))
    lo, hi = fisher_interval(r, F.col("n"), least=least)
    ok = lambda c: F.when(F.col("n") >= least, c)
    return m.select(*by, "n", ok(r).alias("r"), lo.alias("r_lo"), hi.alias("r_hi"), ok(slope).alias("slope"), ok(se).alias("slope_se"), ok(slope - 1.96 * se).alias("slope_lo"), ok(slope + 1.96 * se).alias("slope_hi"))


def one_per_group(df: DataFrame, keys: list[str], ident: str, seed: int) -> DataFrame:
    """A pseudo-random row of each key: the one of the smallest md5 of seed and ``ident``, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")).cast("binary")).alias("_o"), F.struct(ident, *[c for c in rest if c != ident]).alias("_r"))
    return df.groupBy(*keys).agg(F.min(order).alias("_m")).select(*keys, "_m._r.*").select(*df.columns)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are in one side only, or in both (null-safe full join)."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_r", F.lit(1))
    on = a[keys[0]].eqNullSafe(b[f"_{keys[0]}"])
    for k in keys[1:]:
        on = on & a[k].eqNullSafe(b[f"_{k}"])
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, on, "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Two versions of a table side by side, with the differences of ``values``."""
    a = old.select(*keys, *[F.col(v).alias(f"{v}_old") for v in values])
    b = new.select(*keys, *[F.col(v).alias(f"{v}_new") for v in values])
    return a.join(b, keys, "full").withColumns({f"{v}_diff": F.col(f"{v}_new") - F.col(f"{v}_old") for v in values})


def direction(df: DataFrame, key: str, order: str, position: Column) -> DataFrame:
    """1, -1 or NULL of each key: whether the position at the largest ``order`` lies above that at the smallest; NULL if equal or with fewer than two positions."""
    at = df.withColumn("_p", position).where("_p is not null")
    g = at.groupBy(key).agg(F.min_by("_p", F.struct(order, "_p")).alias("first_position"), F.max_by("_p", F.struct(order, "_p")).alias("last_position"), F.count_distinct("_p").alias("_n"))
    way = F.when((F.col("_n") >= 2) & (F.col("last_position") != F.col("first_position")), F.signum(F.col("last_position") - F.col("first_position")).cast("int"))
    return g.select(key, "first_position", "last_position", way.alias("direction"))
