"""Operators along an order: latest record, sessions, runs, filling, gaps, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, micros


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The row of the latest ``ts`` of each key, NULL times last; of equal times the one of the largest ``tie``.

    A maximum over structs, which is combined before the shuffle, so that a hot key sends
    one row a task and no sort is needed. A null sorts below every time in a struct.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.max(F.struct(F.col(ts).alias("_1"), F.col(tie).alias("_2"), F.struct(*rest).alias("_3"))).alias("_m")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_m._3.{c}").alias(c) for c in rest]).select(*df.columns)


def sessionize(df: DataFrame, keys: list[str], ts: str, tie: str, gap_minutes: float, out: str = "session") -> DataFrame:
    """Number the sessions of each key from 1; a new one begins where the gap is longer than ``gap_minutes``."""
    w = W.partitionBy(*keys).orderBy(ts, tie)
    gap = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)
    begins = F.when(gap.isNull() | (gap > int(gap_minutes * 60 * MICROS)), 1).otherwise(0)
    return df.withColumn("_b", begins).withColumn(out, F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_b")


def sessionize_by_days(df: DataFrame, keys: list[str], ts: str, tie: str, gap_minutes: float, out: str = "session") -> DataFrame:
    """What ``sessionize`` gives, for few keys of very many rows: a task orders one key's rows of one day.

    A day's first row is compared with the last time of the key's days before, and a
    day's numbers start from the sessions begun before: one small row a key and day each.
    """

    def on(left: DataFrame, right: DataFrame) -> Column:
        same = F.lit(True)
        for c in (*keys, "_day"):
            same = same & left[c].eqNullSafe(right[f"_of_{c}"])
        return same

    dated = df.withColumn("_day", F.col(ts).cast("date"))
    named = [F.col(c).alias(f"_of_{c}") for c in (*keys, "_day")]
    days = dated.groupBy(*keys, "_day").agg(F.max(micros(F.col(ts))).alias("_last"))
    along = W.partitionBy(*keys).orderBy("_day")
    before = days.select(*named, F.lag("_last").over(along).alias("_before"))
    w = W.partitionBy(*keys, "_day").orderBy(ts, tie)
    dealt = dated.join(before, on(dated, before)).select(*dated.columns, "_before")
    gap = micros(F.col(ts)) - F.when(F.row_number().over(w) == 1, F.col("_before")).otherwise(F.lag(micros(F.col(ts))).over(w))
    begun = dealt.withColumn("_b", F.when(gap.isNull() | (gap > int(gap_minutes * 60 * MICROS)), 1).otherwise(0))
    numbered = begun.withColumn("_own", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    sums = begun.groupBy(*keys, "_day").agg(F.sum("_b").alias("_begun"))
    starts = sums.select(*named, F.coalesce(F.sum("_begun").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return numbered.join(starts, on(numbered, starts)).select(*df.columns, (F.col("_own") + F.col("_start")).alias(out))


def runs(df: DataFrame, keys: list[str], order: list[str], condition: Column, out: str = "run") -> DataFrame:
    """Gaps and islands: rows where ``condition`` holds, numbered by their run of neighbours (how many rows before it fail)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    marked = df.withColumn("_ok", F.coalesce(condition, F.lit(False))).withColumn(out, F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w))
    return marked.where("_ok").drop("_ok")


def longest_run(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Rows of the longest run of consecutive ranks of each key; of equally long ones the first."""
    w = W.partitionBy(*keys).orderBy(rank)
    seg = df.withColumn("_s", F.col(rank) - F.row_number().over(w))
    sized = seg.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys, "_s")))
    best = sized.withColumn("_best", F.max(F.struct("_n", (-F.col("_s")).alias("s"))).over(W.partitionBy(*keys)))
    return best.where(F.col("_s") == -F.col("_best.s")).drop("_s", "_n", "_best")


def absorbing(df: DataFrame, keys: list[str], order: list[str], event: Column, out: str) -> DataFrame:
    """True from the first ``event`` on that follows a row without it, within each key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ran = F.max(F.when(event, 0).otherwise(1)).over(w)
    started = df.withColumn("_hit", F.when(event & (ran == 1), 1).otherwise(0))
    return started.withColumn(out, F.max("_hit").over(w) == 1).drop("_hit")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, limit: int, out: str) -> DataFrame:
    """The last known value within the ``limit`` rows before, NULL beyond."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-limit, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def interpolate(df: DataFrame, keys: list[str], order: list[str], value: str, limit: int, out: str, strict_gap: bool = False) -> DataFrame:
    """Linear interpolation between known values by row number; the first ``limit`` rows of a longer gap are filled too, unless ``strict_gap``."""
    w = W.partitionBy(*keys).orderBy(*order)
    back = W.partitionBy(*keys).orderBy(F.col("_i").desc())  # looking back along the reversed order costs one pass
    numbered = df.withColumn("_i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).alias("v")))
    before = W.unboundedPreceding
    both = numbered.withColumn("_p", F.last(known, ignorenulls=True).over(w.rowsBetween(before, 0))).withColumn("_n", F.last(known, ignorenulls=True).over(back.rowsBetween(before, 0)))
    inside = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    span = F.col("_n._i") - F.col("_p._i")
    near = (span - 1 <= limit) if strict_gap else (F.col("_i") - F.col("_p._i") <= limit)
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p._i")) / span
    return both.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(inside & near, line)).drop("_i", "_p", "_n")


def lag_pairs(df: DataFrame, keys: list[str], order: list[str], columns: list[str], k: int = 1, suffix: str = "_prev") -> DataFrame:
    """Each row with ``columns`` of the k-th row before it; rows without one drop out."""
    w = W.partitionBy(*keys).orderBy(*order)
    lagged = df.withColumn("_there", F.lag(F.lit(1), k).over(w)).withColumns({c + suffix: F.lag(c, k).over(w) for c in columns})
    return lagged.where("_there = 1").drop("_there")


def next_with(df: DataFrame, keys: list[str], order: list[str], condition: Column, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` of the first row from itself on where ``condition`` holds."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    found = F.last(F.when(condition, F.struct(*columns)), ignorenulls=True).over(w)
    return df.withColumn("_f", found).withColumns({prefix + c: F.col(f"_f.{c}") for c in columns}).drop("_f")


def triple(df: DataFrame, keys: list[str], order: list[str], condition: Column, same: Column, out: str) -> DataFrame:
    """True where ``condition`` holds here and in the next two rows, and ``same`` is equal in the first and third."""
    w = W.partitionBy(*keys).orderBy(*order)
    ok = F.coalesce(condition, F.lit(False))
    return df.withColumn(out, F.coalesce(ok & F.lead(ok, 1).over(w) & F.lead(ok, 2).over(w) & (same == F.lead(same, 2).over(w)), F.lit(False)))


def quantile_bins(df: DataFrame, by: list[str], x: str, shares: list[float], out: str) -> DataFrame:
    """Number of the quantile bin (edges by linear percentiles, right-closed) of ``x`` within the groups ``by``; equal values share a bin."""
    edges = df.groupBy(*by).agg(F.percentile(x, shares).alias("_e")) if by else df.agg(F.percentile(x, shares).alias("_e"))
    joined = df.join(edges, by, "left") if by else df.crossJoin(F.broadcast(edges))
    return joined.withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(x))) + 1).cast("int")).drop("_e")


def consecutive_pairs(df: DataFrame, keys: list[str], number: str, columns: list[str], suffix: str = "_prev") -> DataFrame:
    """Each row with ``columns`` of the row before it in its key's order, where that one's number is exactly one less."""
    pairs = lag_pairs(df, keys, [number], [number, *[c for c in columns if c != number]], 1, suffix)
    return pairs.where(F.col(number) == F.col(number + suffix) + 1)


def marked_not_last(df: DataFrame, keys: list[str], ts: str, tie: str, marked: Column) -> DataFrame:
    """(keys, n, n_marked, marked_is_last): whether a key's latest row by ``ts`` (NULL first), then ``tie``, is one that is marked; NULL without a marked one.

    A maximum over structs, combined before the shuffle.
    """
    mark = F.coalesce(marked, F.lit(False))
    last = F.max(F.struct(F.col(ts).alias("_1"), F.col(tie).alias("_2"), mark.alias("m")))["m"]
    n_marked = F.count_if(mark)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n_marked.alias("n_marked"), F.when(n_marked > 0, last).alias("marked_is_last"))


def greedy_windows(df: DataFrame, start: str, score: str, length: int, most: int, ascending: bool = False) -> DataFrame:
    """The best-scored windows [start, start + length) that don't overlap, at most ``most``, picked greedily; the best score is the largest, or the smallest if ``ascending``.

    A pick depends on those before it, so the top candidates are walked on the driver:
    at most ``most`` * (2 * length - 1) rows, as each pick rules out fewer than
    2 * length - 1 starts.
    """
    rows = df.select(start, score).orderBy(F.asc(score) if ascending else F.desc(score), F.asc(start)).limit(most * (2 * length - 1)).collect()
    picked: list[tuple] = []
    for r in rows:
        if len(picked) < most and all(abs(r[start] - s) >= length for s, _ in picked):
            picked.append((r[start], r[score]))
    return df.sparkSession.createDataFrame(picked, df.select(start, score).schema)


#: Up to so many rows in all are summed by a plain window.
FEW_ROWS = 20_000


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, str | Column], reverse: bool = False, before: bool = False, parts: int = 64) -> DataFrame:
    """``df`` with running sums along ``order`` (a number) within ``by``: up to and with the row's value, or with ``before`` without it; from the end with ``reverse``.

    The range of ``order`` is cut into ``parts`` at its approximate quantiles. A part is
    summed by itself and starts from the totals of the parts before it, which are one row
    a part and group: so no task holds a whole group, however many different values it has.
    A table of no more than ``FEW_ROWS``, which is counted, is summed in one piece.
    """
    edges, rows = df.agg(F.percentile_approx(F.col(order).cast("double"), [k / parts for k in range(1, parts)], 1000), F.count(F.lit(1))).first()
    edges = edges or []
    if rows <= FEW_ROWS:
        w = W.partitionBy(*by).orderBy(F.col(order).desc() if reverse else F.col(order).asc())
        upto = lambda c: F.coalesce(F.sum(c).over(w.rangeBetween(W.unboundedPreceding, 0)), F.lit(0))
        own = lambda c: F.coalesce(F.sum(c).over(W.partitionBy(*by, order)), F.lit(0)) if before else F.lit(0)
        made = df.select("*", *[((upto(c) - own(c)) if before else upto(c)).alias(f"_sum_{n}") for n, c in ((n, F.col(c) if isinstance(c, str) else c) for n, c in sums.items())])
        return made.select(*[c for c in df.columns if c not in sums], *[F.col(f"_sum_{n}").alias(n) for n in sums])
    cut = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    dealt = df.withColumns({f"_in_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()})
    dealt = dealt.withColumn("_part", F.size(F.filter(cut, lambda e: e < F.col(order))))
    along = F.col(order).desc() if reverse else F.col(order).asc()
    nth = F.col("_part").desc() if reverse else F.col("_part").asc()
    totals = dealt.groupBy(*by, "_part").agg(*[F.sum(f"_in_{n}").alias(f"_all_{n}") for n in sums])
    earlier = W.partitionBy(*by).orderBy(nth).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in sums])
    within = W.partitionBy(*by, "_part").orderBy(along).rangeBetween(W.unboundedPreceding, 0)
    same = W.partitionBy(*by, "_part", order)
    summed = dealt.withColumns({n: F.coalesce(F.sum(f"_in_{n}").over(within), F.lit(0)) - (F.coalesce(F.sum(f"_in_{n}").over(same), F.lit(0)) if before else F.lit(0)) for n in sums})
    keys = [summed[c].eqNullSafe(starts[c]) for c in (*by, "_part")]
    kept = [c for c in df.columns if c not in sums]
    return summed.join(starts, keys).select(*[summed[c] for c in kept], *[(summed[n] + starts[f"_start_{n}"]).alias(n) for n in sums])
