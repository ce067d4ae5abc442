"""Joins on time ranges: as-of, windows around probes, interval merging and overlap.

Where probes look into an ordered stream, both are put into one and read with a window
frame, which shuffles each side once and needs no candidate pairs. Where pairs
themselves are wanted, times are dealt into buckets as long as the window, so that the
join is an equi-join with a residual.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, from_micros, micros
from stroma.sources.tables import ship_package

#: Pairs that ``close_pairs`` holds at a time.
_PAIRS = 1 << 20


def asof(probes: DataFrame, stream: DataFrame, keys: list[str], ts: str, columns: list[str], tie: str, prefix: str = "asof_", strict: bool = True) -> DataFrame:
    """``probes`` with ``columns`` of the last ``stream`` row of the same keys before their time (at it, too, unless ``strict``).

    Of stream rows of one time the one of the largest ``tie`` counts. Probes without one
    stay, with NULLs; so do those of a null time.
    """
    payload = F.struct(F.col(ts).alias("_t"), F.col(tie).alias("_tie"), *[F.col(c).alias(c) for c in columns])
    left = probes.select(*keys, F.col(ts), F.struct(*probes.columns).alias("_row"), F.lit(None).cast(stream.select(payload).schema[0].dataType).alias("_s"))
    right = stream.select(*keys, F.col(ts), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_row"), payload.alias("_s"))
    both = left.unionByName(right)
    # at one time, a strict probe comes before the stream and another after it
    first = F.when(F.col("_row").isNotNull(), 0 if strict else 2).otherwise(1)
    w = W.partitionBy(*keys).orderBy(micros(F.col(ts)).asc_nulls_first(), first, F.col("_s._tie")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_s", ignorenulls=True).over(w)).where("_row is not null")
    return found.select("_row.*", *[F.when(F.col(f"_row.{ts}").isNotNull(), F.col(f"_f.{c}")).alias(prefix + c) for c in columns])


def forward_other(df: DataFrame, keys: list[str], ts: str, ident: str, out: str) -> DataFrame:
    """Each row with the earliest time strictly after its own of a row of another ``ident`` with the same keys.

    Of each time only matters whether it has one ident, and which. The next time serves
    a row unless it has the row's ident alone; then the next time that changes does.
    Frames look back along the reversed order, as those that look ahead to the end are
    computed anew for each row.
    """
    times = df.groupBy(*keys, ts).agg(F.min(ident).alias("_lo"), F.max(ident).alias("_hi"))
    times = times.withColumn("_one", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))
    back = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    changed = F.coalesce(F.col("_one") != F.lead("_one").over(back), F.lit(True))
    times = times.withColumn("_change", F.when(changed, F.col(ts)))
    times = times.withColumn("_after", F.last("_change", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
    times = times.select(*keys, ts, F.lag(ts).over(back).alias("_next"), F.lag("_one").over(back).alias("_next_one"), F.lag("_after").over(back).alias("_next_after"))
    joined = df.join(times, [*keys, ts], "left")
    return joined.withColumn(out, F.when(F.col("_next_one") == F.col(ident), F.col("_next_after")).otherwise(F.col("_next"))).drop("_next", "_next_one", "_next_after")


def range_count(probes: DataFrame, stream: DataFrame, keys: list[str], ts: str, lo: int, hi: int, out: str, value: str | None = None) -> DataFrame:
    """``probes`` with the number of ``stream`` rows of the same keys at times in [t + lo, t + hi], in microseconds; or with ``value``, their sum.

    Both sides are put into one ordered stream and read by a range frame, whose work grows
    with the rows of a window.
    """
    amount = F.col(value).cast("double") if value else F.lit(1).cast("long")
    kind = "double" if value else "long"
    left = probes.select(*keys, micros(F.col(ts)).alias("_us"), F.struct(*probes.columns).alias("_row"), F.lit(None).cast(kind).alias("_v"))
    right = stream.select(*keys, micros(F.col(ts)).alias("_us"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_row"), amount.alias("_v"))
    w = W.partitionBy(*keys).orderBy("_us").rangeBetween(lo, hi)
    counted = left.unionByName(right).withColumn("_n", F.sum("_v").over(w)).where("_row is not null")
    return counted.select("_row.*", F.coalesce("_n", F.lit(0).cast(kind)).alias(out))


def range_pairs(left: DataFrame, right: DataFrame, keys: list[str], lo: int, hi: int, left_ts: str, right_ts: str) -> DataFrame:
    """Pairs with equal keys and right_ts in [left_ts + lo, left_ts + hi], in microseconds. Column names of the sides differ but for the keys."""
    width = max(1, hi - lo)
    a = left.withColumn("_lo", micros(F.col(left_ts)) + lo).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_lo") + (hi - lo)) / width))))
    b = right.withColumn("_us", micros(F.col(right_ts))).withColumn("_b", F.floor(F.col("_us") / width))
    return a.join(b, [*keys, "_b"]).where((F.col("_us") >= F.col("_lo")) & (F.col("_us") <= F.col("_lo") + (hi - lo))).drop("_b", "_lo", "_us")


def close_pairs(df: DataFrame, key: str, who: str, ts: str, reach: int, groups: int = 12) -> DataFrame:
    """(a, b, n, mean) for each two whole numbers ``who``, a < b: how often rows of both with equal ``key`` lie within ``reach`` microseconds, and the mean seconds from a's to b's.

    Pairs of rows are never shuffled. ``who`` are dealt by hash into ``groups``, and each two groups, or one
    with itself, are a block with a task of its own: rows go to ``groups`` blocks, and all pairs of
    two ``who`` are made and summed in one. A task holds the rows of two groups and a bounded
    number of pairs. Rows with a null have none.
    """
    ship_package(df.sparkSession)
    kept = df.where(F.col(key).isNotNull() & F.col(who).isNotNull() & F.col(ts).isNotNull())
    own = kept.select(F.col(key).cast("string").alias("_k"), F.col(who).cast("long").alias("_who"), micros(F.col(ts)).alias("_us"), F.pmod(F.xxhash64(who), F.lit(groups)).cast("int").alias("_g"))
    dealt = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    low, high = F.least("_g", "_o"), F.greatest("_g", "_o")
    dealt = dealt.select("_k", "_who", "_us", (F.col("_g") == low).alias("_low"), (high * (high + 1) / 2 + low).cast("int").alias("_block"))
    inner = [g * (g + 1) // 2 + g for g in range(groups)]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not read:
            return
        rows = pa.Table.from_batches(read)
        code = np.concatenate([np.asarray(c.indices) for c in rows["_k"].dictionary_encode().unify_dictionaries().chunks])
        block, who_, us, low_ = (rows[c].to_numpy() for c in ("_block", "_who", "_us", "_low"))
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            yield from _pairs_of_block(code[at].astype(np.int64), who_[at], us[at], low_[at], b in inner, reach)

    return dealt.repartitionById(groups * (groups + 1) // 2, F.col("_block")).mapInArrow(pairs, "a long, b long, n long, mean double")


def _pairs_of_block(code: np.ndarray, who: np.ndarray, us: np.ndarray, low: np.ndarray, inner: bool, reach: int, most: int = _PAIRS) -> Iterator[pa.RecordBatch]:
    """Sums by pair over rows (code, who, us) of the ``low`` group and of the other, or of one with itself (``inner``); about ``most`` pairs at a time."""
    left = np.flatnonzero(low)
    right = left if inner else np.flatnonzero(~low)
    if not len(left) or not len(right):
        return
    # both by time, as searches in order are far quicker; the partners of a row lie side by side along (code, time)
    left, right = left[np.argsort(us[left], kind="stable")], right[np.argsort(us[right], kind="stable")]
    new = np.concatenate([[True], np.diff(us[right]) > 0])
    times, rank = us[right][new], np.cumsum(new) - 1
    along = code[right] * (len(times) + 1) + rank
    order = np.argsort(along, kind="stable")
    right, along = right[order], along[order]
    first = np.searchsorted(along, code[left] * (len(times) + 1) + np.searchsorted(times, us[left] - reach))
    until = np.searchsorted(along, code[left] * (len(times) + 1) + np.searchsorted(times, us[left] + reach, "right"))
    order = np.argsort(who[left], kind="stable")
    left, first, until = left[order], first[order], until[order]
    a_names, a = np.unique(who[left], return_inverse=True)
    b_names, b = np.unique(who[right], return_inverse=True)
    upto = np.concatenate([[0], np.cumsum(until - first)])
    at, held = 0, None  # what is summed so far of the last a, as its next rows may have pairs with the same b
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        count = until[at:to] - first[at:to]
        i = np.repeat(np.arange(at, to), count)
        j = np.arange(len(i)) - np.repeat(upto[at:to] - upto[at] - first[at:to], count)
        if inner:
            kept = b_names[b[j]] > a_names[a[i]]
            i, j = i[kept], j[kept]
        pair = a[i] * len(b_names) + b[j]
        n, seconds = np.ones(len(i), np.int64), (us[right[j]] - us[left[i]]) / 1e6
        if held is not None:
            pair, n, seconds = (np.concatenate(x) for x in zip(held, (pair, n, seconds)))
        at, held = to, None
        if not len(pair):
            continue
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, n, seconds = pair[starts], np.add.reduceat(n[order], starts), np.add.reduceat(seconds[order], starts)
        if at < len(left):
            cut = int(np.searchsorted(pair, a[at] * len(b_names)))
            held = pair[cut:], n[cut:], seconds[cut:]
            pair, n, seconds = pair[:cut], n[:cut], seconds[:cut]
        x, y = a_names[pair // len(b_names)], b_names[pair % len(b_names)]
        found = pa.record_batch([np.minimum(x, y), np.maximum(x, y), n, np.where(x < y, seconds, -seconds) / n], ["a", "b", "n", "mean"])
        for k in range(0, len(pair), 1 << 17):
            yield found.slice(k, 1 << 17)


def distinct_others(df: DataFrame, keys: list[str], ts: str, who: str, back: int, out: str) -> DataFrame:
    """Each row of ``df`` with how many other ``who`` have a row of the same keys in [t - back, t], in microseconds.

    No pairs are made. A row stands for its ``who`` from its time on, until ``back`` later or just before
    the next row of the same: at any time each counts once. These spans are dealt into the
    buckets of ``back`` that they touch, two at most, and a running sum of their begins and ends is
    read at each row. Rows of a null time or ``who`` have none.
    """
    kept = F.struct(*df.columns)
    us = micros(F.col(ts))
    known = df.where(us.isNotNull() & F.col(who).isNotNull()).select(*keys, F.col(who), us.alias("_s"))
    following = F.lead("_s").over(W.partitionBy(*keys, who).orderBy("_s"))
    spans = known.withColumn("_e", F.least(F.col("_s") + back + 1, following)).where("_e > _s")  # [_s, _e)
    first, last = (F.floor(c / back) for c in (F.col("_s"), F.col("_e") - 1))
    spans = spans.withColumn("_b", F.explode(F.array_distinct(F.array(first, last))))
    ends = F.array(F.struct(F.greatest(F.col("_s"), F.col("_b") * back).alias("_us"), F.lit(1).alias("_d")), F.struct(F.col("_e").alias("_us"), F.lit(-1).alias("_d")))
    kind = df.select(kept).schema[0].dataType
    steps = spans.select(*keys, "_b", F.explode(ends).alias("_x")).select(*keys, "_b", "_x._us", "_x._d", F.lit(None).cast(kind).alias("_row"))
    asked = df.select(*keys, F.floor(us / back).alias("_b"), us.alias("_us"), F.lit(0).alias("_d"), kept.alias("_row"))
    along = W.partitionBy(*keys, "_b").orderBy("_us", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    counted = asked.unionByName(steps).withColumn("_n", F.sum("_d").over(along)).where("_row is not null")
    own = F.when(F.col(f"_row.{ts}").isNotNull() & F.col(f"_row.{who}").isNotNull(), F.col("_n") - 1)  # the row's own is always among them
    return counted.select("_row.*", F.coalesce(own, F.lit(0)).cast("long").alias(out))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals (keys, start, end, n) that cover the same times; those that touch are one."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    numbered = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_g")


def overlaps(probes: DataFrame, blocks: DataFrame, keys: list[str], start: str, end: str, out: str = "overlaps") -> DataFrame:
    """``probes`` (keys, start, end, ...) and whether one of the disjoint ``blocks`` of the same keys overlaps them, both ends strict.

    As blocks are disjoint, the last that begins before a probe's end decides.
    """
    at_end = probes.withColumn("_end", F.col(end))
    asked = asof(at_end.withColumn("_t", F.col("_end")), blocks.select(*keys, F.col(start).alias("_t"), F.col(end).alias("_until")), keys, "_t", ["_until"], "_until", prefix="_asof")
    return asked.withColumn(out, F.coalesce(F.col("_asof_until") > F.col(start), F.lit(False))).drop("_t", "_end", "_asof_until")


def overlaps_anywhere(probes: DataFrame, blocks: DataFrame, keys: list[str], start: str, end: str, network: DataFrame, out: str = "overlaps") -> DataFrame:
    """``probes`` (keys, start, end, ...) and whether a block of their own keys, or one of ``network`` (start, end), which holds for all keys, overlaps them; both ends strict.

    Probes are compared with the network's blocks day by day: the last that begins before a
    probe's end decides, in the day of that end or, where there is none, in the days before, of which
    one small row a day is kept. So no task has all probes, as it would with one key for all.
    The network's own blocks, a few a day, are merged in one task.
    """
    whole = merge_intervals(network.withColumn("_all", F.lit(0)), ["_all"], start, end).select(F.col(start).alias("_ns"), F.col(end).alias("_ne"))
    dated = whole.withColumn("_day", F.col("_ns").cast("date"))
    last = dated.groupBy("_day").agg(F.max(F.struct("_ns", "_ne"))["_ne"].alias("_until"))
    ends = probes.select(F.col(end).cast("date").alias("_day")).distinct().join(last, "_day", "full").where("_day is not null")
    along = W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)  # one row a day
    carried = ends.select(F.col("_day").alias("_d"), F.last("_until", ignorenulls=True).over(along).alias("_before"))
    own = overlaps(probes, blocks, keys, start, end, "_own").withColumns({"_day": F.col(end).cast("date"), "_t": F.col(end)})
    seen = asof(own, dated.select("_day", F.col("_ns").alias("_t"), F.col("_ne").alias("_u")), ["_day"], "_t", ["_u"], "_u", prefix="_in")
    joined = seen.join(carried, F.col("_day") == F.col("_d"), "left")
    hit = F.col("_own") | F.coalesce(F.coalesce("_in_u", "_before") > F.col(start), F.lit(False))
    return joined.withColumn(out, hit).select(*probes.columns, out)


def active_windows(df: DataFrame, keys: list[str], start: str, end: str, minutes: int, tail: int = 0) -> DataFrame:
    """Distinct windows of ``minutes`` that [start, end] touches, from its floor to its ceiling and ``tail`` windows more."""
    step = minutes * 60 * MICROS
    first, last = micros(F.col(start)), micros(F.col(end))
    span = F.sequence(first - F.pmod(first, F.lit(step)), last + F.pmod(-last, F.lit(step)) + tail * step, F.lit(step))
    return df.select(*keys, F.explode(span).alias("_w")).distinct().select(*keys, from_micros(F.col("_w")).alias("window"))


def drop_close(df: DataFrame, keys: list[str], ts: str, before: Column, after: Column) -> DataFrame:
    """Rows with no *other* row of the same keys in [t - before, t + after] (microseconds), dropped ones included."""
    w = W.partitionBy(*keys).orderBy("_us")
    us = df.withColumn("_us", micros(F.col(ts)))
    gaps = us.withColumn("_p", F.col("_us") - F.lag("_us").over(w)).withColumn("_n", F.lead("_us").over(w) - F.col("_us"))
    alone = F.coalesce(F.col("_p") > before, F.lit(True)) & F.coalesce(F.col("_n") > after, F.lit(True))
    return gaps.where(alone).drop("_us", "_p", "_n")
