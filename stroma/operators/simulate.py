"""A stochastic rollout of vehicles along their stops, minute by minute, and effects of scenarios.

Vehicles of one day and run depend on each other, so a day with a few runs is one group
of ``applyInPandas``; days and runs are what scales out. Uniform draws are hashes of seed, run,
vehicle and position, hence the same in every scenario.
"""

import bisect
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stroma.operators.ordered import lag_pairs
from stroma.operators.ranges import asof
from stroma.sources.tables import ship_package

LOW, HIGH = -3, 15
#: Runs of one group: a day's stops are sent once for so many.
RUNS = 8
#: Rows of the result that a task gives at a time.
CHUNK = 20_000
#: Bin edges of a vehicle's own delay and of its predecessor's, in minutes.
EDGES = [0, 3, 6, 12, 24]


def bin_of(delay: Column) -> Column:
    return sum(((delay >= e).cast("int") for e in EDGES), F.lit(0))


def transitions(stops: DataFrame) -> DataFrame:
    """Training rows from ``stops`` (day, vehicle, pos, place, sched, delay, cancelled): own bin, predecessor's bin, class of the next change, next cancelled.

    The predecessor is the last vehicle that arrived at the next place strictly before this
    one's arrival here, so nothing is seen that wasn't known then. A null predecessor is
    bin -1. The class is the change in whole minutes, clipped.
    """
    real = (F.col("sched") + F.make_dt_interval(mins=F.rint("delay").cast("int"))).alias("real")
    rows = stops.select("day", "vehicle", "pos", "place", "sched", "delay", "cancelled", real)
    steps = lag_pairs(rows, ["day", "vehicle"], ["pos"], ["pos", "delay", "cancelled", "real"]).where("not cancelled_prev")
    probes = steps.select("day", "place", F.col("real_prev").alias("at"), "vehicle", "pos", "delay", "delay_prev", "cancelled")
    known = rows.where("not cancelled").select("day", "place", F.col("real").alias("at"), F.col("delay").alias("d"), "vehicle")
    seen = asof(probes, known, ["day", "place"], "at", ["d"], "vehicle")
    change = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.rint(F.col("delay") - F.col("delay_prev")))).cast("int")
    return seen.select("day", "vehicle", "pos", bin_of(F.col("delay_prev")).alias("own"), F.coalesce(bin_of(F.col("asof_d")), F.lit(-1)).alias("before"), F.when(~F.col("cancelled"), change).alias("change"), "cancelled")


def learn(rows: DataFrame, alpha: float = 5.0) -> DataFrame:
    """(own, before, change, p): smoothed shares of the classes in each group, (count + alpha * global) / (n + alpha); change NULL stands for a cancellation."""
    counts = rows.groupBy("own", "before", "change").agg(F.count(F.lit(1)).alias("c"))
    groups = counts.groupBy("own", "before").agg(F.sum("c").alias("n"))
    overall = counts.groupBy("change").agg(F.sum("c").alias("t"))
    total = counts.agg(F.sum("c").alias("all"))
    grid = groups.crossJoin(F.broadcast(overall)).crossJoin(F.broadcast(total))  # groups times classes
    same = ["own", "before"]
    keyed = counts.select(*same, F.coalesce("change", F.lit(99)).alias("_k"), "c")
    out = grid.withColumn("_k", F.coalesce("change", F.lit(99))).join(keyed, [*same, "_k"], "left")
    return out.select(*same, "change", ((F.coalesce("c", F.lit(0)) + alpha * F.col("t") / F.col("all")) / (F.col("n") + alpha)).alias("p"))


@dataclass(frozen=True)
class Scenario:
    """``kind``: none; delay (vehicle, pos, minutes); cancel (vehicle, from pos); closure (place, first and last minute, least minutes between vehicles after it)."""

    kind: str = "none"
    vehicle: int | None = None
    pos: int = 0
    minutes: float = 0.0
    place: str | None = None
    first: int = 0
    last: int = 0
    apart: int = 2


def _uniform(*key) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / 2**56


@dataclass
class Paths:
    """The stops of a day's vehicles, one vehicle after another in order: columns, read by all runs. A vehicle has the stops from ``first`` of it to before the next one's."""

    vehicle: np.ndarray
    first: np.ndarray
    pos: np.ndarray
    minute: np.ndarray
    place: np.ndarray
    delay: np.ndarray
    places: list


def _paths(columns: dict[str, np.ndarray], places: list) -> Paths:
    order = np.lexsort((columns["pos"], columns["vehicle"]))
    c = {k: x[order] for k, x in columns.items()}
    first = np.flatnonzero(np.r_[True, c["vehicle"][1:] != c["vehicle"][:-1]]) if len(order) else np.zeros(0, np.int64)
    return Paths(c["vehicle"][first], np.r_[first, len(order)], c["pos"], c["minute"], c["place"], c["delay"], places)


def _rollout(paths: Paths, run: int, seed: int, law: dict, scenario: Scenario):
    """Yields (pos, vehicle, minute, delay, cancelled) as they happen; what it holds is a stop a vehicle."""
    last: dict[int, float] = {}  # delay of the last vehicle at a place
    free: dict[int, int] = {}  # when a closed place takes the next vehicle
    due = []
    bins = lambda d: -1 if d is None else sum(d >= e for e in EDGES)
    vehicles, first = paths.vehicle.tolist(), paths.first.tolist()
    pos, minute, place = paths.pos, paths.minute, paths.place
    for i, v in enumerate(vehicles):
        begin, sched = float(paths.delay[first[i]]), int(minute[first[i]])
        delay = begin if begin == begin else 0.0
        if scenario.kind == "delay" and scenario.vehicle == v and scenario.pos == 0:
            delay += scenario.minutes
        heapq.heappush(due, (sched + round(delay), sched, v, first[i], delay, i))
    while due:
        now, arrived = due[0][0], []
        while due and due[0][0] == now:
            arrived.append(heapq.heappop(due))
        for _, sched, v, k, delay, i in arrived:  # all see the state before this minute
            yield int(pos[k]), v, now, delay, False
            if k + 1 >= first[i + 1]:
                continue
            there, p, planned = int(place[k + 1]), int(pos[k + 1]), int(minute[k + 1])
            classes, cdf = law.get((bins(delay), bins(last.get(there))), law[None])
            gone = scenario.kind == "cancel" and scenario.vehicle == v and p >= scenario.pos
            change = classes[min(bisect.bisect_right(cdf, _uniform(seed, run, v, p)), len(classes) - 1)]
            if gone or change is None:
                for q in pos[k + 1 : first[i + 1]].tolist():
                    yield q, v, None, None, True
                continue
            following = delay + change + (scenario.minutes if scenario.kind == "delay" and scenario.vehicle == v and scenario.pos == p else 0)
            at = max(planned + round(following), now + 1)
            if scenario.kind == "closure" and paths.places[there] == scenario.place and at >= scenario.first and (at < scenario.last or at < free.get(there, 0)):
                at = max(scenario.last, free.get(there, 0))
                free[there] = at + scenario.apart
            heapq.heappush(due, (at, planned, v, k + 1, float(at - planned), i))
        for _, sched, v, k, delay, i in sorted(arrived, key=lambda a: (a[1], a[2])):
            last[int(place[k])] = delay


def simulate(stops: DataFrame, law: DataFrame, runs: int, seed: int, scenario: Scenario = Scenario()) -> DataFrame:
    """(day, run, vehicle, pos, arrival, delay, cancelled) of every stop in every run; arrivals in minutes of the day.

    ``stops`` has day, vehicle, pos, place, sched, delay; the first position's delay starts the
    vehicle. ``law`` is what ``learn`` returns: groups times classes, bounded by the bins.
    """
    ship_package(stops.sparkSession)
    table: dict = {}
    rows = law.collect()
    if len(rows) > 10_000:
        raise ValueError("the transition law is larger than its bins allow")
    overall: dict = {}
    for r in rows:
        table.setdefault((r["own"], r["before"]), []).append((r["change"], r["p"]))
        overall[r["change"]] = overall.get(r["change"], 0.0) + r["p"]
    table[None] = list(overall.items()) or [(0, 1.0)]
    ready = {}
    for key, items in table.items():
        items = sorted(items, key=lambda x: (x[0] is not None, x[0] or 0))
        p = np.array([x for _, x in items])
        ready[key] = ([c for c, _ in items], np.cumsum(p / p.sum()).tolist())
    minute = (F.hour("sched") * 60 + F.minute("sched")).alias("minute")
    each = stops.select("day", "vehicle", "pos", "place", minute, F.col("delay").cast("double").alias("delay"), F.explode(F.sequence(F.lit(0), F.lit((runs - 1) // RUNS))).alias("_runs"))
    kinds = dict(each.dtypes)

    out = ["day", "run", "vehicle", "pos", "arrival", "delay", "cancelled"]

    def one(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict = {}
        parts: dict[str, list] = {"vehicle": [], "pos": [], "minute": [], "place": [], "delay": []}
        for b in batches:  # kept as plain columns, places as numbers
            parts["place"].append(np.array([codes.setdefault(None if x != x else x, len(codes)) for x in b["place"]], np.int32))
            parts["vehicle"].append(b["vehicle"].to_numpy())
            parts["delay"].append(b["delay"].to_numpy(np.float64))
            for c in ("pos", "minute"):
                parts[c].append(b[c].to_numpy(np.int32))
        paths = _paths({c: np.concatenate(parts.pop(c)) for c in list(parts)}, list(codes))
        for run in range(int(key[1]) * RUNS, min(runs, int(key[1] + 1) * RUNS)):
            found = ((key[0], run, v, p, a, d, c) for p, v, a, d, c in _rollout(paths, run, seed, ready, scenario))
            while chunk := list(islice(found, CHUNK)):
                yield pd.DataFrame(chunk, columns=out).astype({"arrival": "Int64"})

    return each.groupBy("day", "_runs").applyInPandas(one, f"day {kinds['day']}, run int, vehicle {kinds['vehicle']}, pos int, arrival long, delay double, cancelled boolean")


def effects(base: DataFrame, changed: DataFrame, without: int | None = None, block: int = 10) -> DataFrame:
    """(block, n, mean, se, affected): differences of delay between two runs with the same draws, by block of minutes; only stops that both reach, of other vehicles than ``without``."""
    key = ["day", "run", "vehicle", "pos"]
    a = base.where("not cancelled").select(*key, F.col("delay").alias("_a"), F.col("arrival").alias("_t"))
    b = changed.where("not cancelled").select(*key, F.col("delay").alias("_b"))
    both = a.join(b, key)
    if without is not None:
        both = both.where(F.col("vehicle") != without)
    d = F.col("_b") - F.col("_a")
    return both.groupBy(F.floor(F.col("_t") / block).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count_if(F.abs(d) >= 1).alias("affected"))


def decay_minutes(blocks: DataFrame, by: list[str], block: str, mean: str, se: str, width: int, small: float = 0.1, z: float = 1.96) -> DataFrame:
    """(by, minutes): from when on an effect is over: the first block from which every block's interval holds zero or its mean is below ``small``; NULL if the last one doesn't."""
    over = (F.abs(mean) < small) | (F.abs(mean) <= z * F.coalesce(F.col(se), F.lit(0.0)))
    lasting = blocks.groupBy(*by).agg(F.max(F.when(~over, F.col(block))).alias("_last"), F.min(block).alias("_first"), F.max(block).alias("_end"))
    return lasting.select(*by, F.when(F.col("_last").isNull(), F.lit(0)).when(F.col("_last") < F.col("_end"), (F.col("_last") + 1 - F.col("_first")) * width).cast("long").alias("minutes"))


def result_table(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, runs, cancelled_share, q05, q50, q95) over the runs of each stop."""
    q = lambda p: F.percentile(value, p)
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("cancelled").cast("double")).alias("cancelled_share"), q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95"))
