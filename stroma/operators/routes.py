"""The order of places along a route, from many trips that each visit some of them."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stroma.functions.numbers import haversine
from stroma.sources.tables import materialise, ship_package


def longest_run(ranks: list[int]) -> int:
    """Length of the longest strictly increasing subsequence."""
    tops: list[int] = []
    for r in ranks:
        at = bisect_left(tops, r)
        tops[at : at + 1] = [r]
    return len(tops)


def trip_orders(visits: DataFrame, trip: list[str], place: str, order: list[str]) -> DataFrame:
    """(trip, places): the distinct places of each trip in the order of their first visit. A trip is one row, so it should be of bounded length."""
    first = visits.where(F.col(place).isNotNull()).groupBy(*trip, place).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(*trip).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", place))), lambda x: x[place]).alias("places"))


def anchor_trip(trips: DataFrame, trip: list[str]) -> list:
    """The places of the trip that visits most, of several the first by its keys: one row."""
    found = trips.select(F.struct((-F.size("places")).alias("n"), *trip).alias("k"), "places").agg(F.min_by("places", "k").alias("p")).first()
    return list(found["p"]) if found and found["p"] else []


def agreement(trips: DataFrame, trip: list[str], anchor: list) -> DataFrame:
    """(trip, shared, forward, backward): how many places a trip shares with the anchor, and the longest part of them in the anchor's order, and against it."""
    ship_package(trips.sparkSession)
    ranks = F.filter(F.transform("places", lambda p: F.array_position(F.array(*[F.lit(a) for a in anchor]), p)), lambda r: r > 0)

    @F.pandas_udf("struct<forward:int,backward:int>")
    def runs(column: pd.Series) -> pd.DataFrame:
        lists = [[int(r) for r in x] for x in column]
        return pd.DataFrame({"forward": [longest_run(x) for x in lists], "backward": [longest_run(x[::-1]) for x in lists]})

    asked = trips.select(*trip, ranks.alias("_r"))
    return asked.select(*trip, F.size("_r").cast("long").alias("shared"), runs("_r").alias("_l")).select(*trip, "shared", F.col("_l.forward").alias("forward"), F.col("_l.backward").alias("backward"))


#: A route has at most so many places.
MAX_PLACES = 2_000


def topological(votes: list[tuple], anchor: list, places: list) -> list:
    """Places so that, of each two, the one that more votes (a, b, n: a before b) put first comes first, as far as the majorities have no cycle.

    Next is always a place that the fewest of those left precede, of several the one that
    precedes most of those left, then the first in the anchor, then by name.
    """
    n = {(a, b): k for a, b, k in votes}
    after: dict = {p: set() for p in places}
    before: dict = {p: set() for p in places}
    for (a, b), k in n.items():
        if k > n.get((b, a), 0):
            after[a].add(b)
            before[b].add(a)
    at, left, out = {p: k for k, p in enumerate(anchor)}, set(places), []
    preceded, precedes = {p: len(before[p]) for p in places}, {p: len(after[p]) for p in places}
    while left:
        p = min(left, key=lambda x: (preceded[x], -precedes[x], at.get(x, len(at)), x))
        out.append(p)
        left.remove(p)
        for q in after[p]:
            preceded[q] -= 1
        for q in before[p]:
            precedes[q] -= 1
    return out


def route_order(visits: DataFrame, trip: list[str], place: str, order: list[str]) -> DataFrame:
    """(place, position, anchor_rank, trips, before, agreed): places in the order that the trips agree on.

    Trips that go against the anchor, the trip with most places, are turned round. Of each two
    places that a trip visits, the order is a vote, counted by Spark; the places are put
    into a topological order of the majorities, so that those outside the anchor get their
    place as well. ``before`` is how many places one precedes by majority; ``agreed`` the
    share of votes on a place's pairs that go with the order. The driver gets a row for
    each pair of places; more than ``MAX_PLACES`` places raise.
    """
    trips = materialise(trip_orders(visits, trip, place, order), "route-trips")
    anchor = anchor_trip(trips, trip)
    if not anchor:
        kind = dict(visits.dtypes)[place]
        return visits.sparkSession.createDataFrame([], f"`{place}` {kind}, position int, anchor_rank int, trips long, before long, agreed double")
    turned = trips.join(agreement(trips, trip, anchor), trip).select(F.when(F.col("backward") > F.col("forward"), F.reverse("places")).otherwise(F.col("places")).alias("_p"))
    pairs = turned.select(F.explode(F.flatten(F.transform("_p", lambda a, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("v"))
    votes = materialise(pairs.groupBy("v.a", "v.b").agg(F.count(F.lit(1)).alias("n")), "route-votes")  # places squared
    other = votes.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    both = votes.join(other, ["a", "b"], "full").na.fill(0, ["n", "m"])
    wins = both.groupBy("a").agg(F.count_if(F.col("n") > F.col("m")).alias("before"))
    seen = turned.select(F.explode("_p").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("trips"))
    rank = F.array_position(F.array(*[F.lit(p) for p in anchor]), F.col("a"))
    scored = seen.join(wins, "a", "left").select("a", "trips", F.coalesce("before", F.lit(0)).alias("before"), F.when(rank > 0, rank).cast("int").alias("anchor_rank"))
    many = scored.count()
    if many > MAX_PLACES:
        raise ValueError(f"{many} places: a route has at most {MAX_PLACES}")
    order_ = topological([tuple(r) for r in votes.collect()], anchor, [r["a"] for r in scored.select("a").collect()])
    placed = visits.sparkSession.createDataFrame([(p, k) for k, p in enumerate(order_, 1)], f"a {dict(visits.dtypes)[place]}, position int")
    pos = placed.withColumnsRenamed({"a": "b", "position": "_pb"})
    kept = both.join(placed, "a").join(pos, "b").groupBy("a").agg(F.try_divide(F.sum(F.when(F.col("position") < F.col("_pb"), F.col("n")).otherwise(F.col("m"))), F.sum(F.col("n") + F.col("m"))).alias("agreed"))
    return scored.join(placed, "a").join(kept, "a", "left").select(F.col("a").alias(place), "position", "anchor_rank", "trips", "before", "agreed")


def distance_level(lat: Column, lon: Column, known_lat: Column, known_lon: Column, near: float = 150.0, far: float = 400.0) -> Column:
    """``high``, ``middle`` or ``low`` confidence by the metres between a place and where it is said to be; ``unproven`` if that isn't known."""
    d = haversine(lat, lon, known_lat, known_lon)
    return F.when(d.isNull(), "unproven").when(d < near, "high").when(d < far, "middle").otherwise("low")
