"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.sources.tables import discard, materialise, ship_package

#: Up to so many distinct edges (16 bytes each) are contracted in one task.
FEW_EDGES = 100_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all edges at once: each node with its component's smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(*[c.to_pylist() for c in batch.columns]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        yield pa.RecordBatch.from_pydict({"node": pa.array(list(parent), pa.int64()), "component": pa.array([root(x) for x in parent], pa.int64())})


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is its smallest node.

    Up to ``FEW_EDGES`` distinct edges between whole numbers are contracted by one task.
    Of more, each round points every node at the smallest of itself and its neighbours, and
    replaces the edges' ends by what they point at. Edges within one target vanish; a
    star is gone after one round. From the third round on pointers are followed, each
    round twice as far as the one before, so that a path of n nodes in order, which a
    round would else shorten by one, is gone after about sqrt(2 log n) rounds more. The minimum is
    combined before the shuffle, so a node with very many neighbours costs one row a
    task. Each round is written to the shared folder, and deleted when the next one is.

    Edges that become equal are kept: they cost a row each in the next round, where making
    them distinct would cost a shuffle a round. Edges with a null end are left out. Raises if ``max_rounds`` rounds don't do.
    """
    edges = materialise(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), f"{name}-edges")
    kinds = {t for _, t in edges.dtypes}
    if kinds <= {"bigint", "int"} and edges.count() <= FEW_EDGES:
        ship_package(edges.sparkSession)
        kind = dict(edges.dtypes)["a"]
        found = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).repartition(1).mapInArrow(_contracted, "node long, component long")
        return materialise(found.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component")), f"{name}-labels")
    labels = None
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        target = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component"))
        target = materialise(target, f"{name}-round{turn}")
        for jump in range(turn - 1):
            further = target.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            jumped = materialise(target.join(further, "component").select("node", F.col("_next").alias("component")), f"{name}-jump{turn}-{jump}")
            discard(target)
            target = jumped
        step = target.where("node <> component").select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        if labels is None:
            labels = target
        else:
            moved = labels.join(step, labels["component"] == step["_n"], "left").select("node", F.coalesce("_c", "component").alias("component"))
            moved = materialise(moved, f"{name}-labels{turn}")
            discard(labels)
            labels = moved
        before = edges
        edges = edges.join(target.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a").join(target.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b")
        edges = materialise(edges.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")), f"{name}-edges{turn}")
        discard(before)
        if target is not labels:
            discard(target)
    else:
        raise RuntimeError(f"{name}: still not contracted after {max_rounds} rounds")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
