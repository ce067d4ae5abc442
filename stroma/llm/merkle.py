"""Merkle manifest of a table: digests of rows in trees of fixed fan-out, one tree a group, and one over the trees' roots.

The nodes lie in a store of Parquet files, a folder a level. Leaves are sorted into runs
along (tree, key) and numbered; a pass then reads one level in order, in stretches of
``FANOUT ** LEVELS`` nodes, writes the ``LEVELS`` levels above it, and the next pass reads
the highest of these. A stretch is all that a task holds of a tree, however large that is.
Proofs come from a scan of the same stretches, in which the nodes above a leaf precede it:
first of the highest levels, whose paths are handed down to the stretches below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import materialise, number_rows, ship_package

FANOUT = 8
#: Levels that one pass adds; a stretch has FANOUT ** LEVELS nodes of the pass's lowest level (4,096: about 0.6 MB of digests).
LEVELS = 4
#: Columns of ``documents`` that a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, level int, index long, digest string, n long"
_PROOF = "doc_id long, tree string, digest string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' number, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns.values()]), 256)


def tree_name(group: Column) -> Column:
    """A name for each group, null among them, that sorts null first, then by UTF-8 bytes."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


@dataclass
class Manifest:
    """``leaves`` (tree, index, digest, doc_id, claimed, n), ``stores`` and ``bases`` (nodes of the trees, a table a pass, and its lowest level),
    ``top_stores`` and ``top_bases`` (nodes over the trees' roots), ``roots`` (tree, subroot, index), ``root`` (None if there is no row)."""

    leaves: DataFrame
    stores: list[DataFrame]
    bases: list[int]
    top_stores: list[DataFrame]
    roots: DataFrame
    root: str | None
    fanout: int
    levels: int


def _stretches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``rows`` with ``stretch`` (``index`` over ``size``), those of one stretch in one task, in order."""
    return rows.withColumn("stretch", F.floor(F.col("index") / size).cast("long")).repartition("tree", "stretch").sortWithinPartitions("tree", "stretch", *order)


def _runs(batches, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _grow(nodes: DataFrame, base: int, fanout: int, levels: int) -> DataFrame:
    """Levels ``base`` + 1 to ``base`` + ``levels`` over the nodes of level ``base``: (tree, level, index, digest, n), n being the level's nodes of that tree.

    A tree ends at the level where one node is left.
    """

    def finish(tree, stretch, n, run):
        at, first = base, stretch * fanout**levels
        while n > 1 and at < base + levels:
            run = [digest("".join(run[k : k + fanout])) for k in range(0, len(run), fanout)]
            at, first, n = at + 1, first // fanout, -(-n // fanout)
            for k, d in enumerate(run):
                yield tree, at, first + k, d, n

    def out(rows):
        return pa.RecordBatch.from_pydict(dict(zip(("tree", "level", "index", "digest", "n"), zip(*rows, strict=True), strict=True)), pa.schema([("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]))

    def run(batches):
        key, held, made = None, [], []
        for tree, stretch, n, d in _runs(batches, "tree", "stretch", "n", "digest"):
            if (tree, stretch, n) != key:
                if key:
                    made += finish(*key, held)
                    if len(made) > 20_000:
                        yield out(made)
                        made = []
                key, held = (tree, stretch, n), []
            held.append(d)
        if key:
            made += finish(*key, held)
        if made:
            yield out(made)

    return _stretches(nodes.select("tree", "index", "digest", "n"), fanout**levels, "index").select("tree", "stretch", "n", "digest").mapInArrow(run, _NODE)


def _forest(leaves: DataFrame, fanout: int, levels: int, name: str) -> tuple[list[DataFrame], list[int], DataFrame]:
    """All levels above ``leaves`` (tree, index, digest, n), a table a pass; and (tree, digest) of what remains of each tree."""
    stores, bases, done, nodes, base = [], [], [], leaves.select("tree", "index", "digest", "n"), 0
    while True:
        done.append(nodes.where("n = 1").select("tree", "digest"))
        store = materialise(_grow(nodes.where("n > 1"), base, fanout, levels), f"{name}-nodes-{base}", by=["level"])
        if store.isEmpty():
            break
        stores.append(store)
        bases.append(base)
        done.append(store.where((F.col("n") == 1) & (F.col("level") < base + levels)).select("tree", "digest"))
        base += levels
        nodes = store.where(F.col("level") == base)
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return stores, bases, roots


def build(docs: DataFrame, group: str = "lang", columns: tuple[str, ...] = COLUMNS, claimed: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of every row of ``docs`` (doc_id, ``columns``, ...): a leaf a row, a tree for each value of ``group``.

    A leaf is the SHA-256 of ``columns``, each ``-`` if null, else its length in bytes, a
    colon and itself. A tree's leaves ascend by doc_id (null first), rows of one doc_id by
    their digests; ``fanout`` neighbours are concatenated as hexadecimal text and hashed,
    level by level, the last ones of a level even if they are fewer or one, until one node is
    left: a single row's leaf is its tree's root. The trees' roots, null group first, then
    by UTF-8 bytes, are the leaves of the tree that gives the root. No rows: no root.

    ``claimed`` gives expressions for columns as they are to be checked; ``claimed`` of a
    leaf is the digest with these in place of the columns. Texts are read once and not
    shuffled; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    stored = {c: F.col(f"`{c}`") for c in columns}
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree_name(F.col(f"`{group}`")).alias("tree"), leaf(stored).alias("digest"), leaf(stored | (claimed or {})).alias("claimed"))
    leaves = number_rows(materialise(slim, "merkle-leaves"), ["tree"], ["doc_id", "digest"], "index", name="merkle-runs").withColumnRenamed("_group_rows", "n")
    stores, bases, roots = _forest(leaves, fanout, levels, "merkle")
    roots = number_rows(materialise(roots, "merkle-roots"), [], ["tree"], "index", name="merkle-root-runs").withColumnRenamed("_group_rows", "n")
    top = roots.select(F.lit("").alias("tree"), "index", "digest", "n")
    top_stores, _, last = _forest(top, fanout, levels, "merkle-top")
    found = last.first()
    return Manifest(leaves, stores, bases, top_stores, roots.withColumnRenamed("digest", "subroot"), found["digest"] if found else None, fanout, levels)


def _paths(nodes: DataFrame, store: DataFrame | None, base: int, above: DataFrame, fanout: int, levels: int, out: str, emit) -> DataFrame:
    """``emit(tree, row, path)`` for each of ``nodes`` (tree, index, digest, row: struct), the nodes of level ``base``.

    ``path`` has for each level up to the root what stands before and after the node's
    ancestor in its run of siblings. ``above`` (tree, stretch, path) has the part above
    the stretch. A task holds of a stretch the nodes above level ``base``, and of that
    level one run of siblings.
    """
    size = fanout**levels
    row_type = nodes.schema["row"].dataType.simpleString()
    low = nodes.select("tree", F.floor(F.col("index") / size).cast("long").alias("stretch"), F.lit(base).alias("level"), "index", "digest", F.lit(None).cast("array<string>").alias("path"), "row")
    rows = above.select("tree", "stretch", F.lit(1 << 20).alias("level"), F.lit(0).cast("long").alias("index"), F.lit(None).cast("string").alias("digest"), "path", F.lit(None).cast(row_type).alias("row")).unionByName(low)
    if store is not None:
        over = store.where((F.col("level") < base + levels) & (F.col("n") > 1))
        stretch = F.floor(F.col("index") / F.pow(F.lit(fanout), base + levels - F.col("level"))).cast("long")
        rows = rows.unionByName(over.select("tree", stretch.alias("stretch"), "level", "index", "digest", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast(row_type).alias("row")))
    ordered = rows.repartition("tree", "stretch").sortWithinPartitions("tree", "stretch", F.desc("level"), "index")

    def run(batches):
        key, upper, known, found, made = None, None, {}, {}, []

        def parents(level, index):
            """The path of the node from ``level`` on, remembered for its siblings' children."""
            if (level, index) not in found:
                run_at = index // fanout
                siblings = known.get(level)
                if siblings is None:
                    return upper
                first = run_at * fanout - siblings[0]
                run = siblings[1][first : first + fanout]
                at = index % fanout
                found[level, index] = ("".join(run[:at]), "".join(run[at + 1 :]), *parents(level + 1, run_at))
            return found[level, index]

        def finish(run):
            if not run:
                return
            digests = [d for _, d, _ in run]
            whole = parents(base + 1, run[0][0] // fanout)
            for k, (_, _, row) in enumerate(run):
                # a tree of one node has no level of siblings
                mine = upper if alone else ("".join(digests[:k]), "".join(digests[k + 1 :]), *whole)
                made.append(emit(tree_now, row, mine))

        siblings, tree_now, alone = [], None, False
        for tree, stretch, level, index, d, path, row in _runs(batches, "tree", "stretch", "level", "index", "digest", "path", "row"):
            if (tree, stretch) != key:
                finish(siblings)
                key, upper, known, found, siblings, tree_now = (tree, stretch), tuple(path), {}, {}, [], tree
            elif level > base:
                known.setdefault(level, (index, []))[1].append(d)
            else:
                if siblings and siblings[0][0] // fanout != index // fanout:
                    finish(siblings)
                    siblings = []
                alone = row["n"] == 1
                siblings.append((index, d, row))
            if len(made) >= 2_000:
                yield pa.RecordBatch.from_pylist(made, SCHEMAS[out])
                made = []
        finish(siblings)
        if made:
            yield pa.RecordBatch.from_pylist(made, SCHEMAS[out])

    return ordered.select("tree", "stretch", "level", "index", "digest", "path", "row").mapInArrow(run, out)


_PATH = "tree string, stretch long, path array<string>"
SCHEMAS = {
    _PATH: pa.schema([("tree", pa.string()), ("stretch", pa.int64()), ("path", pa.list_(pa.string()))]),
    _PROOF: pa.schema([(k, pa.int64() if k == "doc_id" else pa.list_(pa.string()) if k == "proof" else pa.string()) for k in ("doc_id", "tree", "digest", "subroot", "root", "proof", "proof_sha256", "folded_root")]),
}


def _descend(leaves: DataFrame, stores: list[DataFrame], tops: DataFrame | None, fanout: int, levels: int) -> DataFrame:
    """(tree, stretch, path) for all stretches of the trees' lowest level, from ``tops`` (tree, path), the paths above the trees' roots; none if there is nothing above.

    Trees differ in height: each begins in the pass in which it fits one stretch.
    """
    size, above = fanout**levels, None
    for k in reversed(range(len(stores) + 1)):
        base = k * levels
        level = leaves if k == 0 else stores[k - 1].where(F.col("level") == base)
        fits = level.where((F.col("n") <= size) & (F.col("index") == 0) & ((F.col("n") > 1) | F.lit(k == 0))).select("tree", F.lit(0).cast("long").alias("stretch"))
        begun = fits.join(tops, "tree").select("tree", "stretch", "path") if tops else fits.withColumn("path", F.array().cast("array<string>"))
        above = begun if above is None else begun.unionByName(above)
        if k == 0:
            return above
        nodes = level.where("n > 1").select("tree", "index", "digest", F.struct("n", "index").alias("row"))
        store = stores[k] if k < len(stores) else None
        above = materialise(_paths(nodes, store, base, above, fanout, levels, _PATH, lambda tree, row, path: {"tree": tree, "stretch": row["index"], "path": list(path)}), "merkle-paths")
    return above


def prove(manifest: Manifest, siblings: bool = True) -> DataFrame:
    """(doc_id, tree, digest, subroot, root, proof, proof_sha256, folded_root) for every leaf.

    ``proof`` has for each level, up to the root, the digests before and those after the
    leaf's ancestor in its run of siblings, each concatenated (null without ``siblings``);
    ``proof_sha256`` is the digest of all of them; ``folded_root`` follows from the leaf's
    ``claimed`` digest and the proof alone. A leaf is verified if that is the root.
    """
    fanout, levels = manifest.fanout, manifest.levels
    roots = manifest.roots
    top = roots.select(F.lit("").alias("tree"), "index", F.col("subroot").alias("digest"), "n", F.col("tree").alias("of"))
    over = _descend(top, manifest.top_stores, None, fanout, levels)
    low = top.select("tree", "index", "digest", F.struct("n", "of", "digest").alias("row"))
    # the tree's own root rides at the end of its path
    tops = _paths(low, manifest.top_stores[0] if manifest.top_stores else None, 0, over, fanout, levels, _PATH, lambda tree, row, path: {"tree": row["of"], "stretch": 0, "path": [*path, row["digest"]]})
    tops = materialise(tops.select("tree", "path"), "merkle-top-paths")
    above = _descend(manifest.leaves, manifest.stores, tops, fanout, levels)
    rows = manifest.leaves.select("tree", "index", "digest", F.struct("n", "doc_id", "digest", "claimed").alias("row"))
    root = manifest.root

    def emit(tree, row, path):
        *path, subroot = path
        held = row["claimed"]
        for k in range(0, len(path), 2):
            held = digest(path[k] + held + path[k + 1])
        return {"doc_id": row["doc_id"], "tree": tree, "digest": row["digest"], "subroot": subroot, "root": root, "proof": path if siblings else None, "proof_sha256": digest("".join(path)), "folded_root": held}

    return _paths(rows, manifest.stores[0] if manifest.stores else None, 0, above, fanout, levels, _PROOF, emit)
