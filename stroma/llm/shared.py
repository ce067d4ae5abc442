"""Helpers that several corpus operators share: materialised tables, gapless ranks,
byte-level tokenising of Arrow text columns."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.sources.tables import materialise, shared_folder, ship_package

__all__ = ["materialise", "shared_folder", "ship_package"]

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo ``modulus``: the folds of the learned operators."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_part: int = 100_000, deal=None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without one task per group.

    Each group is dealt into parts by ``deal``, a function from their number to a column,
    or else a hash of the order columns; a part is ranked by itself and starts where the
    parts before it end. The parts' sizes are
    one small row each. Rows equal in every order column come in any order.
    """
    total = df.count()
    parts = max(8, -(-total // rows_per_part))
    df = df.withColumn("_part", (deal(parts) if deal else F.pmod(F.xxhash64(*order), F.lit(parts))).cast("int"))
    sizes = df.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)).cast("long"))
    same = [ranked[c].eqNullSafe(starts[c]) for c in (*group, "_part")]
    joined = ranked.join(starts, same, "left")
    return joined.select(*[ranked[c] for c in df.columns if c != "_part"], (F.col("_rank") - 1 + F.col("_start")).alias(out))


def number_rows(df: DataFrame, by: list[str], order: list[str], out: str, rows_per_run: int = 200_000, name: str = "numbered") -> DataFrame:
    """``df`` with each row's place in its group, from 0 without gaps, by ``order``; null comes first.

    The table is cut into runs along (by, order), so a group of any size is spread; each run is
    sorted by itself and written in that order, and a group's place in a run starts after its
    rows in the runs before. Rows equal in every order column share a run. ``df`` is
    evaluated two to three times, so it should be cheap to read; besides ``out`` the result has ``_group_rows``.
    """
    runs = max(1, -(-df.count() // rows_per_run))
    one = by or ["_all"]
    keyed = df if by else df.withColumn("_all", F.lit(0))
    line = F.monotonically_increasing_id()  # the run's number in the upper bits, the row's place in the lower 33
    ordered = keyed.repartitionByRange(runs, *one, *order).sortWithinPartitions(*one, *order).withColumn("_line", line)
    table = materialise(ordered.withColumns({"_run": F.shiftright("_line", 33), "_at": F.col("_line").bitwiseAND((1 << 33) - 1)}).drop("_line"), name)
    held = table.groupBy(*one, "_run").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = W.partitionBy(*one)
    earlier = F.coalesce(F.sum("_rows").over(group.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*[F.col(c).alias(f"_by_{c}") for c in one], F.col("_run").alias("_r"), (earlier - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("_group_rows"))
    same = F.col("_run") == F.col("_r")
    for c in one:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return table.join(starts, same).select(*[table[c] for c in df.columns], (F.col("_at") + F.col("_shift")).cast("long").alias(out), "_group_rows")


# --- byte-level tokenising -------------------------------------------------

#: Separators of the white-space words `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the alphanumeric words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, read after A-Z are lower-cased.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(0x57A0)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"n": 0, "up": None, "down": None}

M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> M3)
    x = x * M1
    x = x ^ (x >> M3)
    x = x * M2
    return x ^ (x >> M3)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def tidy() -> None:
    """Give back what earlier tasks of this Python worker left: workers are used again, and allocators keep what is freed."""
    _powers.update(n=0, up=None, down=None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, limit: int = 1 << 20):
    """Ranges (i, j) of neighbouring texts that together have about ``limit`` bytes; a longer text comes alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of neighbouring texts: their hashes, where each text's words begin (n + 1), and their bytes' places.

    The hash is a polynomial over the word's bytes, taken from differences of prefix
    sums, so that all words of a slice come from a few passes over its bytes.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, separators: np.ndarray, lower: bool = True):
        base = int(offs[0])
        data = raw[base : int(offs[-1])]
        offs = offs - base
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
            return
        inside = ~(separators[LOWER] if lower else separators)[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        up, self.down = _power_tables(n + 1)
        np.cumsum((_BYTE[LOWER] if lower else _BYTE)[data] * up[:n], out=self.sums[1:])
        self.hashes = mix((self.sums[self.ends] - self.sums[self.starts]) * self.down[self.starts])
        self.at = np.searchsorted(self.starts, offs)

    def prefixes(self, size: int) -> np.ndarray:
        """Hash of each word's first ``size`` bytes, as if they were the word."""
        if not len(self.starts):
            return self.hashes
        return mix((self.sums[np.minimum(self.starts + size, self.ends)] - self.sums[self.starts]) * self.down[self.starts])


def words(raw: np.ndarray, offs: np.ndarray, separators: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of neighbouring texts, and for each text where its words begin (n + 1)."""
    found = Words(raw, offs, separators, lower)
    return found.hashes, found.at


_STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each position, over the whole slice; the last size - 1 are missing."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out = out + hashes[k : k + n] * _STEPS[k % 64]
    return mix(out)


def shingles_at(hashes: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The shingles of ``size`` words at ``places``, as ``shingles`` gives them."""
    out = np.full(len(places), np.uint64(size), np.uint64)
    for k in range(size):
        out = out + hashes[places + k] * _STEPS[k % 64]
    return mix(out)


def annotate(docs: DataFrame, out: str, fields: str, compute, text: str = "text") -> DataFrame:
    """``docs`` and a struct column ``out`` that ``compute`` makes of each Arrow batch's text column.

    ``compute`` is called once a task with no argument and gives the function from the
    column to a list of arrays, one for each field. A column that is already called
    ``out`` is replaced; all others pass through, whatever their names.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    struct = F.lit(None).cast(f"struct<{fields}>").alias(out)
    schema = docs.limit(0).select("*", struct).schema
    names = [f.name for f in schema[-1].dataType.fields]

    def run(batches):
        tidy()
        function = compute()
        for batch in batches:
            arrays = [pa.array(a) if not isinstance(a, (pa.Array, pa.ChunkedArray)) else a for a in function(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, names)], [*kept, out])

    return docs.mapInArrow(run, schema)


# --- bounded samples to learn from ------------------------------------------


def sample_by_class(rows: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """About ``per_class`` rows (doc_id, label) of each class by a hash of doc_id, no fewer where there are as many."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    wanted = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        share = min(1.0, (per_class + 4 * per_class**0.5) / n)
        wanted = wanted | ((F.col(label) == F.lit(value)) & (hashed < int(share * (1 << 30))))
    return rows.where(wanted).withColumn("_hash", hashed)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, fold: int, left_out: int, per_class: int, max_bytes: int, seed: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) of each class, from the rows whose fold isn't ``left_out``.

    Only texts up to ``max_bytes`` are learned from, so the driver gets at most
    classes * per_class * max_bytes bytes. Null labels and texts are left out.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(fold) != left_out)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    chosen = sample_by_class(rows, "_label", per_class, seed)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    found = texts.join(F.broadcast(chosen), "doc_id").select("text", "_label", "_hash", "doc_id").collect()
    out, taken = [], {}
    for r in sorted(found, key=lambda r: (r["_hash"], r["doc_id"], r["_label"], r["text"])):
        if taken.get(r["_label"], 0) < per_class:
            taken[r["_label"]] = taken.get(r["_label"], 0) + 1
            out.append((r["text"], r["_label"]))
    return out
