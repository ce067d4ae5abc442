"""Shards by jump consistent hashing: no ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import gapless_rank

#: Multiplier of the 64-bit congruential generator (a fixed value).
MULTIPLIER = 2862933555777941757


def jumps(key: Column, limit: int) -> Column:
    """The shards that a key visits while shards are appended up to ``limit``: ascending, from 0.

    The generator runs in unsigned 64-bit arithmetic, held in decimal(20, 0), whose
    products fit 38 digits. There are about ln(limit) visits; a key that needs more
    steps than are allowed raises an error.
    """
    steps = limit if limit <= 64 else 64 + 8 * math.ceil(math.log2(limit))
    unsigned = F.pmod(key.cast("decimal(20,0)"), F.lit(Decimal(2**64)).cast("decimal(20,0)"))
    following = lambda x: ((x * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit(Decimal(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")

    def step(state: Column, _: Column) -> Column:
        draw = F.floor(state["key"] / F.lit(2**33).cast("decimal(20,0)")).cast("double")
        at = F.floor((state["at"] + 1).cast("double") * (F.lit(float(2**31)) / (draw + 1.0))).cast("long")
        moved = F.struct(following(state["key"]).alias("key"), at.alias("at"), F.array_append(state["seen"], at).alias("seen"))
        return F.when(state["at"] < limit, moved).otherwise(state)

    zero = F.lit(0).cast("long")
    start = F.struct(following(unsigned).alias("key"), zero.alias("at"), F.array(zero).alias("seen"))
    ended = lambda s: F.when(s["at"] >= limit, s["seen"]).otherwise(F.raise_error(F.lit(f"jumps({limit}): out of steps")).cast("array<bigint>"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, ended)


def shard_of(visited: Column, shards: int) -> Column:
    """The shard among ``shards``, from the jumps of at least as many."""
    return F.array_max(F.filter(visited, lambda x: x < shards)).cast("int")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, ...) in shards 0 to ``shards`` - 1, by the law ``key``.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; 1 for null), text_crc32 (of no
    bytes for null: 0), law, shard, slot (gapless from 0 within the shard), grown_shard
    (with one shard more). doc_id and the shard count decide; a null doc_id counts as 0,
    rows of one doc_id share a shard and have slots of their own. Slots follow the part
    a row is dealt to by md5 of its doc_id, then doc_id, crc and size, so no task ranks a
    whole shard. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), jumps(key, shards + 1).alias("_seen"))
    placed = slim.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), shard_of(F.col("_seen"), shards).alias("shard"), shard_of(F.col("_seen"), shards + 1).alias("grown_shard"))
    deal = lambda parts: F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(parts))
    ranked = gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", deal=deal)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
