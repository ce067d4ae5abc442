"""A corpus cleaned and packed in five stages, each reading what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stroma.llm import decontaminate, packing, quality_cnn, secret_scan
from stroma.llm.neardup import BROADCAST_IDS, near_duplicates
from stroma.llm.shared import materialise
from stroma.sources.tables import discard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network doesn't reject."""
    return quality_cnn.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (80 %); of rows of one id and text, one.

    Rows that share an id but differ in text are judged each by its own text. Rows without an id all stay.
    """
    found = materialise(near_duplicates(docs).where("doc_id is not null").select("doc_id", "text_key", "kept"), "pipeline-found")
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    again = found.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"))
    gone, again = materialise(gone, "pipeline-gone"), materialise(again, "pipeline-again")
    key = F.xxhash64(docs["text"].cast("string"))

    def those(others: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        small = F.broadcast(others) if others.count() <= BROADCAST_IDS else others
        return rows.join(small, (docs["doc_id"].cast("long") == others["_gone_id"]) & (key == others["_gone_key"]), how)

    left = those(gone, "left_anti", docs)
    if again.isEmpty():
        return left
    return those(again, "left_anti", left).unionByName(those(again, "left_semi", left).dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, or with too few words of them to count."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("packed", packed),
]

#: The learned, tokenising and scanning stages aren't SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read back, and deleted when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
        before = docs
    return docs
