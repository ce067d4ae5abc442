"""The corpus queries of ``__spark_entry__`` and the SQL that some of them can be checked against."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stroma.llm import conversation, decontaminate, language_ppm, line_rules, merkle, mixing, quality_cnn, secret_scan, sharding, toxicity_fst, url_filter
from stroma.llm.oracle import SQL as SQL  # noqa: PLC0414
from stroma.llm.neardup import near_duplicates
from stroma.llm.packing import pack
from stroma.llm.shared import documents, remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op2_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(documents(spark, sf_dir))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(documents(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("passages.item_ids", ","), 256)
    return found.select("doc_id", "passages.n_words", "passages.n_hit", F.size("passages.item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op4_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_ppm.fit(docs)
    found = language_ppm.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality_cnn.score_quality(docs, quality_cnn.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "quality.score", (F.col("quality.score") >= quality_cnn.THRESHOLD).cast("int").alias("predicted"))


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = toxicity_fst.score_toxicity(docs, toxicity_fst.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= toxicity_fst.THRESHOLD).cast("int").alias("predicted"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # at 85 % 24 bands of 6 miss a pair at the threshold with probability 1.2e-5
    found = near_duplicates(documents(spark, sf_dir), percent=85, bands=24, rows=6)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "lexed")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.col("text").cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)
    found = merkle.prove(merkle.build(docs, claimed={"text": tampered}), siblings=False)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("whole") * F.col("size") + F.col("part")).alias("taken")
    return mixing.plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversation.summarise(conversation.damage(turns), turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_jump_sharding,
        op2_line_frequency_rules,
        op3_benchmark_decontamination,
        op4_language_ppm,
        op5_quality_cnn,
        op6_nnls_packing,
        op7_url_filter,
        op8_toxicity_grammar,
        op9_minhash_neardup,
        op10_secret_scan,
        op11_merkle_manifest,
        op12_source_mixing,
        op13_conversation_repair,
    )
}
