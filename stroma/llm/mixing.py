"""A mixture of sources at target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.llm.shared import materialise, number_rows

#: Weights of the sources in their order, repeated; the mixture's words as a share of all; how often a source may be repeated.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2.0
#: Rows of a part of a source that one task orders.
PART_ROWS = 100_000
SEED = 12

_WORD = r"[^\x20\x09-\x0D]+"


def order_key(seed: int = SEED) -> Column:
    """32 hexadecimal digits from the seed and doc_id, in whose order a source's documents are taken."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def fill(sources: DataFrame, words: float, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (weight, source_size, ...) and ``target``: proportional to weight, none above ``epochs`` times its size, together ``words`` if they hold as much.

    A level (words a unit of weight) rises until the clamped targets add up: sources above
    their limit are clamped to it, and what they leave is shared anew by weight, until
    none is above. Each round is one aggregate of ``sources``, which is read once a round.
    The level is a quotient of two sums of whole numbers, so it doesn't depend on their order.
    """
    limit = F.col("source_size") * F.lit(float(epochs))
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= limit
        found = sources.agg(F.sum(F.when(over, limit)).alias("kept"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count_if(over).alias("n")).first()
        if not found["free"] or found["n"] == clamped:
            break
        level, clamped = max(level, (words - (found["kept"] or 0.0)) / found["free"]), found["n"]
    reached = F.when(over, limit).otherwise(F.col("weight") * F.lit(level)) if found["free"] else limit
    return sources.withColumn("target", F.least(reached, limit).cast("double"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, part) for every row of ``docs`` (doc_id, source, text, ...).

    ``size`` is the text's number of words; sources in the order of their code points, null
    last, weigh ``weights``, repeated. The mixture has ``share`` times all words, as
    far as ``epochs`` times each source allow. A source's target, rounded to words, is
    ``whole`` repetitions of each of its documents, and ``part`` more words: its
    documents in the order of ``order_key`` give all their words until the target is met,
    the last of them its first words only. So a source's words differ from its target by
    at most a half, and a document is taken at most ``whole`` + 1 times.

    A null text has no words, a null doc_id counts as an empty id; a table without words
    has targets of 0. Rows of one doc_id are taken one by one, the shorter text first.
    A source of any size is cut into parts along its order; a part starts from the totals
    before it, so no task orders or sums a whole source. Other columns are ignored.
    """
    return _planned(docs, weights, share, epochs, seed, with_text=False)


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: float, seed: int, with_text: bool) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD)).cast("long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.col("text").cast("string").alias("text"))
    sized = materialise(texts.drop("text"), "mix-sizes")
    parts = max(8, -(-sized.count() // PART_ROWS))
    # the first 8 digits, cut evenly: parts ascend with the order key
    part = F.floor(F.conv(F.substring(order_key(seed), 1, 8), 16, 10).cast("long") * parts / F.lit(2**32)).cast("int")
    placed = (texts if with_text else sized).withColumns({"_key": order_key(seed), "_part": part})

    cells = materialise(sized.groupBy("source", part.alias("_part")).agg(F.sum("size").alias("_words")), "mix-cells")
    sources = number_rows(cells.groupBy("source").agg(F.sum("_words").alias("source_size")).withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_n")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    sources = sources.select("source", "source_size", weight.cast("long").alias("weight"))
    words = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    targets = fill(sources, words, epochs)
    taken = F.floor(F.col("target") + 0.5)
    no_words = F.col("source_size") == 0
    whole = F.when(no_words, 0).otherwise(F.floor(taken / F.col("source_size"))).cast("long")
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target", whole.alias("whole"), (taken - whole * F.col("source_size")).cast("long").alias("_more"))

    before = F.coalesce(F.sum("_words").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cells.withColumn("_start", before).join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), F.col("_part").alias("_p"), "_start", "source_size", "target", "whole", "_more")
    within = W.partitionBy("source", "_part").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    ordered = placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = ordered.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    part_words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_more") - F.col("_start") - F.col("_before"))).cast("long")
    text = ["text"] if with_text else []
    return joined.select("doc_id", "source", "size", "source_size", "target", "whole", part_words.alias("part"), *text)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixture itself: (doc_id, source, copy, text), a row for each repetition of a document that has a word of it.

    Whole repetitions have the whole text. The one that completes a source's target has its
    first words, joined by spaces. Documents without words aren't taken. Repeated rows,
    and rows without an id, are taken one by one, as in ``plan_mix``.
    """
    plan = _planned(docs, weights, share, epochs, seed, with_text=True).where("size > 0 and (whole > 0 or part > 0)")
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("whole") + (F.col("part") > 0).cast("long")).cast("int"))))
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({_WORD})"), 1), 1, F.col("part").cast("int")), " ")
    cut = (F.col("copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    return copies.select("doc_id", "source", "copy", F.when(cut, first_words).otherwise(F.col("text")).alias("text"))
