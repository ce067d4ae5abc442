"""Quality rules from the frequency of lines across the documents of a host."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import materialise

#: A normalised line is removed if more distinct documents of its host have it than this many and this share of the host's documents.
LIMIT, SHARE = 20, 0.01
#: A document is depleted if removed lines held more than this share of its words.
DEPLETED = 0.5
#: Up to so many frequent lines (20 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 500_000

BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
_BLANK = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def repeated_words(tokens: Column, size: int = 3) -> Column:
    """Number of words that lie in a window of ``size`` words found twice or more.

    Windows are 64-bit hashes. Where all differ, that is all; else they are sorted with
    their places, those equal to a neighbour keep their place, and the union of the
    windows at these places is measured in one walk.
    """

    def measured(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))

        def again(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == e["h"])))
            return F.array_sort(F.transform(same, lambda e: e["i"]))

        zero = F.lit(0).cast("long")
        step = lambda a, i: F.struct((a["n"] + i + size - F.greatest(i, a["to"])).alias("n"), (i + size).alias("to"))
        return F.aggregate(let(placed, again), F.struct(zero.alias("n"), zero.alias("to")), step, lambda a: a["n"])

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    some = let(windows(tokens), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), measured(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(tokens) >= size, some).otherwise(F.lit(0).cast("long"))


def lines(text: Column) -> Column:
    """The lines, between line feeds, that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))


def normalised(line: Column) -> Column:
    """Lower case, every run of white space one space, none at the ends, every digit 0."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "0" * 9), _BLANK, " "))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (columns _text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.col("_text")
    counted = docs.withColumn(
        "_c",
        let(
            words(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
        ),
    )
    length = F.length(text)
    out = counted.withColumns(
        {
            "n_words": F.col("_c.n_words"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("_c.n_repeat_words"),
        }
    ).drop("_c")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def frequent_lines(lined: DataFrame, hosts: DataFrame, limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """(_host, _line) of the lines that more of a host's documents have than the limits allow. A document's own repeats are combined before the shuffle."""
    counted = lined.groupBy("_host", "_line").agg(F.count_distinct("_doc").alias("_docs")).where(F.col("_docs") > limit)
    return counted.join(hosts, "_host").where(F.col("_docs") > share * F.col("_all_docs")).select("_host", "_line")


def apply_rules(docs: DataFrame, host: str = "source", limit: int = LIMIT, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """(doc_id, the base's counts, base_failed, n_removed_words, kept) for every row of ``docs`` (doc_id, text, host, ...).

    Lines with a word are normalised and hashed; for each host the distinct documents that
    have a line are counted; lines above the limits are removed; a document that loses
    more than ``depleted`` of its words is rejected, as is one that fails the base.

    Null texts count as empty (base fails), null hosts as one host. Rows of equal doc_id,
    host and text are one document and judged alike, each on its own line; copies of a
    text under other ids are documents of their own. A null doc_id is an id like any
    other. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.coalesce(F.col(host).cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("_host"), text.alias("_text"))
    slim = slim.withColumn("_doc", F.struct("doc_id", F.xxhash64("_text").alias("key"), F.crc32(F.col("_text").cast("binary")).alias("crc")))

    each = slim.select("_doc", "_host", F.explode(F.transform(lines(F.col("_text")), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(_WORD)).cast("long").alias("words")))).alias("_l"))
    each = materialise(each.select("_doc", "_host", F.col("_l.line").alias("_line"), F.col("_l.words").alias("_words")), "rules-lines")
    hosts = slim.groupBy("_host").agg(F.count_distinct("_doc").alias("_all_docs"))
    frequent = materialise(frequent_lines(each, hosts, limit, share), "rules-frequent").withColumn("_gone", F.lit(True))
    marked = each.join(F.broadcast(frequent) if frequent.count() <= BROADCAST_LINES else frequent, ["_host", "_line"])
    # repeated rows add up alike in what is lost and in what the text has; structs with a null id are grouped and joined as equal
    lost = marked.groupBy("_doc", "_host").agg(F.sum("_words").alias("_lost"))
    times = each.groupBy("_doc", "_host").agg(F.sum("_words").alias("_all"))
    shares = lost.join(times, ["_doc", "_host"]).select(F.col("_doc").alias("_d"), F.col("_host").alias("_h"), (F.col("_lost") / F.col("_all")).alias("_share"))
    based = base_counts(slim).drop("_text")
    same = (based["_doc"] == shares["_d"]) & (based["_host"] == shares["_h"])
    out = based.join(shares, same, "left").withColumn("_share", F.coalesce("_share", F.lit(0.0)))
    removed = F.round(F.col("_share") * F.col("n_words")).cast("long").alias("n_removed_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("_share") <= depleted)).alias("kept"), removed)
