"""URL filters: host and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import mix, ship_package

# Fixed values: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

# Words (fixed values) that unwanted and other sites are named by, and what stands beside them. Written without looking at any
# table that is judged. The last line of the others holds harmless words that share letters with the unwanted ones.
UNWANTED = """
casino slots jackpot poker roulette bets betting lottery bingo winner
pills viagra pharma meds steroids
ads adserver clicks popups tracker banners
porn xxx adult sexcams escort nudes
spam linkfarm seo-links phish malware keygen warez cracked
payday loans replica giftcards quick-cash crypto-double prize
""".split()
OTHERS = """
library university museum weather recipes garden travel science newspaper football hospital school hiking opera timetable council astronomy chess birds poetry docs
mathematics grammar bicycles philosophy architecture music folktales bakery parks archive chemistry genealogy novels essays parliament theatre volcano sailing geology health
carpentry elections knitting pottery railways ferries insurance dentist wedding camping surfing vineyard orchestra kindergarten
addresses bettina advent farmers athletics cashmere winter freedom pillows better shadows drugstore adulthood clickbeetle meadows slotted spanish loanwords pokeweed
""".split()
BESIDE = "best my online the city shop hub zone world club top mega easy info daily plus".split()
PER_WORD = 6


def labelled_table(words: list[str], per_word: int = PER_WORD) -> list[str]:
    """Invented addresses on reserved domains, ``per_word`` of each word: the word beside another one, before or behind it, now and then with a subdomain; the path says nothing."""
    out = []
    for w in words:
        for k in range(per_word):
            h = zlib.crc32(f"{w} {k}".encode())
            beside, rest = BESIDE[h % len(BESIDE)], h // len(BESIDE)
            joint = ("-", "", ".")[rest % 3]
            name = f"{beside}{joint}{w}" if rest // 3 % 2 else f"{w}{joint if joint != '.' else ''}{beside}"
            out.append(f"{name}.{('example', 'test')[rest // 6 % 2]}/{('en', 'de', 'fr', 'es', 'page')[rest // 12 % 5]}/{rest % 9973}")
    return out


BLOCKED, ALLOWED = labelled_table(UNWANTED), labelled_table(OTHERS)

BITS, SIZES = 18, (3, 4, 5)
THRESHOLD = 0.5


def host(url: str | Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(_parts(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _parts(url, 2)


def _parts(url: str | Column, group: int) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)", group), F.lit(""))


def rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does. A rule fits its host, all its subdomains, and every path that starts with its own."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def features(addresses: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every hashed character n-gram of host and path; digits count as one character, subdomains m and www don't count."""
    rows, cells = [], []
    for k, a in enumerate(addresses):
        h, _, p = a.partition("/")
        while h.startswith(("m.", "www.", "blog.")):
            h = h.partition(".")[2]
        raw = np.frombuffer(("^" + h + "/" + p.translate(_DIGITS)).encode(), np.uint8).astype(np.uint64)
        for n in SIZES:
            if len(raw) >= n:
                g = np.full(len(raw) - n + 1, np.uint64(n), np.uint64)
                for i in range(n):
                    g = g * np.uint64(0x100000001B3) + raw[i : i + len(g)]
                cells.append((mix(g) >> np.uint64(64 - BITS)).astype(np.int64))
                rows.append(np.full(len(g), k))
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_DIGITS = str.maketrans("123456789", "0" * 9)


def train(blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, steps: int = 600, rate: float = 20.0, pull: float = 0.0001) -> np.ndarray:
    """Weights of the hashed n-grams, the offset last: gradient steps on the logistic loss, both classes weighing alike, with a quadratic penalty on the weights."""
    rows, cells = features([*blocked, *allowed])
    y = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    share = np.where(y == 1, 0.5 / max(1, len(blocked)), 0.5 / max(1, len(allowed)))
    norm = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    weights = np.zeros((1 << BITS) + 1)
    for _ in range(steps):
        p = _sigmoid(np.bincount(rows, weights[cells] * norm[rows], len(y)) + weights[-1])
        slope = (p - y) * share
        step = np.bincount(cells, (slope * norm)[rows], 1 << BITS)
        weights[:-1] -= rate * (step + pull * weights[:-1])
        weights[-1] -= slope.sum()
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out_accuracy(blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, folds: int = 10, **options) -> tuple[float, float]:
    """Shares of the blocked and of the allowed hosts that a regression without them judges rightly: each host is left out once."""
    right = {1: [], 0: []}
    for k in range(folds):
        weights = train([a for i, a in enumerate(blocked) if i % folds != k], [a for i, a in enumerate(allowed) if i % folds != k], **options)
        for label, table in ((1, blocked), (0, allowed)):
            asked = table[k::folds]
            right[label] += ((probability(asked, weights) >= THRESHOLD) == bool(label)).tolist()
    return float(np.mean(right[1])), float(np.mean(right[0]))


def probability(addresses: list[str], weights: np.ndarray) -> np.ndarray:
    """The regression's probability of being unwanted; 0 for an address without any n-gram."""
    rows, cells = features(addresses)
    many = np.bincount(rows, minlength=len(addresses))
    total = np.bincount(rows, weights[cells], len(addresses)) / np.sqrt(np.maximum(many, 1))
    return np.where(many > 0, _sigmoid(total + weights[-1]), 0.0)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url, ...).

    The longest rule that fits decides; without one, the regression's probability of being
    unwanted: at least ``threshold`` blocks. A url that is null or has no ``://`` has an
    empty host and path, which no n-gram speaks against. Rows stay as they are repeated;
    other columns are ignored.
    """
    ship_package(pages.sparkSession)
    weights = pages.sparkSession.sparkContext.broadcast(train(blocked, allowed))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, p in batches:
            yield pd.Series(probability([a + b for a, b in zip(h, p)], weights.value))

    cut = pages.select("page_id", host("url").alias("host"), path("url").alias("path"))
    found = cut.withColumn("_rule", rule(F.col("host"), F.col("path"), rules)).withColumn("score", score("host", "path"))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learned).alias("verdict"), "score")
