"""Learned operators: exact scores against brute force, held-out accuracy, odd inputs."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stroma.llm import language_ppm, quality_cnn, registry, toxicity_fst
from stroma.llm.shared import LOWER, text_buffers

SMALL = "/root/testdata/sf0.01"


def bits_by_hand(texts: list[bytes], data: bytes, order: int) -> float:
    tree = [defaultdict(Counter) for _ in range(order + 1)]
    learned = b"".join(b" " * order + t for t in texts)
    for n in range(order + 1):
        for i in range(len(learned) - n):
            tree[n][learned[i : i + n]][learned[i + n]] += 1

    def cost(context: bytes, s: int) -> float:
        seen = tree[len(context)].get(context)
        shorter = lambda: cost(context[1:], s) if context else 8.0
        if not seen:
            return shorter()
        total, kinds = sum(seen.values()), len(seen)
        return math.log2((total + kinds) / seen[s]) if s in seen else math.log2((total + kinds) / kinds) + shorter()

    padded = b" " * order + data
    return sum(cost(padded[i - order : i], padded[i]) for i in range(order, len(padded)))


def test_code_lengths_are_exact():
    texts = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"xyzzy plugh", "größe".encode()]}
    model = language_ppm.Model(texts, order=3)
    asked = ["abra plugh", "q", "", "größte xyz", "zzzzz abracadabra" * 50]
    got = model.bits(*text_buffers(pa.array(asked)))
    for row, t in zip(got, asked):
        for have, lang in zip(row, model.langs):
            assert have == pytest.approx(bits_by_hand(texts[lang], LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes(), 3), rel=1e-4, abs=1e-3)


def odd(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "12 34 !!", "de"), (4, "x" * 300_000, "en"), (5, "the the", "en"), (5, "the the", "en"), (None, "das ist", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'clash' as language", "1 as quality", "2 as toxicity", "'s' as score")


def test_language(spark):
    got = registry.op4_language_ppm(spark, SMALL).toPandas().merge(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.97
    assert (got.held_out == got.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 4 == 2)).all()
    docs = odd(spark)
    found = language_ppm.identify_language(docs, language_ppm.fit(docs))
    rows = found.select("text", "language.lang", "language.score").collect()
    assert len(rows) == 7 and all((r.lang == "und") == (r.text in (None, "", "12 34 !!")) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    numerals = spark.createDataFrame([(k, t) for k, t in enumerate(["½ ¼", "①", "Ⅳ ²", "٣", "ª"])], "doc_id long, text string")
    known = language_ppm.identify_language(numerals, language_ppm.fit(docs))
    assert [r.lang == "und" for r in known.orderBy("doc_id").select("language.lang").collect()] == [True] * 4 + [False]
    empty = docs.limit(0)
    model = language_ppm.fit(empty)
    assert language_ppm.identify_language(empty, model).count() == 0
    assert {r.lang for r in language_ppm.identify_language(docs, model).select("language.lang").collect()} == {"und"}


def test_quality(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = registry.op5_quality_cnn(spark, SMALL).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert (got.held_out == got.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0)).all()
    net = quality_cnn.train([("fine words here", 1), ("bad %%% bad", 0)] * 20)
    scored = quality_cnn.score_quality(odd(spark), net)
    assert scored.count() == 7 and all(0 <= r.score <= 1 for r in scored.select("quality.score").collect())
    nothing = quality_cnn.fit(odd(spark).limit(0), labels.limit(0))
    assert [r.score for r in quality_cnn.score_quality(odd(spark), nothing).select("quality.score").collect()] == [0.5] * 7
    kept = quality_cnn.drop_poor(odd(spark), labels.limit(0))
    assert kept.columns == odd(spark).columns and kept.count() == 7


def test_network_reads_all_chunks_alike():
    net = quality_cnn.train([("fine words here and there", 1), ("bad %%% bad %%% ###", 0)] * 20)
    text = "quite ordinary words, one after another; " * 200
    raw, offs = text_buffers(pa.array([text, text * 3, "é" * 9, ""]))
    together = net.scores(raw, offs)
    alone = [net.scores(*text_buffers(pa.array([t])))[0] for t in (text, text * 3, "é" * 9, "")]
    assert np.allclose(together, alone)
    sym, strides = quality_cnn.symbols(*text_buffers(pa.array([text])))
    out = net.filters(sym)
    by_hand = [max(0.0, max(sum(net.tables[k][sym[p + k]][0] for k in range(quality_cnn.WIDTH)) + net.bias[0] for p in range(c * 32, c * 32 + 64))) for c in range(int(strides[0]) - 1)]
    assert np.allclose(net.pooled(out, strides)[0][0] * strides[0] - max(0, out[(strides[0] - 1) * 32 :, 0].max()), sum(by_hand), rtol=1e-3)


def test_toxicity(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = registry.op8_toxicity_grammar(spark, SMALL).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    scored = toxicity_fst.score_toxicity(odd(spark), toxicity_fst.fit(odd(spark), labels.limit(0)))
    assert scored.count() == 7 and all(0 <= r.score < 0.5 for r in scored.select("toxicity.score").collect())


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("What a clown.", ["insult"]),
        ("You are an idiot!", ["insult-aimed"]),
        ("You are not an idiot.", ["insult-aimed-negated"]),
        ('He said "what a moron" twice.', ["insult-aimed-reported"]),
        ("The report said: scum of the pond.", ["insult-reported"]),
        ("I will kill you.", ["threat-aimed"]),
        ("Shoot the picture.", []),
        ("nothing here", []),
    ],
)
def test_grammar(text, kinds):
    grammar = toxicity_fst.Grammar(toxicity_fst.learn_lexicon([]))
    names = ["-".join([w, *(n for n, on in zip(("aimed", "negated", "reported"), flags) if on)]) for w, *flags in toxicity_fst.KINDS]
    counts = grammar.counts(text)
    assert [names[k] for k in np.flatnonzero(counts[:-1])] == kinds
    plain, softened = grammar.score(grammar.counts("You are an idiot!")), grammar.score(grammar.counts("You are not an idiot."))
    assert softened < plain


def test_suspects_lose_no_match():
    grammar = toxicity_fst.Grammar(toxicity_fst.Lexicon({"idiot": 1.0, "crétin": 1.0}, {"chón": 1.0, "lowei": 0.5}))
    texts = ["an IDIOT here", "el chónía y", "der loweischaft.", "clean", "", "the crétin!", "lowe"]
    got = grammar.suspects(*text_buffers(pa.array(texts)))
    assert got.tolist() == [True, True, True, False, False, True, False]
    assert [grammar.counts(t).any() for t in texts] == [True, True, True, False, False, True, False]


def scored_alike(score, texts: list[str]) -> None:
    """Each text alone, all in order, shuffled, and each behind copies of another: the same scores to the last bit."""
    alone = [score([t])[0] for t in texts]
    order = np.random.default_rng(0).permutation(len(texts))
    assert score(texts) == alone
    assert [x for _, x in sorted(zip(order.tolist(), score([texts[k] for k in order])))] == alone
    for k, t in enumerate(texts):
        assert score([texts[k - 1], t, t, texts[k - 2]])[1:3] == [alone[k]] * 2


@pytest.fixture(scope="module")
def some_texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).select("text").collect()
    return ["Anat with", "with", "", "a\0b\0a\0b", "é" * 33, *[r.text for r in rows]]


def test_quality_scores_do_not_depend_on_neighbours(spark, some_texts):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    net = quality_cnn.fit(docs, labels)
    scored_alike(lambda texts: net.scores(*text_buffers(pa.array(texts))).tolist(), some_texts)
    assert net.scores(*text_buffers(pa.array(["ab", "ab\0ab\0"])))[0] != net.scores(*text_buffers(pa.array(["ab\0ab\0"])))[0]


def test_code_lengths_do_not_depend_on_neighbours(some_texts):
    model = language_ppm.Model({"a": [t.encode() for t in some_texts[5:20]], "b": [t.encode() for t in some_texts[20:35]]})
    scored_alike(lambda texts: [tuple(r) for r in model.bits(*text_buffers(pa.array(texts))).tolist()], some_texts)


def filters_by_hand(net, text: str) -> float:
    """The score of one text, place by place."""
    data = [b or 0xFF for b in text.encode()]
    padded = data + [0] * 200
    symbol = []
    for p in range(len(data)):
        four = padded[p : p + 4]
        symbol.append(padded[p] + 256 * any(p - back >= 0 and padded[p - back : p - back + 4] == four for back in range(2, quality_cnn.BACK + 1)))
    symbol += [0] * 200
    strides = -(-len(data) // quality_cnn.STRIDE)
    means = []
    for f in range(len(net.bias)):
        value = [max(0.0, float(sum(net.tables[k][symbol[p + k]][f] for k in range(quality_cnn.WIDTH)) + net.bias[f])) if p < len(data) else 0.0 for p in range((strides + 1) * quality_cnn.STRIDE)]
        chunks = [max(value[c * quality_cnn.STRIDE : (c + 2) * quality_cnn.STRIDE]) for c in range(strides)]
        means.append(sum(chunks) / max(1, strides))
    return 1 / (1 + math.exp(-(sum(m * w for m, w in zip(means, net.weights)) + net.offset)))


def test_network_equals_its_definition(some_texts):
    net = quality_cnn.train([("fine words here and there", 1), ("bad %%% bad %%% ###", 0)] * 20)
    texts = [t for t in some_texts if len(t) < 1500]
    got = net.scores(*text_buffers(pa.array(texts)))
    assert np.allclose(got, [filters_by_hand(net, t) for t in texts], atol=1e-6)
