"""The toxicity grammar's machines: composition against running one after another along every path, matches against their definition by places."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from stroma.llm import toxicity_fst as t
from stroma.llm.shared import text_buffers

SMALL = "/root/testdata/sf0.01"


def paths(machine: t.Transducer, symbols: list[int]) -> list[tuple[list[int], float]]:
    """(outputs, weight) of every path of the machine that reads the symbols, found by trying all its arcs."""
    found = [(0, [], 0.0)]
    for x in symbols:
        found = [(to, [*out, y], w + weight) for state, out, w in found for (s, read), (to, y, weight) in machine.arcs.items() if (s, read) == (state, x)]
    return [(out, w) for _, out, w in found]


def strings():
    rng = random.Random(3)
    yield from map(list, itertools.product(range(8), repeat=3))
    for _ in range(300):
        yield [rng.choice([0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 7]) for _ in range(rng.randrange(4, 16))]


def small(machine: t.Transducer, symbols: set[int]) -> t.Transducer:
    return t.Transducer({k: v for k, v in machine.arcs.items() if k[1] in symbols})


def test_composition_equals_all_paths_of_its_parts():
    forward, backward = t.machines()
    for parts, composed in ((forward, t.FORWARD), (backward, t.BACKWARD)):
        for symbols in list(strings())[::23]:
            if parts is backward:
                symbols = [y for y, _ in t.FORWARD.run(symbols)][::-1]
            want = [(symbols, 0.0)]
            for m in parts:
                want = [(o, w + more) for out, w in want for o, more in paths(m, out)]
            found = composed.run(symbols)
            assert len(want) == 1 and want[0][0] == [y for y, _ in found]
            assert want[0][1] == pytest.approx(sum(w for _, w in found))


def by_places(classes: list[int]) -> list[tuple[int, int]]:
    """(place, kind) of every match, from the places of the words alone."""
    words = [k for k, c in enumerate(classes) if c != t.QUOTE]
    rank = {k: n for n, k in enumerate(words)}
    out = []
    for k in words:
        if classes[k] not in (t.INSULT, t.THREAT):
            continue
        before, after = words[max(0, rank[k] - t.REACH) : rank[k]], words[rank[k] + 1 : rank[k] + 1 + t.REACH]
        near = lambda places, c: any(classes[p] == c for p in places)
        negated, meant = near(before, t.NEGATION), near(before, t.INTENT)
        reported = t.SPOKE in classes[:k] or classes[:k].count(t.QUOTE) % 2 == 1
        if classes[k] == t.INSULT:
            out.append((k, t.KINDS.index(("insult", int(near(before, t.TARGET) or near(after, t.TARGET)), int(negated), int(reported)))))
        elif meant or near(after, t.TARGET):
            out.append((k, t.KINDS.index(("threat", int(near(after, t.TARGET) or meant and near(before, t.TARGET)), int(negated), int(reported)))))
    return out


def test_matches_equal_their_definition():
    for classes in strings():
        found = t.matches([(c, float(k)) for k, c in enumerate(classes)])
        assert sorted((int(place), kind) for kind, place in found) == by_places(classes), classes


def test_a_path_weighs_what_its_kind_does():
    for classes in strings():
        one = t.FORWARD.run(classes)
        two = t.BACKWARD.run([y for y, _ in one][::-1])[::-1]
        for (_, a), (y, b) in zip(one, two):
            if y < 0:
                assert a + b == pytest.approx(t.FIRST[-1 - y])


def test_no_document_that_matches_is_passed_over(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "labels"))
    grammar = t.fit(docs, labels)
    texts = [r.text or "" for r in docs.select("text").collect()]
    texts += ["“idiot” — you “moron”, “idiot”", "you idiot…you moron…idiot".replace(" ", " "), "VOUS ÊTES UN CRÉTIN"]
    suspects = grammar.suspects(*text_buffers(pa.array(texts)))
    counts = np.array([grammar.counts(x) for x in texts])
    assert not (counts.any(1) & ~suspects).any() and suspects[-3:].all() and counts[-3:].any(1).all()
    alone = [float(grammar.score(c)) for c in counts]
    assert grammar.score(counts).tolist() == alone and min(alone[-3:]) > 0.5
