"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes: insult, threat verb, intent, target,
negation, speech verb, quotation mark. Machines of a few states each, all letter
transducers, add one mark each to the insults and threats they pass: negated (a negation
stands shortly before), reported (a speech verb or an open quotation mark before), meant
(an intent shortly before), aimed (a target shortly before). They are composed into one
machine that reads from left to right. The machine for targets that follow is the same
one read from right to left; composed with the insult and threat machine, which turns
what is marked into matches with a weight, it reads the first one's output backwards.
So a clause costs two walks, and only matched clauses count, never words alone.
A document's score is a logistic function of the weighted matches of its clauses.

The insult transducer has a short fixed list and what is learned from labelled texts:
words, and stems that many different words begin with, that stand in many different
surroundings in toxic texts and far less often in others. Each term carries a weight from
its log odds. The weights of the kinds, and of how many matches chance would give a text
of the length, are fitted on the same texts and stay near their first values where these
say nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stroma.llm.shared import NON_ALNUM, Words, annotate, labelled_texts, slices, text_buffers

#: Learned from at most so many texts of each class, of at most so many bytes.
PER_CLASS, MAX_BYTES = 2_000, 8_000
#: A learned term stands between so many different pairs of neighbours in toxic texts at least, and has these log odds.
CONTEXTS, LOG_ODDS = 10, 3.0
STEMS = range(4, 9)
#: A stem gives way to a longer one that keeps this share of its surroundings in toxic texts.
KEEP = 0.9
#: Log odds from which a term has the full weight.
FULL = 6.0
THRESHOLD = 0.5

# Fixed word lists.
INSULTS = "bastard clown creep disgusting dumb fool freak garbage idiot idiots imbecile jerk liar loser losers maggot moron morons pathetic pig rat scum scumbag stupid swine trash ugly vermin worthless dummkopf trottel abschaum versager arschloch crétin imbécile ordure salaud idiota imbécil basura estúpido escoria".split()
THREATS = "beat burn choke crush destroy hang hurt kill murder punch shoot slap smash stab strangle töten umbringen schlagen tuer frapper matar golpear".split()
INTENTS = "will shall gonna going ll werde werden vais vas voy".split()
TARGETS = "you your yours yourself youre u ya he him his she her they them their du dich dir ihr euch tu te toi vous votre usted tú ustedes ellos".split()
NEGATIONS = "not no never neither nor isn aren wasn weren don doesn didn cannot without nicht kein keine nie pas jamais nunca jamás".split()
SPEECH = "said says say called calls call told tells wrote writes quoted quotes claimed claims alleged sagte sagt nannte dit disait dijo dice llamó".split()

INSULT, THREAT, INTENT, TARGET, NEGATION, SPOKE, QUOTE, OTHER = range(8)
_LISTS = ((THREATS, THREAT), (INTENTS, INTENT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (SPEECH, SPOKE))
_WORD = re.compile(r"[^\W_]+|[\"“”«»„]")
_BETWEEN = re.compile(r"[\W_]+")
_CLAUSE = re.compile(r"[.!?;\n]+")
#: Kinds of match, each aimed or not, negated or not, reported or not.
KINDS = [(what, aimed, negated, reported) for what in ("insult", "threat") for aimed in (0, 1) for negated in (0, 1) for reported in (0, 1)]
#: What the machines' arcs weigh; a kind's first weight is the sum along its path.
INSULT_WEIGHT, THREAT_WEIGHT, AIMED_WEIGHT, NEGATED_WEIGHT, REPORTED_WEIGHT = 2.5, 1.0, 1.5, -1.5, -1.5
#: The kinds' first weights, and that of the matches that chance would give.
FIRST = np.array([(INSULT_WEIGHT if what == "insult" else THREAT_WEIGHT) + AIMED_WEIGHT * aimed + NEGATED_WEIGHT * negated + REPORTED_WEIGHT * reported for what, aimed, negated, reported in KINDS] + [-1.0])
#: A negation, target or intent reaches this many words.
REACH = 4


class Lexicon:
    """Classes of words, a transducer of one state with an arc a word; a stem is an arc for every word it begins."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], chance: float = 0.0):
        """Terms with their weights; ``chance``: how often a word of a text that isn't toxic is one of them."""
        self.words, self.stems, self.chance = words, stems, chance
        self.classes = {w: c for ws, c in _LISTS for w in ws} | {w: INSULT for w in words}
        self.sizes = sorted({len(s) for s in stems})

    def __call__(self, word: str) -> tuple[int, float]:
        """(class, weight)"""
        c = self.classes.get(word)
        if c is not None:
            return c, self.words.get(word, 1.0)
        for n in self.sizes:
            if word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return (QUOTE if word in '"“”«»„' else OTHER), 1.0


# --- the machines -----------------------------------------------------------

#: Marks that machines add to a class; a symbol is a class with a set of marks, one number.
NEGATED, REPORTED, MEANT, BEFORE, AFTER = (8 << k for k in range(5))
SYMBOLS = range(8 << 5)


class Transducer:
    """A deterministic weighted letter transducer: ``arcs[state, symbol] = (next state, output, weight)``, from state 0, all states final."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int, float]]):
        self.arcs = arcs

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        """(output, weight) of each symbol."""
        state, out = 0, []
        for x in symbols:
            state, y, weight = self.arcs[state, x]
            out.append((y, weight))
        return out

    def compose(self, other: Transducer) -> Transducer:
        """The machine that does what ``other`` does with this one's output; weights add up. Only pairs of states that can be reached are made."""
        names, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        by_state: dict[int, list[int]] = defaultdict(list)
        for state, x in self.arcs:
            by_state[state].append(x)
        while todo:
            a, b = todo.pop()
            for x in by_state[a]:
                a2, y, w1 = self.arcs[a, x]
                b2, z, w2 = other.arcs[b, y]
                if (a2, b2) not in names:
                    names[a2, b2] = len(names)
                    todo.append((a2, b2))
                arcs[names[a, b], x] = (names[a2, b2], z, w1 + w2)
        return Transducer(arcs)


def _class(symbol: int) -> int:
    return symbol % 8


def within_reach(of: int, mark: int, weight: float, marked: tuple[int, ...]) -> Transducer:
    """Marks the classes ``marked`` where ``of`` is one of the REACH words before. State: words since, REACH: too many; quotation marks are no words."""
    arcs = {}
    for state in range(REACH + 1):
        for x in SYMBOLS:
            c = _class(x)
            near = c in marked and state < REACH
            arcs[state, x] = (state if c == QUOTE else 0 if c == of else min(REACH, state + 1), x | mark if near else x, weight if near else 0.0)
    start = {(0 if s == REACH else s + 1, x): (0 if t == REACH else t + 1, y, w) for (s, x), (t, y, w) in arcs.items()}  # nothing met yet is the first state
    return Transducer(start)


def reported_speech(weight: float) -> Transducer:
    """Marks insults and threats behind a speech verb or within quotation marks. State: speech met, quotation open."""
    arcs = {}
    for state in range(4):
        for x in SYMBOLS:
            c = _class(x)
            to = state | 1 if c == SPOKE else state ^ 2 if c == QUOTE else state
            hit = state > 0 and c in (INSULT, THREAT)
            arcs[state, x] = (to, x | REPORTED if hit else x, weight if hit else 0.0)
    return Transducer(arcs)


def matched(of: int, first: int) -> Transducer:
    """Turns marked symbols of the class ``of`` into match numbers from ``first`` on, -1 - number; all else passes.

    An insult always matches. A threat verb needs an intent before it or a target behind
    it; a target before it counts only with an intent.
    """
    arcs = {}
    for x in SYMBOLS:
        aimed = x & AFTER or x & BEFORE and (of == INSULT or x & MEANT)
        if _class(x) == of and (of == INSULT or x & (MEANT | AFTER)):
            number = first + 4 * bool(aimed) + 2 * bool(x & NEGATED) + bool(x & REPORTED)
            arcs[0, x] = (0, -1 - number, (INSULT_WEIGHT if of == INSULT else THREAT_WEIGHT) + AIMED_WEIGHT * bool(aimed))
        else:
            arcs[0, x] = (0, x, 0.0)
    for number in range(len(KINDS)):
        arcs[0, -1 - number] = (0, -1 - number, 0.0)
    return Transducer(arcs)


def machines() -> tuple[list[Transducer], list[Transducer]]:
    """Those that read from left to right, and those that then read from right to left, in the order they are composed in."""
    both = (INSULT, THREAT)
    forward = [
        within_reach(NEGATION, NEGATED, NEGATED_WEIGHT, both),
        reported_speech(REPORTED_WEIGHT),
        within_reach(INTENT, MEANT, 0.0, (THREAT,)),
        within_reach(TARGET, BEFORE, 0.0, both),
    ]
    return forward, [within_reach(TARGET, AFTER, 0.0, both), matched(INSULT, 0), matched(THREAT, 8)]


FORWARD, BACKWARD = (reduce(Transducer.compose, m) for m in machines())


def matches(classes: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The matches of one clause, from its last word to its first: (number of the kind, the term's weight)."""
    marked = [y for y, _ in FORWARD.run([c for c, _ in classes])]
    found = BACKWARD.run(marked[::-1])
    return [(-1 - y, classes[-1 - k][1]) for k, (y, _) in enumerate(found) if y < 0]


class Grammar:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray = FIRST, offset: float = -3.0):
        self.lexicon, self.weights, self.offset = lexicon, weights, offset
        self.keys = None

    def counts(self, text: str) -> np.ndarray:
        """How often, by weight, each kind of match occurs in a text; last, how many chance would give it, if it has any."""
        out, n = np.zeros(len(KINDS) + 1), 0
        for clause in _CLAUSE.split(text.lower()):
            classes = [self.lexicon(w) for w in _WORD.findall(clause)]
            n += len(classes)
            if any(c in (INSULT, THREAT) for c, _ in classes):
                for k, weight in matches(classes):
                    out[k] += weight
        if out.any():
            out[-1] = n * self.lexicon.chance
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((np.log1p(counts) * self.weights).sum(-1) / np.log(2) + self.offset, -30, 30)))

    def suspects(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts have an insult or threat word: only those are walked through.."""
        if self.keys is None:
            words = [w.encode() for w in {*self.lexicon.words, *THREATS}]
            by = defaultdict(list)
            for s in self.lexicon.stems:
                by[len(s.encode())].append(s.encode())
            self.keys = [(0, _hashes(words)), *((n, _hashes(v)) for n, v in sorted(by.items()))]
        found = []
        for i, j in slices(offs):
            hit = self._hit(raw, offs[i : j + 1])
            # bytes split these texts at other places than characters do: their words are parted by spaces first
            other = i + np.flatnonzero(_beyond_latin(raw, offs[i : j + 1]))
            if len(other):
                plain = [_BETWEEN.sub(" ", raw[offs[k] : offs[k + 1]].tobytes().decode(errors="replace").lower()).encode() for k in other.tolist()]
                hit[other - i] = self._hit(np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)]))
            found.append(hit)
        return np.concatenate(found) if found else np.zeros(0, bool)

    def _hit(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        w = Words(raw, offs, NON_ALNUM)
        hit = np.zeros(len(w.hashes) + 1, np.int64)
        for n, keys in self.keys:
            own = w.hashes if n == 0 else w.prefixes(n)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit[1:] |= keys[at] == own
        total = np.cumsum(hit)
        return total[w.at[1:]] > total[w.at[:-1]]


def _beyond_latin(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts have a character that is neither ASCII nor one of the lower-case letters from U+00DF to U+00FF."""
    data = raw[int(offs[0]) : int(offs[-1])]
    high = data >= 0x80
    if not high.any():
        return np.zeros(len(offs) - 1, bool)
    letter = np.zeros(len(data) + 1, bool)
    letter[:-2] = (data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] <= 0xBF) & (data[1:] != 0xB7)
    letter[1:] |= letter[:-1].copy()
    total = np.concatenate([[0], np.cumsum(high & ~letter[:-1])])
    return total[offs[1:] - offs[0]] > total[offs[:-1] - offs[0]]


def _hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    return np.unique(Words(raw, np.array([0, len(raw)]), NON_ALNUM).hashes)


def _distinct(term: np.ndarray, around: np.ndarray, n_terms: int) -> np.ndarray:
    """Number of distinct surroundings of each term."""
    pairs = np.unique(np.stack([term, around], 1), axis=0) if len(term) else np.zeros((0, 2), np.int64)
    return np.bincount(pairs[:, 0], minlength=n_terms)


def learn_lexicon(examples: list[tuple[str, int]]) -> Lexicon:
    """Words and stems whose distinct surroundings tell toxic texts from others.

    Words are numbers from the first; a surrounding is the pair of the neighbours'
    numbers, so that memory is a few numbers for each word of the examples.
    """
    fixed = {w: 1.0 for w in INSULTS}
    number: dict[str, int] = {"": 0}
    term, around, label = [], [], []
    for text, y in examples:
        ids = [number.setdefault(w, len(number)) for w in _WORD.findall(text.lower()) if len(w) > 2]
        padded = np.array([0, *ids, 0], np.int64)
        term.append(padded[1:-1])
        around.append((padded[:-2] << 32) | padded[2:])
        label.append(np.full(len(ids), y, bool))
    term, around, label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, around, label))
    size1, size0 = int((label == 1).sum()), int((label == 0).sum())
    if not size1 or not size0:
        return Lexicon(fixed, {})
    ratio = size1 / size0

    def counted(of_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct surroundings in toxic texts and in others, and the log odds, of terms that words are mapped to (0: none)."""
        mapped = of_word[term]
        bad = _distinct(mapped[(label == 1) & (mapped > 0)], around[(label == 1) & (mapped > 0)], n)
        good = _distinct(mapped[(label == 0) & (mapped > 0)], around[(label == 0) & (mapped > 0)], n)
        return bad, good, np.where(bad >= CONTEXTS, np.log((bad + 0.5) / ratio) - np.log(good + 0.5), -np.inf)

    by_size: dict[int, dict[str, tuple[int, int, float, int]]] = {}
    for n in STEMS:
        stem_of: dict[str, int] = {"": 0}
        of_word = np.array([stem_of.setdefault(w[:n], len(stem_of)) if len(w) > n else 0 for w in number])
        bad, good, odds = counted(of_word, len(stem_of))
        toxic_words = np.unique(term[label == 1])
        kinds = np.bincount(of_word[toxic_words], minlength=len(stem_of))
        by_size[n] = {s: (int(bad[i]), int(good[i]), float(odds[i]), int(kinds[i])) for s, i in stem_of.items() if bad[i] >= CONTEXTS and i}

    def grown(stem: str) -> str:
        n = len(stem) + 1
        longer = [t for t, v in by_size.get(n, {}).items() if t.startswith(stem) and v[0] >= KEEP * by_size[n - 1][stem][0]]
        return grown(longer[0]) if longer else stem

    stems: dict[str, float] = {}
    chance = 0
    for n in STEMS:
        for text, (_, _, odds, kinds) in by_size[n].items():
            if odds >= LOG_ODDS and kinds >= 5 and not any(text.startswith(s) or s.startswith(text) for s in stems):
                stem = grown(text)
                _, good, odds, _ = by_size[len(stem)][stem]
                stems[stem] = min(1.0, odds / FULL)
                chance += good
    _, good, odds = counted(np.arange(len(number)), len(number))
    words = {w: min(1.0, float(odds[i]) / FULL) for w, i in number.items() if i and odds[i] >= LOG_ODDS and not any(w.startswith(s) for s in stems)}
    chance += int(sum(good[number[w]] for w in words))
    return Lexicon(words | fixed, stems, chance / size0)


def fit_grammar(examples: list[tuple[str, int]], pull: float = 2.0, steps: int = 300) -> Grammar:
    """Logistic regression on the matches of the learned lexicon, drawn towards the first weights."""
    grammar = Grammar(learn_lexicon(examples))
    y = np.array([v for _, v in examples], float)
    if len(set(y.tolist())) < 2:
        return grammar
    raw, offs = text_buffers(pa.array([t for t, _ in examples], pa.large_string()))
    x = np.zeros((len(examples), len(FIRST)))
    for k in np.flatnonzero(grammar.suspects(raw, offs)).tolist():
        x[k] = np.log1p(grammar.counts(examples[k][0])) / np.log(2)
    weights, offset = FIRST.copy(), -3.0
    share = len(y) / (2 * np.bincount(y.astype(int), minlength=2))[y.astype(int)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + offset, -30, 30)))
        slope = (p - y) * share
        weights -= 0.5 * (x.T @ slope + pull * (weights - FIRST)) / (len(y) * 0.05 + pull)
        offset -= 0.5 * slope.mean() * 4
    grammar.weights, grammar.offset = weights, float(offset)
    return grammar


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5, left_out: int = 0, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Grammar:
    return fit_grammar(labelled_texts(docs, labels, "toxic", fold, left_out, per_class, max_bytes, seed=8))


def score_toxicity(docs: DataFrame, grammar: Grammar, out: str = "toxicity") -> DataFrame:
    """``docs`` and a struct ``out``: score (probability of being toxic), matches (of each kind that occurs).

    Every row comes back with all its columns (one called ``out`` is replaced). The whole
    text is read. Null and empty texts have no match and get the probability of the offset
    alone. Only the text counts, so equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    names = ["-".join([w, *(n for n, on in zip(("aimed", "negated", "reported"), flags) if on)]) for w, *flags in KINDS]

    def compute():
        own = shared.value

        def function(column):
            counts = np.zeros((len(column), len(FIRST)))
            for k in np.flatnonzero(own.suspects(*text_buffers(column))).tolist():
                counts[k] = own.counts(column[k].as_py())
            kinds = [[names[k] for k in np.flatnonzero(c[:-1]).tolist()] if c.any() else [] for c in counts]
            return [pa.array(own.score(counts)), pa.array(kinds, pa.list_(pa.string()))]

        return function

    return annotate(docs, out, "score: double, matches: array<string>", compute)
