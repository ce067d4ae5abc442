"""Language of a text by prediction by partial matching.

Per language, a tree of byte contexts up to ``ORDER`` bytes long holds what followed each
context and how often. A byte's probability is its share under its longest context seen;
a byte not seen there costs an escape to the next shorter context (an escape weighs as
many counts as the context has different followers, method C). The statistics are
frozen after learning, so the code length of a byte depends on it and the ORDER bytes
before it alone: the lengths of all strings seen are tabled for all languages at once,
and a text's exact code length is a sum of table entries. The shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import LOWER, annotate, mix, remainder, sample_by_class, slices, text_buffers

ORDER = 4
#: Learned from at most so many texts of each language, of at most so many bytes.
PER_CLASS, MAX_BYTES = 500, 8_000
UNKNOWN = "und"
#: Letters by their Unicode categories; numerals such as ½ and ① are none.
_LETTER = regex.compile(r"\p{L}")


class Table:
    """Rows by 64-bit key, by open addressing: vectorised insertion and lookup."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(len(keys) * 2.5 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 1
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = free[first]
            self.keys[slot[won]] = keys[left[won]]
            self.rows[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((at != keys) & (at != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.rows[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out


class Model:
    """``langs`` and, for strings of 1 to ORDER + 1 bytes, the code length in bits of the last byte after the others, and of an escape after the whole string."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        many = len(self.langs)
        data = {k: b"".join(b" " * order + t for t in v) for k, v in texts.items()}
        strings = {k: np.frombuffer(v, np.uint8).astype(np.int64) for k, v in data.items()}
        counts = []  # by length - 1: by language: (sorted strings, how often)
        for n in range(1, order + 2):
            counts.append([np.unique(_strings(strings[k], n), return_counts=True) for k in self.langs])
        self.keys, self.cost, self.escape = [], [], []
        below = np.full((1, many), 8.0)
        for n in range(1, order + 2):
            keys = np.unique(np.concatenate([c[0] for c in counts[n - 1]] or [np.zeros(0, np.int64)]))
            if n == 1:
                shorter = np.tile(below, (len(keys), 1))
            else:
                shorter = self.cost[-1][np.searchsorted(self.keys[-1], keys & ((1 << 8 * (n - 1)) - 1))].copy()
            cost = shorter.copy()
            rows = np.zeros((len(self.keys[-1]) if n > 1 else 1, many))
            for i in range(many):
                seen, times = counts[n - 1][i]
                context = seen >> 8
                own, first = np.unique(context, return_index=True)
                total, kinds = np.add.reduceat(times, first) if len(first) else times, np.diff([*first, len(seen)])
                if n == 1:
                    place = np.zeros(len(own), np.int64)
                    of_key = np.zeros(len(keys), np.int64)
                else:
                    place = np.searchsorted(self.keys[-1], own)
                    of_key = np.searchsorted(self.keys[-1], keys >> 8)
                rows[place, i] = np.log2((total + kinds) / kinds)
                cost[:, i] += rows[of_key, i]  # not seen here, though the context is: escape and go on
                at = np.searchsorted(keys, seen)
                which = np.searchsorted(own, context)
                cost[at, i] = np.log2((total + kinds)[which] / times)
            if n == 1:
                self.start = rows[0]
            else:
                self.escape.append(rows.astype(np.float32))
            self.keys.append(keys)
            self.cost.append(cost.astype(np.float32))
        self.tables = None

    def bits(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        if self.tables is None:
            self.tables = [Table(k) for k in self.keys]
        n = len(offs) - 1
        out = np.zeros((n, len(self.langs)))
        for i, j in slices(offs, 1 << 17):
            ends = offs[i + 1 : j + 1] - offs[i] + self.order * np.arange(1, j - i + 1)
            data = np.full(int(ends[-1]), 0x20, np.int64)
            for k, e in enumerate(ends.tolist()):
                s, t = int(offs[i + k]), int(offs[i + k + 1])
                data[e - (t - s) : e] = LOWER[raw[s:t]]
            spread = self._each(data)
            size = offs[i + 1 : j + 1] - offs[i:j]
            full = np.flatnonzero(size)  # each text is summed by itself, so its length doesn't depend on its neighbours
            if len(full):
                edges = np.stack([ends[full] - size[full], ends[full]], 1).ravel()
                out[i + full] = np.add.reduceat(np.concatenate([spread, spread[:1]]).astype(np.float64), edges, axis=0)[::2]
        return out

    def _each(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte, the first ``order`` bytes left at zero."""
        full = _strings(data, self.order + 1)
        out = np.zeros((len(data), len(self.langs)), np.float32)
        at = np.arange(self.order, len(data))
        key = full
        for n in range(self.order + 1, 0, -1):
            row = self.tables[n - 1].find(key)
            hit = row >= 0
            if n == self.order + 1:
                out[at] = np.take(self.cost[n - 1], np.where(hit, row, 0), axis=0, mode="clip") * hit[:, None] if len(self.keys[n - 1]) else 0
            else:
                out[at[hit]] += self.cost[n - 1][row[hit]]
            at, key = at[~hit], key[~hit]
            if not len(at):
                break
            if n > 1:
                context = self.tables[n - 2].find(key >> 8)
                known = context >= 0
                out[at[known]] += self.escape[n - 2][context[known]]
                key = key & ((1 << 8 * (n - 1)) - 1)
            else:
                out[at] += (self.start + 8.0).astype(np.float32)
        return out


def _strings(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that begin at each place as one number, first byte highest."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    out = np.zeros(len(data) - n + 1, np.int64)
    for k in range(n):
        out = (out << 8) | data[k : k + len(out)]
    return out


def fit(docs: DataFrame, fold: int = 4, left_out: int = 2, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, order: int = ORDER) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows whose fold isn't ``left_out``: at most ``per_class`` texts of each language, of at most ``max_bytes`` each."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder(fold) != left_out))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("text"))
    chosen = sample_by_class(rows.select("doc_id", "_lang"), "_lang", per_class, seed=4)
    wanted = chosen.select("doc_id", "_lang", "_hash")
    found = rows.where(F.octet_length("text") <= max_bytes).join(F.broadcast(wanted.distinct()), ["doc_id", "_lang"]).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r["_hash"], r["doc_id"], r["text"])):
        if len(texts.setdefault(r["_lang"], [])) < per_class:
            texts[r["_lang"]].append(LOWER[np.frombuffer(r["text"].encode(), np.uint8)].tobytes())
    return Model(texts, order)


def identify_language(docs: DataFrame, model: Model, out: str = "language") -> DataFrame:
    """``docs`` and a struct ``out``: lang, score (the winner's posterior under equal priors, 0 for ``und``).

    A text that is null or has no letter, and every text if nothing was learned, is
    ``und``. Equal code lengths go to the first language by name. All bytes are read, A-Z
    lower-cased. Every row comes back with all its columns (one called ``out`` is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        own = shared.value

        def function(column):
            lettered = np.array([bool(t and _LETTER.search(t)) for t in (x.as_py() for x in column)], bool)
            if not own.langs:
                return [pa.array([UNKNOWN] * len(column), pa.string()), pa.array(np.zeros(len(column)))]
            raw, offs = text_buffers(column)
            bits = own.bits(raw, offs)
            best = bits.argmin(1)
            more = bits - bits.min(1)[:, None]
            score = np.where(lettered, 1 / np.exp2(-np.minimum(more, 1000)).sum(1), 0.0)
            return [pa.array([own.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], pa.string()), pa.array(score)]

        return function

    return annotate(docs, out, "lang: string, score: double", compute)
