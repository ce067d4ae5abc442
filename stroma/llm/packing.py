"""Packing tokenised documents into fixed windows by non-negative least squares.

A document gives full pieces of ``window`` ids and a rest. Only the histogram of the
rests' lengths, at most ``window`` numbers, reaches the driver. There, shallow
combinations of lengths that fill a window are enumerated, their repeat counts are
solved for against the histogram by non-negative least squares, rounded to what the
histogram allows, and the residual lengths are packed greedily. The plan says which
ranks of each length go where; documents are ranked within their length without a
task per length, and look their place up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import gapless_rank, materialise, ship_package, tidy

WINDOW, END = 2048, 1
#: Lengths that triples are built from besides the first: the most frequent ones.
COMMON = 24
#: Pieces of text whose ids a task remembers.
CACHE = 300_000


class Encoder:
    """Token ids of a text, piece by piece.

    The tokenizer never joins what white space separates, so a text's ids are those of
    its pieces between spaces and line ends, one after another; a task keeps the ids of
    the pieces it has met. New pieces of Latin-1 characters are split by the tokenizer's
    own pattern and encoded together by ``tiktoken``, which merges the same vocabulary
    faster: its word end is written as one byte that such pieces don't contain. All
    other pieces go to the tokenizer itself, as do, whole, the texts that contain one of
    the file's added tokens.
    """

    STOP = "\x01"
    #: The vocabulary file's own pattern (a fixed value).
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        self.added = [t["content"] for t in file.get("added_tokens", ())]
        shown = _shown_bytes()
        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            body, stop = (token[:-4], self.STOP) if token.endswith("</w>") and len(token) > 4 else (token, "")
            raw = bytes(shown[c] for c in body)
            if self.STOP.encode() not in raw:
                ranks[raw + stop.encode()] = i
        free = max(ranks.values()) + 1000
        ranks[self.STOP.encode()] = free  # always merged: no rank of a byte and its word end is higher than a word's
        self.fast = tiktoken.Encoding("pieces", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.stops = np.zeros(free + 1, bool)
        self.stops[[i for t, i in ranks.items() if t.endswith(self.STOP.encode())]] = True
        self.split = regex.compile(self.WORD).findall
        self.plain = regex.compile(r"[!-~\xa1-\xff]+").fullmatch
        self.known: dict[str, bytes] = {"": b""}

    def _learn(self, pieces: list[str]) -> None:
        fast, counts, text = [], [], []
        for p in pieces:
            if p.isascii() and p.isalpha():
                text.append(p)
                counts.append(1)
            elif self.plain(p):
                found = self.split(p.lower())
                text += found
                counts.append(len(found))
            else:
                self.known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            fast.append(p)
        if not fast:
            return
        joined = (self.STOP + " ").join(text).lower() + self.STOP
        ids = np.array(self.fast.encode_ordinary(joined), "<u4")
        ends = np.flatnonzero(self.stops[ids]) + 1
        assert len(ends) == len(text)
        to = (4 * np.concatenate([[0], ends])[np.cumsum(counts)]).tolist()
        raw, at = ids.tobytes(), 0
        for p, end in zip(fast, to):
            self.known[p] = raw[at:end]
            at = end

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian 32-bit words."""
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = text.replace("\n", " ").split(" ")
        try:
            return b"".join([self.known[p] for p in pieces])
        except KeyError:
            if len(self.known) > CACHE:
                self.known = {"": b""}
            self._learn([p for p in dict.fromkeys(pieces) if p not in self.known])
            return b"".join([self.known[p] for p in pieces])


def _shown_bytes() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies show it as: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


PIECES = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(tokenizer: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        encode, last = Encoder(tokenizer), np.array([end], "<u4").tobytes()
        tidy()  # the vocabulary's file, read whole
        for batch in batches:
            doc, total, start, length, crc = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                for s in range(0, n, window):
                    e = min(s + window, n)
                    doc.append(d)
                    total.append(n)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, total, start, length, crc)], schema=PIECES)

    return run


# --- the plan, from the histogram alone ------------------------------------


def combinations(counts: np.ndarray, window: int, common: int = COMMON) -> list[tuple[int, ...]]:
    """Combinations of up to four present lengths that sum to the window: all pairs, and triples and quadruples that take their middle lengths from the most frequent."""
    present = [int(x) for x in np.flatnonzero(counts[:window])]
    there = set(present)
    often = sorted(sorted(present, key=lambda x: (-counts[x], x))[:common])
    found = {tuple(sorted((a, window - a))) for a in present if window - a in there}
    for a in present:
        for b in often:
            if window - a - b in there:
                found.add(tuple(sorted((a, b, window - a - b))))
    for x, b in enumerate(often):
        for c in often[x:]:
            for a in often:
                if window - a - b - c in there:
                    found.add(tuple(sorted((a, b, c, window - a - b - c))))
    return sorted(found)


def repeat_counts(columns: list[tuple[int, ...]], counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x minimising |A x - h|^2, where A counts each length in each combination: multiplicative updates."""
    at = np.array([i for i, c in enumerate(columns) for _ in c])
    length = np.array([x for c in columns for x in c])
    h = counts.astype(float)
    up = np.bincount(at, h[length], len(columns))
    x = np.full(len(columns), max(1.0, h.sum() / max(1, len(at))))
    for _ in range(steps):
        used = np.bincount(length, x[at], len(h))
        x *= up / np.maximum(np.bincount(at, used[length], len(columns)), 1e-12)
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, repeats) that use up the histogram ``counts`` (index: length) exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    columns = combinations(left, window)
    if columns:
        x = repeat_counts(columns, left)
        for i in np.argsort(-x, kind="stable").tolist():
            need = Counter(columns[i])
            n = min(int(round(x[i])), *(int(left[k]) // v for k, v in need.items()))
            if n > 0:
                out.append((columns[i], n))
                for k, v in need.items():
                    left[k] -= n * v
    while True:  # greedy: the longest first, then what fits best
        present = np.flatnonzero(left)
        if not len(present):
            return out
        room, chosen, use = window, [], left.copy()
        while True:
            k = int(np.searchsorted(present, room, "right")) - 1
            while k >= 0 and not use[present[k]]:
                k -= 1
            if k < 0:
                break
            x = int(present[k])
            if chosen and room - x:  # two that fill the room exactly are better than the longest
                pair = next((a for a in present[: np.searchsorted(present, room)].tolist() if use[a] and use[room - a] and (a != room - a or use[a] > 1)), None)
                x = int(pair) if pair else x
            chosen.append(x)
            use[x] -= 1
            room -= x
        need = Counter(chosen)
        n = min(int(left[k]) // v for k, v in need.items())
        out.append((tuple(chosen), n))
        for k, v in need.items():
            left[k] -= n * v


def places(planned: list[tuple[tuple[int, ...], int]], window: int) -> dict[str, np.ndarray]:
    """For each length and run of ranks: the first sequence, the step in ranks from one sequence to the next is 1, and the offset."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for lengths, repeats in planned:
        offset = 0
        for x in lengths:
            rows.append((x, ranks[x], sequence, offset))
            ranks[x] += repeats
            offset += x
        sequence += repeats
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": table[:, 0] * (1 << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are the tokenizer's without special tokens, then ``end``; null text counts as
    empty, so every document has a piece. A piece is ``window`` ids or a document's rest.
    Rows of one doc_id are packed each for itself; a null doc_id stays null. An empty
    table gives no pieces. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(_cut(tokenizer, window, end), "doc_id long, doc_tokens long, start long, length long, ids_crc32 long")
    pieces = materialise(pieces, "packing-pieces")
    counts = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most one row for each length up to the window
        counts[r["length"]] = r["count"]
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts, window), window))
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(p["key"], length * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(p["sequence"][k] + rank - p["rank"][k]), pa.array(p["offset"][k])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
