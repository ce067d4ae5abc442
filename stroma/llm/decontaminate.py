"""Benchmark passages in documents, by a prefix-filtered set join of word windows.

A window of an item is the set of its word shingles with their places. Shingles are
ordered by rarity in the documents; as all of a window's shingles must be present, its
prefix is the rarest one. A document is joined with the windows whose prefix it has;
the prefix's place gives where the window would lie, which must be within the document;
the words there are looked up among the distinct windows of that size and compared one by
one. Equal windows are one, with a list of items, so a text of one repeated word costs no
more than another.

Items up to a counted size are held as flat arrays in a broadcast; more are joined by a
shuffle on the prefix. Either way the documents are read twice: once for the rarity of
shingles, in a table of fixed size, once for the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.llm.shared import LOWER, NON_ALNUM, Words, annotate, materialise, shingles, shingles_at, ship_package, slices, text_buffers

WINDOW, SHINGLE = 13, 4
#: Items of at most so many bytes are broadcast (about eight times as many bytes of arrays); more are joined by a shuffle.
BROADCAST_BYTES = 4 << 20
#: A document is contaminated if at least one of so many of its words is hit.
ONE_OF = 20
#: Shingles are counted in this many cells (a power of two), by their highest bits: the order of rarity needs no more.
CELL_BITS = 18
#: Tasks that share a token's places where items are joined by a shuffle.
SALTS = 8
#: Bits of the map that turns away shingles which are no window's prefix, at most.
FILTER_BITS = 26

FIELDS = "n_words: bigint, n_hit: bigint, item_ids: array<string>, spans: array<struct<first: bigint, past: bigint>>"


def canonical(raw: np.ndarray, found: Words, first: int, past: int) -> bytes:
    """The lower-cased words from ``first`` to ``past``, joined by spaces."""
    data = LOWER[raw[int(found.starts[first]) : int(found.ends[past - 1])]].tobytes() if past > first else b""
    base = int(found.starts[first]) if past > first else 0
    return b" ".join(data[s - base : e - base] for s, e in zip(found.starts[first:past].tolist(), found.ends[first:past].tolist()))


def rarity(docs: DataFrame, shingle: int) -> np.ndarray:
    """How often shingles of each cell occur in the documents. A task sends one row a cell, and the driver gets as many."""

    def run(batches):
        count = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            raw, offs = text_buffers(batch.column(0))
            for i, j in slices(offs):
                found = Words(raw, offs[i : j + 1], NON_ALNUM)
                grams = shingles(found.hashes, shingle)
                # shingles over two texts are counted, too: that changes the order a little and no result
                count += np.bincount((grams >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(some), "n": pa.array(count[some])})

    out = np.zeros(1 << CELL_BITS, np.int64)
    for r in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


class Windows:
    """The windows of some items, in flat arrays: where each begins among the items' words, its size, its item, its prefix and that one's place."""

    def __init__(self, texts: pa.Array, window: int, shingle: int, frequency: np.ndarray):
        raw, offs = text_buffers(texts)
        found = Words(raw, offs, NON_ALNUM)
        raw = raw[int(offs[0]) :]
        self.hashes, at = found.hashes, found.at
        many = at[1:] - at[:-1]
        size = np.minimum(many, window)
        windows = np.where(many > 0, many - size + 1, 0)
        self.item = np.repeat(np.arange(len(many)), windows)
        self.start = at[:-1][self.item] + np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.size = size[self.item]
        self.grams = np.minimum(self.size, shingle)
        self.prefix, self.shift = np.zeros(len(self.item), np.uint64), np.zeros(len(self.item), np.int64)
        for n in np.unique(self.grams).tolist():
            gram = shingles(self.hashes, n)
            # rarest first; of equals the smallest, so that neighbouring windows share theirs
            key = (np.minimum(frequency[(gram >> np.uint64(64 - CELL_BITS)).astype(np.int64)], (1 << 30) - 1).astype(np.uint64) << np.uint64(32)) | (gram >> np.uint64(32))
            mine = np.flatnonzero(self.grams == n)
            best = np.full(len(mine), np.iinfo(np.uint64).max, np.uint64)
            for o in range(int(self.size[mine].max()) - n + 1):
                inside = self.size[mine] - n >= o
                own = key[np.where(inside, self.start[mine] + o, 0)]
                less = inside & (own < best)
                best[less], self.shift[mine[less]] = own[less], o
            self.prefix[mine] = gram[self.start[mine] + self.shift[mine]]
        self._raw, self._found = raw, found

    def text(self, k: int) -> bytes:
        return canonical(self._raw, self._found, int(self.start[k]), int(self.start[k] + self.size[k]))

    def vocabulary(self) -> tuple[dict[int, bytes], set[int]]:
        """The bytes of each word by its hash, and the hashes that different words share."""
        _, first = np.unique(self.hashes, return_index=True)
        out = {int(self.hashes[k]): canonical(self._raw, self._found, int(k), int(k) + 1) for k in first.tolist()}
        data, shared = LOWER[self._raw], set()
        for h, s, e in zip(self.hashes.tolist(), self._found.starts.tolist(), self._found.ends.tolist()):
            if out[h] != data[s:e].tobytes():
                shared.add(h)
        return out, shared

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One window of each words, sorted by size and hash; that hash; and (number of that window, item) of all items that have it."""
        hashed = np.zeros(len(self.item), np.uint64)
        for n in np.unique(self.size).tolist():
            mine = np.flatnonzero(self.size == n)
            hashed[mine] = shingles_at(self.hashes, self.start[mine], n)
        order = np.lexsort((hashed, self.size))
        size, start = self.size[order], self.start[order]
        same = np.zeros(len(order), bool)
        same[1:] = (size[1:] == size[:-1]) & (hashed[order][1:] == hashed[order][:-1])
        for o in range(int(size.max()) if len(size) else 0):  # word by word with the one before
            asked = np.flatnonzero(same & (size > o))
            same[asked] = self.hashes[start[asked] + o] == self.hashes[start[asked - 1] + o]
        first = order[~same]
        pairs = np.unique(np.stack([np.cumsum(~same) - 1, self.item[order]], 1), axis=0)
        return first, hashed[first], pairs


def prefix_map(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[(tokens >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


class Index:
    """What a task needs of broadcast items: the distinct windows, their items, and for each prefix at which places of which sizes it stands in some window."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int, frequency: np.ndarray):
        w = Windows(pa.array([t for _, t in items], pa.large_string()), window, shingle, frequency)
        self.ids = [i for i, _ in items]
        self.hashes = w.hashes
        self.vocabulary, unsure = w.vocabulary()
        first, hashed, pairs = w.distinct()
        self.start, self.size = w.start[first].astype(np.int64), w.size[first].astype(np.int64)
        self.item, self.items_at = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.windows = {}
        for n in np.unique(self.size).tolist():
            lo, hi = np.searchsorted(self.size, [n, n + 1])
            self.windows[n] = (hashed[lo:hi], int(lo))
        #: The bytes of windows with a word whose hash another word shares.
        self.exact = {k: w.text(int(f)) for k, f in enumerate(first.tolist()) if unsure & set(w.hashes[w.start[f] : w.start[f] + w.size[f]].tolist())} if unsure else {}
        for h in unsure:
            del self.vocabulary[h]
        self.by = {}
        grams, prefix, shift = w.grams[first], w.prefix[first], w.shift[first].astype(np.int64)
        for n in np.unique(grams).tolist():
            mine = np.flatnonzero(grams == n)
            mine = mine[np.lexsort((self.size[mine], shift[mine], prefix[mine]))]
            p, s, z = prefix[mine], shift[mine], self.size[mine]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1]) | (z[1:] != z[:-1])])
            tokens, at = np.unique(p[new], return_index=True)
            self.by[n] = (tokens, np.append(at, int(new.sum())), s[new], z[new])

    def maps(self) -> dict[int, np.ndarray]:
        return {n: prefix_map(t, min(FILTER_BITS, max(12, int(np.ceil(np.log2(16 * len(t) + 1)))))) for n, (t, *_) in self.by.items()}


def _matcher(index: Index):
    def compute():
        maps = index.maps()

        def function(column):
            raw, offs = text_buffers(column)
            n_words, n_hit, items, spans = [], [], [], []
            for i, j in slices(offs):
                found = Words(raw, offs[i : j + 1], NON_ALNUM)
                data, hashes, at = raw[int(offs[i]) :], found.hashes, found.at
                starts, wins, docs = [], [], []
                for n, (tokens, first, shifts, sizes) in index.by.items():
                    grams = shingles(hashes, n)
                    spot = np.flatnonzero(maps[n][(grams >> np.uint64(64 - maps[n].size.bit_length() + 1)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(tokens, grams[spot]), len(tokens) - 1)
                    same = tokens[place] == grams[spot]
                    spot, place = spot[same], place[same]
                    many = first[place + 1] - first[place]
                    for lo, hi in _portions(many):
                        m = many[lo:hi]
                        where = np.repeat(spot[lo:hi], m)
                        way = np.arange(len(where)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[place[lo:hi]], m)
                        doc = np.searchsorted(at, where, "right") - 1
                        start, size = where - shifts[way], sizes[way]
                        ok = (start >= at[doc]) & (start + size <= at[doc + 1])
                        for start, win, doc in _looked_up(index, hashes, start[ok], size[ok], doc[ok]):
                            starts.append(start)
                            wins.append(win)
                            docs.append(doc)
                n_words.append(at[1:] - at[:-1])
                own, places = [[] for _ in range(j - i)], [[] for _ in range(j - i)]
                if sum(map(len, starts)):
                    start, win, doc = map(np.concatenate, (starts, wins, docs))
                    hit = _covered(len(hashes), start, index.size[win])
                    if index.exact:
                        ok = np.array([k not in index.exact or canonical(data, found, s, s + z) == index.exact[k] for s, k, z in zip(start.tolist(), win.tolist(), index.size[win].tolist())])
                        start, win, doc = start[ok], win[ok], doc[ok]
                    wrong = [p for p in np.flatnonzero(hit).tolist() if (known := index.vocabulary.get(int(hashes[p]))) is not None and LOWER[data[found.starts[p] : found.ends[p]]].tobytes() != known]
                    if wrong:  # words of equal hashes that aren't equal: their windows don't count
                        before = np.concatenate([[0], np.cumsum(np.bincount(wrong, minlength=len(hashes)))])
                        ok = before[start + index.size[win]] == before[start]
                        start, win, doc = start[ok], win[ok], doc[ok]
                    hit = _covered(len(hashes), start, index.size[win])
                    total = np.concatenate([[0], np.cumsum(hit)])
                    n_hit.append(total[at[1:]] - total[at[:-1]])
                    pairs = np.unique(np.stack([doc, win], 1), axis=0)
                    for d, cut in zip(*_groups(pairs[:, 0])):
                        own[d] = sorted({index.ids[k] for x in pairs[cut, 1].tolist() for k in index.item[index.items_at[x] : index.items_at[x + 1]].tolist()})
                        edge = np.diff(np.concatenate([[0], hit[at[d] : at[d + 1]].astype(np.int8), [0]]))
                        places[d] = [{"first": a, "past": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
                else:
                    n_hit.append(np.zeros(j - i, np.int64))
                items += own
                spans += places
            whole = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            spot = pa.struct([("first", pa.int64()), ("past", pa.int64())])
            return [whole(n_words), whole(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(spot))]

        return function

    return compute


def _looked_up(index: Index, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray):
    """(start, window, text) of the candidates at ``start`` whose words are a window's: found by the hash of all words, then compared word by word."""
    for n in np.unique(size).tolist():
        mine = np.flatnonzero(size == n)
        s, d = start[mine], doc[mine]
        keys, base = index.windows[n]
        h = shingles_at(hashes, s, n)
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        m = hi - lo
        win = base + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
        s, d = np.repeat(s, m), np.repeat(d, m)
        for o in range(n):
            ok = hashes[s + o] == index.hashes[index.start[win] + o]
            s, win, d = s[ok], win[ok], d[ok]
        yield s, win, d


def _portions(many: np.ndarray, limit: int = 1 << 18):
    """Ranges of candidates with about ``limit`` windows each."""
    total = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def _covered(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + size, -1)
    return np.cumsum(change[:-1]) > 0


def _groups(sorted_keys: np.ndarray):
    """(keys, slices) of runs of equal keys."""
    keys, first = np.unique(sorted_keys, return_index=True)
    return keys.tolist(), [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sorted_keys)])]


# --- items too large for a broadcast ----------------------------------------


def _window_rows(window: int, shingle: int, frequency):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            _, offs = text_buffers(batch.column(1))
            for i, j in slices(offs):
                w = Windows(batch.column(1).slice(i, j - i), window, shingle, frequency.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.prefix.view(np.int64)), pa.array(w.grams.astype(np.int32)), pa.array(w.shift.astype(np.int32)), pa.array(w.size.astype(np.int32)), pa.array([ids[i + k] for k in w.item.tolist()], pa.string()), pa.array([w.text(k).decode(errors="replace") for k in range(len(w.item))], pa.string())],
                    ["token", "grams", "shift", "size", "item_id", "words"],
                )

    return run


def _chunked_map(bits: int, chunk: int = 1 << 16):
    """The prefixes' map of a partition, in the chunks that have any: bounded rows a task, united by chunk."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for c, cut in zip(*_groups(np.sort(at) // chunk)):
                found.setdefault(c, np.zeros(min(chunk, 1 << bits), bool))[np.sort(at)[cut] % chunk] = True
        for c, bitmap in found.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int64()), "bits": pa.array([np.packbits(bitmap).tobytes()], pa.binary())})

    return run


def _candidate_rows(window: int, sizes: list[int], shared_map, bits: int):
    """(text's keys, token, grams, place, words before, the words around) of every place whose shingle may be a prefix."""

    def run(batches):
        packed = shared_map.value
        for batch in batches:
            key, crc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offs = text_buffers(batch.column(2))
            for i, j in slices(offs):
                found = Words(raw, offs[i : j + 1], NON_ALNUM)
                data, at = raw[int(offs[i]) :], found.at
                for n in sizes:
                    grams = shingles(found.hashes, n)
                    cell = (grams >> np.uint64(64 - bits)).astype(np.int64)
                    spot = np.flatnonzero((packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1)
                    doc = np.searchsorted(at, spot, "right") - 1
                    ok = spot + n <= at[doc + 1]
                    spot, doc = spot[ok], doc[ok]
                    lo, hi = np.maximum(at[doc], spot - window + 1), np.minimum(at[doc + 1], spot + window)
                    around = [canonical(data, found, a, b).decode(errors="replace") for a, b in zip(lo.tolist(), hi.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[i + doc]), pa.array(crc[i + doc]), pa.array(grams[spot].view(np.int64)), pa.array(np.full(len(spot), n, np.int32)), pa.array((spot - at[doc]).astype(np.int64)), pa.array((spot - lo).astype(np.int32)), pa.array(around, pa.string())],
                        ["key", "crc", "token", "grams", "place", "before", "around"],
                    )

    return run


def _joined(docs: DataFrame, items: DataFrame, out: str, window: int, shingle: int) -> DataFrame:
    spark = docs.sparkSession
    frequency = spark.sparkContext.broadcast(rarity(docs, shingle))
    windows = materialise(items.mapInArrow(_window_rows(window, shingle, frequency), "token long, grams int, shift int, size int, item_id string, words string"), "passages-windows")
    bits = min(FILTER_BITS, max(12, (16 * windows.count()).bit_length()))
    chunks = windows.select("token").mapInArrow(_chunked_map(bits), "chunk long, bits binary")

    def united(pdf):
        return pdf.head(1).assign(bits=np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes())

    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for r in chunks.groupBy("chunk").applyInPandas(united, "chunk long, bits binary").collect():  # at most 2 ** (bits - 3) bytes
        part = np.frombuffer(r["bits"], np.uint8)
        bitmap[r["chunk"] * len(part) : (r["chunk"] + 1) * len(part)] = part
    sizes = [r["grams"] for r in windows.select("grams").distinct().collect()]  # at most ``shingle`` rows
    text = F.col("text").cast("string")
    keyed = docs.where(F.col("text").isNotNull()).select(F.xxhash64(text).alias("key"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))
    places = keyed.mapInArrow(_candidate_rows(window, sizes, spark.sparkContext.broadcast(bitmap), bits), "key long, crc long, token long, grams int, place long, before int, around string")
    # equal windows are one, whoever's they are; a token's places are dealt to several tasks, each with the token's windows
    numbered = windows.groupBy("token", "grams", "shift", "size", "words").agg(F.array_sort(F.collect_set("item_id")).alias("_ids"))
    numbered = materialise(numbered.withColumn("win", F.monotonically_increasing_id()), "passages-distinct")
    dealt = numbered.drop("_ids").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = places.withColumn("_salt", F.pmod(F.xxhash64("key", "place"), F.lit(SALTS)).cast("int")).join(dealt, ["token", "grams", "_salt"]).where("before >= shift")
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("shift") + 1, F.col("size")), " ") == F.col("words")
    first = F.col("place") - F.col("shift")
    hits = materialise(both.where(same).select("key", "crc", first.alias("first"), (first + F.col("size")).alias("past"), "win").distinct(), "passages-hits")
    ids = hits.select("key", "crc", "win").distinct().join(numbered.select("win", F.explode("_ids").alias("item_id")), "win").groupBy("key", "crc").agg(F.array_sort(F.collect_set("item_id")).alias("_ids"))
    found = ids.join(united_spans(hits), ["key", "crc"]).select("key", "crc", "_ids", "_spans")
    found = materialise(found, "passages-found").toDF("_key", "_crc", "_ids", "_spans")

    def compute():
        def function(column):
            raw, offs = text_buffers(column)
            at = [Words(raw, offs[i : j + 1], NON_ALNUM).at for i, j in slices(offs)]
            return [pa.array(np.concatenate([a[1:] - a[:-1] for a in at]) if at else [], pa.int64())]

        return function

    counted = annotate(docs, out, "n_words: bigint", compute)
    joined = counted.join(found, (F.xxhash64(counted["text"].cast("string")) == found["_key"]) & (F.crc32(counted["text"].cast("string").cast("binary")) == found["_crc"]), "left")
    zero = F.lit(0).cast("long")
    spans, ids = F.coalesce(found["_spans"], F.array().cast("array<struct<first: bigint, past: bigint>>")), F.coalesce(found["_ids"], F.array().cast("array<string>"))
    struct = F.struct(counted[out]["n_words"].alias("n_words"), F.aggregate(spans, zero, lambda a, x: a + x["past"] - x["first"]).alias("n_hit"), ids.alias("item_ids"), spans.alias("spans"))
    return joined.select(*[counted[c] for c in counted.columns if c != out], struct.alias(out))


def united_spans(hits: DataFrame) -> DataFrame:
    """(key, crc, _spans): each text's spans in order, those that overlap or touch made one, in one walk along them."""
    w = W.partitionBy("key", "crc").orderBy("first", "past")
    reach = F.max("past").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = hits.select("key", "crc", "first", "past").distinct().withColumn("_new", F.when(F.col("first") <= reach, 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(w)).groupBy("key", "crc", "_run").agg(F.min("first").alias("first"), F.max("past").alias("past"))
    return runs.groupBy("key", "crc").agg(F.array_sort(F.collect_list(F.struct("first", "past"))).alias("_spans"))


def find_passages(docs: DataFrame, items: DataFrame, out: str = "passages", window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` and a struct ``out``: n_words, n_hit, item_ids (sorted), spans of hit words [first, past).

    Words and windows are as in the module's description: A-Z lower-cased, ASCII other than
    letters and digits separates, an item shorter than the window is one window, one without
    words none. Every row of ``docs`` comes back once with all its columns (one called
    ``out`` is replaced). Null or empty texts have no words. Items of null id or text are
    left out; rows of one item_id count as one item; equal windows of several items hit
    for each. Without items nothing is hit.
    """
    ship_package(docs.sparkSession)
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > broadcast_bytes:
        return _joined(docs, items, out, window, shingle)
    held = sorted((r["item_id"], r["text"]) for r in items.collect())
    frequency = rarity(docs, shingle) if held else np.zeros(1 << CELL_BITS, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(Index(held, window, shingle, frequency))
    return annotate(docs, out, FIELDS, lambda: _matcher(shared.value)())


def contaminated(passages: str = "passages", one_of: int = ONE_OF) -> Column:
    n_hit, n_words = F.col(passages)["n_hit"], F.col(passages)["n_words"]
    return (n_hit > 0) & (n_hit * one_of >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, one_of: int = ONE_OF) -> DataFrame:
    """``docs`` without the contaminated rows, in the columns it came with."""
    name = "_passages"
    while name in docs.columns:
        name += "_"
    return find_passages(docs, items, name).where(~contaminated(name, one_of)).drop(name)
