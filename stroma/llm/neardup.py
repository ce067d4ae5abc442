"""MinHash near-duplicates with odd sketches.

Each document's distinct word shingles give ``bands * rows`` MinHash samples. Equal
samples within a band make candidates. A candidate has two thousand samples more, folded
into a parity bitmap (odd sketch), which estimates a pair's similarity from the
population count of the XOR to about one hundredth; what passes is confirmed on the full
shingle sets.

Only components are wanted, so a large bucket isn't compared pair by pair. First some
pivots of each bucket, members drawn by a hash, are compared with the members of other
components; copies of one text are one component after that. Whatever pairs of different
components are still in a bucket then are all compared, on their sketches alone, in
blocks. Texts are read for pairs that pass their sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import SPACES, materialise, mix, shingles, ship_package, slices, text_buffers, words
from stroma.operators.components import connected_components

SHINGLE = 5
#: A pair at the threshold is missed by every band with probability 1.0e-5.
PERCENT, BANDS, ROWS = 80, 29, 5
#: Samples that a candidate's odd sketch folds, its bits, and how many standard errors an estimate may lie below the threshold.
SAMPLES, BITS, ERRORS = 2048, 4096, 5.5
#: Pivots of a bucket; a bucket of no more members is compared whole.
PIVOTS = 8
#: Rounds of comparisons with pivots, at most; one only if the pairs then left are at most so many a member of a bucket.
ROUNDS, PAIRS_LEFT = 2, 1024
#: Documents of a block of a large bucket, on average.
BLOCK_ROWS = 512
#: A document that is compared with many others has one group for about so many pairs of the whole table.
PAIRS = 64
#: Up to so many rows of ids or sketches are broadcast (16 and 530 bytes each); more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_SKETCHES = 500_000, 30_000

_rng = np.random.default_rng(0x0DD)
_SEEDS = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    hashes, at = words(raw, offs, SPACES)
    grams = shingles(hashes, size)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        n = e - s
        if n >= size:
            out.append(np.unique(grams[s : e - size + 1]))
        elif n:
            out.append(shingles(hashes[s:e], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """MinHash samples of non-empty sets: one row a set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((samples, len(sets)), np.uint64)
    for k in range(samples):
        np.minimum.reduceat(flat * _SEEDS[k], starts, out=out[k])
    return out.T


def odd_sketches(sig: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps: sample i toggles the bit that it and i choose. One row of bits / 8 bytes a signature."""
    n, k = sig.shape
    spot = mix(sig + np.arange(k, dtype=np.uint64) * _SEEDS[-1]) % np.uint64(bits)
    flat = (np.arange(n, dtype=np.int64)[:, None] * bits + spot.astype(np.int64)).ravel()
    odd = np.bincount(flat, minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(bool), axis=1)


def farthest(percent: int, samples: int = SAMPLES, bits: int = BITS, errors: float = ERRORS) -> int:
    """The largest XOR count of two sketches whose estimated similarity is at least the threshold less ``errors`` standard errors.

    Each of k samples that differs toggles two random bits, so the count x has the mean
    bits / 2 * (1 - exp(-4 k (1 - J) / bits)), which solved for J is the estimate. Its
    error is that of a share of k samples.
    """
    j = percent / 100
    low = max(0.0, j - errors * math.sqrt(j * (1 - j) / samples))
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * (1 - low) / bits)))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The hash of each band of the first ``bands * rows`` samples."""
    sig = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _SEEDS[-4]
    for r in range(rows):
        out = mix(out + sig[:, :, r])
    return out


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(_signed(x).ravel()))


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffers(batch.column(2))
            m = len(offs) - 1
            count = np.zeros(m, np.int64)
            one, two, key = np.zeros(m, np.uint64), np.zeros(m, np.uint64), np.zeros((m, bands), np.uint64)
            for i, j in slices(offs):
                sets = shingle_sets(raw, offs[i : j + 1], size)
                count[i:j] = [len(s) for s in sets]
                full = np.flatnonzero(count[i:j])
                if not len(full):
                    continue
                some = [sets[k] for k in full]
                starts = np.cumsum([0, *(len(s) for s in some[:-1])])
                flat = np.concatenate(some)
                one[i + full] = np.add.reduceat(mix(flat + _SEEDS[-2]), starts)
                two[i + full] = np.add.reduceat(mix(flat ^ _SEEDS[-3]), starts)
                key[i + full] = band_keys(signatures(some, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), pa.array(_signed(one)), pa.array(_signed(two)), _listed(key)], schema=_SIGNED)

    return run


def _sketch(size: int, bands: int, rows: int):
    """(node, n_shingles, sketch, keys of the bands) of texts that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            for i, j in slices(offs):
                sets = shingle_sets(raw, offs[i : j + 1], size)
                sig = signatures(sets, max(SAMPLES, bands * rows))
                made = np.ascontiguousarray(odd_sketches(sig[:, :SAMPLES])).view(np.uint64)
                keys = band_keys(sig, bands, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), _listed(made), _listed(keys)], ["node", "n_shingles", "sketch", "keys"])

    return run


def grouped(keys: int, function):
    """Over partitions sorted by the first ``keys`` columns: calls ``function`` with each group's batches, which a group may share with no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                mine = tuple(at[s].tolist())
                if held and mine != key:
                    yield from function(held)
                    held = []
                key = mine
                held.append(batch.slice(s, e - s))
        if held:
            yield from function(held)

    return run


def _pairs(a: list[int], b: list[int], *more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, *more)], ["a", "b", "comp_a", "comp_b", "apart"][: 2 + len(more)])


def _compare(percent: int, most: int):
    """Of one block of a bucket against another: pairs of different components whose sizes and sketches allow a link.

    Side 0 are members outside the bucket's largest component, side 1 all members; a
    pair that stands on both sides is taken once, and one that shares several bands in
    the first of them alone.
    """

    def function(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        node, comp, size = (table.column(c).to_numpy() for c in ("node", "comp", "n_shingles"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        keys, band = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1), table.column("band")[0].as_py()
        side, rest = table.column("side").to_numpy(), table.column("rest").to_numpy(zero_copy_only=False)
        right = np.flatnonzero(side == 1)
        right = right[np.argsort(size[right], kind="stable")]
        sizes = size[right]
        found = []
        for k in np.flatnonzero(side == 0).tolist():
            lo, hi = np.searchsorted(sizes, [-(-size[k] * percent // 100), size[k] * 100 // percent + 1])
            some = right[lo:hi]
            some = some[(comp[some] != comp[k]) & (~rest[some] | (node[some] > node[k]))]
            if len(some):
                some = some[keys[k][(keys[some] == keys[k]).argmax(1)] == band]
                apart = np.bitwise_count(sketch[some] ^ sketch[k]).sum(1)
                near = some[apart <= most]
                if len(near):
                    swap = node[near] < node[k]
                    one, two = np.full(len(near), node[k]), node[near]
                    ca, cb = np.full(len(near), comp[k]), comp[near]
                    found.append([np.where(swap, two, one), np.where(swap, one, two), np.where(swap, cb, ca), np.where(swap, ca, cb), apart[apart <= most].astype(np.int64)])
        if found:
            yield _pairs(*map(np.concatenate, zip(*found)))

    return grouped(3, function)


def _confirm(size: int, percent: int):
    """Of groups of one document (role 0) and others (role 1): the pairs whose full sets are linked. One set and one batch are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in batches:
            raw, offs = text_buffers(batch.column("text"))
            hubs, salts, roles, nodes = (batch.column(c).to_pylist() for c in ("hub", "salt", "role", "node"))
            sets = [s for i, j in slices(offs) for s in shingle_sets(raw, offs[i : j + 1], size)]
            a, b = [], []
            for h, salt, role, node, mine in zip(hubs, salts, roles, nodes, sets):
                if role == 0:
                    if hub != (h, salt):
                        hub, own = (h, salt), []
                    if not any(np.array_equal(mine, x) for x in own):
                        own.append(mine)
                elif hub == (h, salt) and any(linked(x, mine, percent) for x in own):
                    a.append(h)
                    b.append(node)
            yield _pairs(a, b)

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |A & B| >= percent * |A | B| for sorted distinct shingles."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int((b[place] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Search:
    """The state of one search for components: what is linked, and which pairs were confirmed or refuted on full sets."""

    def __init__(self, texts: DataFrame, members: DataFrame, sketches: DataFrame, size: int, percent: int, most: int):
        self.texts, self.members, self.sketches = texts, members, sketches
        self.size, self.percent, self.most = size, percent, most
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.checked: DataFrame | None = None
        self.step = 0

    def named(self, name: str) -> str:
        self.step += 1
        return f"neardup-{self.step}-{name}"

    def current(self) -> DataFrame:
        """(band, size, node, comp) of all members."""
        if self.labels is None:
            return self.members.withColumn("comp", F.col("node"))
        return self.members.join(self.labels.withColumnRenamed("component", "comp"), "node", "left").select("band", "size", "node", F.coalesce("comp", "node").alias("comp"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sizes and sketches allow a link, compared on the JVM. Few different a are broadcast, as one may have very many pairs."""
        asked = materialise(pairs.select("a").distinct().join(self.sketches.drop("keys").withColumnRenamed("node", "a"), "a"), self.named("pivots")).toDF("a", "_na", "_sa")
        both = pairs.join(self.sketches.drop("keys").toDF("b", "_nb", "_sb"), "b").join(F.broadcast(asked) if asked.count() <= BROADCAST_SKETCHES else asked, "a")
        apart = F.aggregate(F.zip_with("_sa", "_sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        fits = 100 * F.least("_na", "_nb") >= self.percent * F.greatest("_na", "_nb")
        return both.where(fits & (apart <= self.most)).select("a", "b")

    def confirm(self, pairs: DataFrame) -> bool:
        """Confirms the pairs (a, b) not looked at before on their full sets, and brings the components up to date. False if there was none."""
        pairs = pairs.select("a", "b", F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["_lo", "_hi"], "left_anti")
        pairs = materialise(pairs, self.named("pairs"))
        many = pairs.count()
        if not many:
            return False
        seen = pairs.select("_lo", "_hi")
        self.checked = seen if self.checked is None else self.checked.unionByName(seen)
        # a document's pairs are dealt into groups of their own, each with a copy of it, so that none is large
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(-(-many // PAIRS))).cast("int"))
        one = salted.select(F.col("a").alias("node"), F.col("a").alias("hub"), "salt", F.lit(0).alias("role")).distinct()
        placed = one.unionByName(salted.select(F.col("b").alias("node"), F.col("a").alias("hub"), "salt", F.lit(1).alias("role")))
        joined = self.texts.join(F.broadcast(placed) if 2 * many <= BROADCAST_IDS else placed, "node").select("hub", "salt", "role", "node", "text")
        dealt = joined.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
        found = materialise(dealt.mapInArrow(_confirm(self.size, self.percent), "a long, b long"), self.named("links"))
        if not found.isEmpty():  # else the components stay as they are
            self.links = found if self.links is None else self.links.unionByName(found)
            self.labels = connected_components(self.links, self.named("components"))
        return True

    def pivots(self, turn: int) -> None:
        """One round: each bucket's pivots against its members of other components. The pivots are the first, by a hash, of as many classes that another hash deals the members into."""
        current = self.current() if turn == 0 else self.current().where(F.col("size") > PIVOTS)
        dealt = F.when(F.col("size") <= PIVOTS, F.col("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS)))
        first = F.min(F.struct(F.xxhash64("node", F.lit(-1 - turn)).alias("_h"), "node", "comp")).alias("_p")
        drawn = current.groupBy("band", dealt.alias("_class")).agg(first, F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
        bands = drawn.groupBy("band").agg(F.collect_list(F.struct("_p.node", "_p.comp")).alias("_pivots"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where("_lo <> _hi")
        asked = current.join(bands.select("band", "_pivots"), "band").select("node", "comp", F.explode("_pivots").alias("_p")).where("comp <> _p.comp")
        # of two pivots the smaller asks; a pivot is what many pairs share, so it stands first
        pairs = asked.select(F.col("_p.node").alias("a"), F.col("node").alias("b")).distinct()
        pairs = pairs.groupBy(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("b"))
        pairs = materialise(pairs, self.named("asked"))
        self.confirm(self.near(pairs))

    def left(self, pivoted: bool) -> tuple[DataFrame, DataFrame, int]:
        """All members, the buckets with pairs of different components still to compare, and how many pairs these are. A bucket of no more members than pivots is done after a round."""
        current = self.current()
        sizes = current.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("_n"))
        top = sizes.groupBy("band").agg(F.max(F.struct("_n", "comp")).alias("_top"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_comps")).where(f"_comps > 1 and _all > {PIVOTS if pivoted else 1}")
        top = materialise(top.select("band", F.col("_top.comp").alias("_most"), (F.col("_all") - F.col("_top._n")).alias("_rest"), "_all"), self.named("left"))
        return current, top, int(top.agg(F.sum(F.col("_rest").cast("double") * F.col("_all"))).first()[0] or 0)

    def rest(self, current: DataFrame, top: DataFrame, many: int) -> None:
        """All pairs of different components that are left in a bucket; at once if at most ``many`` pass their sketches."""
        blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
        top = top.select("band", "_most", blocks(F.col("_rest")).alias("_left"), blocks(F.col("_all")).alias("_right"))
        rows = current.join(top, "band").join(self.sketches, "node").withColumn("rest", F.col("comp") != F.col("_most"))
        columns = ["node", "comp", "n_shingles", "sketch", "keys", "rest"]
        at = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.where("rest").select("band", at(1, "_left").alias("_i"), every("_right").alias("_j"), F.lit(0).alias("side"), *columns)
        right = rows.select("band", every("_left").alias("_i"), at(2, "_right").alias("_j"), F.lit(1).alias("side"), *columns)
        dealt = left.unionByName(right).repartition("band", "_i", "_j").sortWithinPartitions("band", "_i", "_j")
        found = dealt.mapInArrow(_compare(self.percent, self.most), "a long, b long, comp_a long, comp_b long, apart long")
        found = materialise(found.groupBy("a", "b").agg(F.any_value("comp_a").alias("comp_a"), F.any_value("comp_b").alias("comp_b"), F.min("apart").alias("apart")), self.named("near"))
        apart = found.select("a", "b")
        if found.count() <= many:
            self.confirm(apart)
            return
        # of each two components first the likeliest pair: its link saves the others
        best = found.groupBy(F.least("comp_a", "comp_b").alias("_x"), F.greatest("comp_a", "comp_b").alias("_y")).agg(F.min(F.struct("apart", "a", "b")).alias("_b"))
        self.confirm(best.select("_b.a", "_b.b"))
        if self.labels is not None:
            for side in ("a", "b"):
                apart = apart.join(self.labels.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left")
            apart = apart.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
        self.confirm(apart)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) for every row of ``docs`` (doc_id, text, ...).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets.
    With the defaults a pair at the threshold is missed by every band with probability
    1.0e-5, and dropped by its estimate with probability below 1e-6. Every other candidate
    is either in one component with its partner or confirmed or refuted on full sets.

    Documents of equal sets are one class from the start. A bucket of near copies costs a
    comparison or two a member; only members of different components are compared pair by
    pair, on 512-byte sketches, in blocks of bounded rows. No group of rows is larger than
    a block, so a group of any size is many even tasks.

    Null or word-less texts have no shingles and stand alone. What is linked are classes of
    equal sets, each with a number of its own; so a row is judged by its own text, also
    where rows share a doc_id. ``component_id`` is the smallest doc_id of a component, and
    ``kept`` are the rows of that doc_id in one of the component's classes, so that each
    component keeps some row; ``text_key``, a hash of the text, tells rows of one doc_id
    apart. A null doc_id stays null and kept. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    signed = docs.mapInArrow(_sign(size, bands, rows), "doc_id long, text_key long, n_shingles long, fp1 long, fp2 long, bands array<long>")
    signed = materialise(signed, "neardup-signed")
    first = F.min(F.struct("doc_id", "text_key")).alias("_first")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles").agg(first, F.any_value("bands").alias("bands"))
    # numbered as they are written: rows that share a doc_id may be of several classes
    number = F.monotonically_increasing_id().alias("node")
    classes = materialise(classes.select("fp1", "fp2", "n_shingles", number, F.col("_first.doc_id").alias("doc_id"), F.col("_first.text_key").alias("text_key"), "bands"), "neardup-classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.count(F.lit(1)).alias("size")).where("_lo <> _hi").select("band", "size")
    members = materialise(banded.join(shared, "band").select("band", "size", "node"), "neardup-members")

    some = members.select("node").distinct()
    wanted = materialise(classes.join(some, "node", "left_semi").select("node", "doc_id", "text_key"), "neardup-wanted")
    nodes = wanted.count()
    texts = docs.join(F.broadcast(wanted) if nodes <= BROADCAST_IDS else wanted, ["doc_id", "text_key"])
    texts = materialise(texts.select("node", "text"), "neardup-texts")
    if texts.count() > nodes:  # rows of one id and text
        texts = materialise(texts.dropDuplicates(["node"]), "neardup-single")
    sketches = materialise(texts.mapInArrow(_sketch(size, bands, rows), "node long, n_shingles long, sketch array<long>, keys array<long>"), "neardup-sketches")

    search = _Search(texts, members, sketches, size, percent, farthest(percent))
    turn, many = 0, members.count()
    while True:
        current, top, pairs = search.left(turn > 0)
        if turn >= ROUNDS or turn > 0 and pairs <= PAIRS_LEFT * many:
            break
        search.pivots(turn)
        turn += 1
    if pairs:
        search.rest(current, top, many)
    named = classes.select("fp1", "fp2", "n_shingles", "node", "doc_id", F.col("text_key").alias("_key"))
    own = F.struct("doc_id", "node", "_key")
    if search.labels is None:
        named = named.withColumn("_keeper", own)
    else:
        labelled = named.join(search.labels, "node").select("node", "component", own.alias("_own"))
        first = labelled.groupBy("component").agg(F.min("_own").alias("_first"))
        linked_ = labelled.join(first, "component").select("node", "_first")
        named = named.join(linked_, "node", "left").withColumn("_keeper", F.coalesce("_first", own))
    named = named.select("fp1", "fp2", "n_shingles", F.col("_keeper.doc_id").alias("_component"), (F.col("node") == F.col("_keeper.node")).alias("_first_class"), F.col("_keeper._key").alias("_key"))
    out = signed.drop("bands").join(named, ["fp1", "fp2", "n_shingles"], "left")
    component = F.coalesce("_component", "doc_id")
    kept = (F.col("doc_id") == component) & F.coalesce(F.col("_first_class") & (F.col("text_key") == F.col("_key")), F.lit(True))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"), "text_key")
