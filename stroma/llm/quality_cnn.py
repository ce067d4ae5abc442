"""Document quality by a byte-level convolutional network in numpy.

Every byte is a symbol; a second bit says whether it lies in a four-byte string that
also stands a little before (repetition). Learned filters read a few neighbouring
symbols at every place. Their rectified outputs are max-pooled within overlapping chunks
that cover the whole document, the chunks' maxima are averaged, and a logistic unit makes
one probability of the averages. So each chunk counts alike in texts of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stroma.llm.shared import annotate, labelled_texts, slices, text_buffers

WIDTH, FILTERS = 5, 8
#: Chunks are two strides long; a stride is a power of two.
STRIDE = 32
#: How far back a repeated four-byte string may lie, within the text; texts are parted by GAP strides of zeros, which is farther.
BACK, GAP = 48, 2
#: Learned from at most so many texts of each class, of at most so many bytes.
PER_CLASS, MAX_BYTES = 700, 12_000
EPOCHS, BATCH, RATE = 14, 32, 0.02
THRESHOLD = 0.3


def symbols(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, number of strides of each text): each text starts a stride and is followed by GAP strides of zeros or more.

    Zero is the symbol of no byte: a NUL of a text is read as 0xFF, which UTF-8 doesn't have.
    """
    size = offs[1:] - offs[:-1]
    strides = -(-size // STRIDE)
    room = (strides + GAP) * STRIDE
    to = np.concatenate([[0], np.cumsum(room)])
    data = np.zeros(int(to[-1]) + 8, np.uint8)
    for k, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        data[to[k] : to[k] + e - s] = np.where(raw[s:e] == 0, 0xFF, raw[s:e])
    n = len(data) - 8
    four = np.zeros(n + 4, np.uint32)
    for k in range(4):
        four[:n] |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    again = np.zeros(n, bool)
    for back in range(2, BACK + 1):
        if back < n:
            again[back:] |= four[back:n] == four[: n - back]
    again &= data[:n] > 0
    return data[:n].astype(np.intp) + again * 256, strides


class Network:
    def __init__(self, tables: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.tables, self.bias, self.weights, self.offset = tables, bias, weights, offset

    def filters(self, sym: np.ndarray) -> np.ndarray:
        """Rectified filter outputs at every place, zero where a place is beyond its text."""
        n = len(sym) - WIDTH + 1
        out = np.empty((len(sym), len(self.bias)), np.float32)
        out[n:] = 0
        np.take(self.tables[0], sym[:n], axis=0, out=out[:n], mode="clip")
        more = np.empty_like(out[:n])
        for k in range(1, WIDTH):
            np.take(self.tables[k], sym[k : k + n], axis=0, out=more, mode="clip")
            out[:n] += more
        out += self.bias
        np.maximum(out, 0, out=out)
        out[sym == 0] = 0
        return out

    def pooled(self, out: np.ndarray, strides: np.ndarray) -> np.ndarray:
        """Each text's mean over its chunks of the chunks' maxima."""
        half = out.reshape(-1, STRIDE, out.shape[1])
        while half.shape[1] > 1:
            m = half.shape[1] // 2
            half = np.maximum(half[:, :m], half[:, m:])
        half = half[:, 0]
        chunk = np.maximum(half[:-1], half[1:])  # the stride behind a text's last is zeros, so its last chunk is its last stride
        first = np.concatenate([[0], np.cumsum(strides + GAP)[:-1]]).astype(np.int64)
        out = np.zeros((len(strides), half.shape[1]))
        full = np.flatnonzero(strides)  # each text is summed by itself, so its mean doesn't depend on its neighbours
        if len(full):
            edges = np.stack([first[full], first[full] + strides[full]], 1).ravel()
            out[full] = np.add.reduceat(chunk.astype(np.float64), edges, axis=0)[::2] / strides[full][:, None]
        return out

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        scores = []
        for i, j in slices(offs, 1 << 17):
            sym, strides = symbols(raw, offs[i : j + 1])
            means = self.pooled(self.filters(sym), strides)
            scores.append(1 / (1 + np.exp(-np.clip((means * self.weights).sum(1) + self.offset, -30, 30))))
        return np.concatenate(scores) if scores else np.zeros(0)


def train(examples: list[tuple[str, int]], seed: int = 5) -> Network:
    """Adam on the logistic loss, both classes weighted alike; without two classes a network that gives the prior."""
    rng = np.random.default_rng(seed)
    y = np.array([v for _, v in examples], float)
    tables = (rng.standard_normal((WIDTH, 512, FILTERS)) * 0.15).astype(np.float32)
    bias, weights, offset = np.full(FILTERS, 0.1, np.float32), rng.standard_normal(FILTERS) * 0.3, np.zeros(1)
    if len(set(y.tolist())) < 2:
        prior = (y.sum() + 0.5) / (len(y) + 1)
        return Network(tables * 0, bias * 0, weights * 0, float(np.log(prior / (1 - prior))))
    raw = [np.frombuffer(t.encode(), np.uint8) for t, _ in examples]
    for k in range(0, len(examples), 3):  # short pieces too, so that short texts are judged by what they have
        pieces = examples[k][0].split(" ")
        first, many = int(rng.integers(len(pieces))), int(rng.integers(2, 12))
        raw.append(np.frombuffer(" ".join(pieces[first : first + many]).encode() or b" ", np.uint8))
        y = np.append(y, y[k])
    ready = [symbols(r, np.array([0, len(r)])) for r in raw]
    share = len(y) / (2 * np.bincount(y.astype(int), minlength=2))
    net = Network(tables, bias, weights, 0.0)
    state = [[np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)] for p in (tables, bias, weights, offset)]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            batch = order[at : at + BATCH]
            sym = np.concatenate([ready[k][0] for k in batch])
            strides = np.concatenate([ready[k][1] for k in batch])
            out = net.filters(sym)
            means = net.pooled(out, strides)
            p = 1 / (1 + np.exp(-np.clip(means @ weights + offset[0], -30, 30)))
            slope = (p - y[batch]) * share[y[batch].astype(int)] / len(batch)
            # to the place that won each chunk: a stride's best, and of a chunk's two strides the better
            cut = out.reshape(-1, STRIDE, FILTERS)
            best = cut.argmax(1)
            half = np.take_along_axis(cut, best[:, None, :], 1)[:, 0, :]
            doc = np.repeat(np.arange(len(batch)), strides + GAP)
            inside = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(strides + GAP)[:-1]]), strides + GAP) < strides[doc]
            pull = np.where(inside, slope[doc] / np.maximum(strides[doc], 1), 0)[:-1, None] * weights
            later = half[1:] > half[:-1]
            grad = np.zeros_like(half)
            grad[:-1] += np.where(later, 0, pull)
            grad[1:] += np.where(later, pull, 0)
            grad *= half > 0
            g_tables = np.zeros((WIDTH, 512 * FILTERS))
            stride_at, filt = np.nonzero(grad)
            place = stride_at * STRIDE + best[stride_at, filt]
            value = grad[stride_at, filt]
            for k in range(WIDTH):
                g_tables[k] = np.bincount(sym[np.minimum(place + k, len(sym) - 1)].astype(np.int64) * FILTERS + filt, value, 512 * FILTERS)
            grads = [g_tables.reshape(tables.shape), grad.sum(0), means.T @ slope + 1e-3 * weights / 100, np.array([slope.sum()])]
            step += 1
            for param, g, (m, v) in zip((tables, bias, weights, offset), grads, state):
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                param -= (RATE * (1 - 0.95 * epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-6)).astype(param.dtype)
    return Network(tables, bias, weights, float(offset[0]))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5, left_out: int = 0, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Network:
    return train(labelled_texts(docs, labels, "quality", fold, left_out, per_class, max_bytes, seed=5))


def score_quality(docs: DataFrame, network: Network, out: str = "quality") -> DataFrame:
    """``docs`` and a struct ``out`` with score, the probability of good quality.

    Every row comes back with all its columns (one called ``out`` is replaced). All bytes
    of a text are read. Null and empty texts have no chunk and get the probability of
    the offset alone. Only the text counts, so equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def compute():
        net = shared.value

        def function(column):
            return [pa.array(net.scores(*text_buffers(column)), pa.float64())]

        return function

    return annotate(docs, out, "score: double", compute)


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below the threshold, in the columns it came with."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return score_quality(docs, fit(docs, labels), name).where(f"{name}.score >= {threshold}").drop(name)
