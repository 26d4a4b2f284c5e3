"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token (a run of upper-case letters, lower-case letters, digits or one kind of sign) falls
into one of BUCKETS hash buckets. A bucket has a fixed sparse random index vector; its context
vector is the sum of the index vectors of the neighbours of all its occurrences in all documents,
divided by their number. A document is the mean and the spread of its tokens' vectors. A tanh
layer and a sigmoid are trained with numpy on a bounded sample of labelled documents; a
temperature fitted on a part that training left out calibrates the probabilities.

Defined results: null and empty texts have all-zero features and get the score that follows from
them. Null labels and null ids teach nothing; without both classes the score is the base rate
(one half if there are no labels). Repeated rows are scored alike, repeated labels count again.
Labelled ids of equal hash are taken by id and label. Very long texts are read whole, in pieces; a
token at a cut is split in two. An empty table gives no rows. Only the id and the text are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import tidy
from .words import SLICE, mix, slices, text_buffers

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 3, 2
#: Most labelled documents that the network is fitted on, chosen by least hashed id.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
FEATURES = 2 * DIMS

_U = np.uint64


def _classes() -> np.ndarray:
    """0 for white space; 1 upper, 2 lower and non-ASCII, 3 digits, others each their own."""
    c = np.arange(256)
    c[[32, *range(9, 14)]] = 0
    c[65:91], c[97:123], c[128:], c[48:58] = 1, 2, 2, 3
    return c.astype(np.uint8)


_CLASS = _classes()
_VALUE = mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)


def _buckets(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first byte) of each token."""
    c = _CLASS[buf]
    first = np.ones(len(c), bool)
    first[1:] = c[1:] != c[:-1]
    first[begins[begins < len(c)]] = True
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.int64), starts
    kind = c[starts]
    # sums of place-weighted values: the place within the token, up to 64 bytes of it
    place = np.minimum(np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf)))), 63)
    h = mix(np.add.reduceat(_VALUE[buf] * _PLACE[place], starts))
    keep = kind != 0
    return (h[keep] & _U(BUCKETS - 1)).astype(np.int64), starts[keep]


_PLACE = mix(np.arange(2001, 2065, dtype=np.uint64)) | _U(1)


def _tokens(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, buckets, token offsets); a very long text comes whole."""
    buf, offsets = text_buffers(col)
    for i, j in slices(offsets):
        base, begins = buf[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        parts, at = [], 0
        while at < len(base):  # a long text in pieces; a token at a cut is split in two
            piece = base[at : at + 4 * SLICE]
            b, s = _buckets(piece, begins[(begins >= at) & (begins < at + len(piece))] - at)
            parts.append((b, s + at))
            at += len(piece)
        b = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        s = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
        yield i, j, b, np.searchsorted(s, offsets[i : j + 1] - offsets[i])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places [BUCKETS, NONZERO], signs) of each bucket's index vector."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + _U(77)).reshape(BUCKETS, NONZERO)
    return (h % _U(DIMS)).astype(np.int64), np.where(h >> _U(63), 1.0, -1.0)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """[BUCKETS, DIMS] context vectors from all documents.

    Each task adds up one BUCKETS x DIMS table of whole numbers, so the result does not depend on
    the partitioning; Spark sums the tables by bucket, and BUCKETS rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, seen = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, t, offs in _tokens(b.column(0)):
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                for d in range(1, REACH + 1):
                    same = doc[d:] == doc[:-d]
                    left, right = t[:-d][same], t[d:][same]
                    for a, c in ((left, right), (right, left)):
                        seen += np.bincount(a, minlength=BUCKETS)
                        for k in range(NONZERO):
                            total += np.bincount(a * DIMS + places[c, k], signs[c, k], BUCKETS * DIMS)
        used = np.flatnonzero(seen)
        rows = total.reshape(BUCKETS, DIMS)[used].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used]), *(pa.array(rows[:, d]) for d in range(DIMS))], names)

    names = ["bucket", "n", *(f"d{d}" for d in range(DIMS))]
    tables = docs.select(text_col).mapInArrow(tidy(run), ", ".join(f"{x} long" for x in names))
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for r in tables.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names[1:])).collect():
        out[r[0]] = np.array(r[2:], float) / r[1]
    return out


def pool(tokens: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """[texts, FEATURES]: mean and standard deviation of the tokens' vectors."""
    n, counts = len(offs) - 1, np.diff(offs)
    out = np.zeros((n, FEATURES), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        v = vectors[tokens]
        total = np.add.reduceat(v, offs[some], axis=0)
        square = np.add.reduceat(v * v, offs[some], axis=0)
        mean = total / counts[some, None]
        out[some, :DIMS] = mean
        out[some, DIMS:] = np.sqrt(np.maximum(0, square / counts[some, None] - mean * mean))
    return out


class Network:
    """Standardised features -> tanh layer -> sigmoid of logit / temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, left_out: np.ndarray):
        self.base = float(y.mean()) if len(y) else 0.5
        self.weights = None
        if len(set(y[~left_out].tolist())) < 2:
            return
        rng = np.random.default_rng(7)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z, t = (x[~left_out] - self.mean) / self.sd, y[~left_out]
        w1, b1 = rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN)
        w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
        params = [w1, b1, w2, b2]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(z)), -(-len(z) // 256)):
                a = np.tanh(z[part] @ w1 + b1)
                d = (1 / (1 + np.exp(-(a @ w2 + b2))) - t[part]) / len(part)
                back = np.outer(d, w2) * (1 - a * a)
                step += 1
                for p, g, (m, v) in zip(params, (z[part].T @ back + DECAY * w1, back.sum(0), a.T @ d + DECAY * w2, d.sum(keepdims=True)), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = params, 1.0
        if left_out.any():
            logit, t = self._logit(x[left_out]), y[left_out]
            loss = lambda c: float(np.logaddexp(0, np.where(t > 0, -logit, logit) / c).mean())
            self.temperature = min(np.exp(np.linspace(-2, 2, 81)).tolist(), key=loss)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.sd @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -700, 700)))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on at most SAMPLE labelled documents. labels: (id, label 0/1); usable: condition on the id column."""
    known = labels.where(F.col("label").isNotNull() & F.col("id").isNotNull() & usable)
    sample = known.select("id", "label", F.xxhash64("id").alias("h")).sort("h", "id", "label").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("h", "label", "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t, offs in _tokens(b.column(2)):
                x = pool(t, offs, shared.value)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["h", "label", "x"])

    # repeated ids may give more rows than the sample has: the first by hash, label and features
    rows = texts.mapInArrow(tidy(run), "h long, label int, x array<float>").sort("h", "label", "x").limit(2 * SAMPLE).collect()
    rows.sort(key=lambda r: (r.h, r.label, r.x))
    x = np.array([r.x for r in rows], np.float64).reshape(len(rows), FEATURES)
    return Network(x, np.array([r.label for r in rows], float), np.array([r.h % 5 == 0 for r in rows], bool))


def score_documents(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.zeros(b.num_rows)
            for i, j, t, offs in _tokens(b.column(1)):
                scores[i:j] = shared.value[1].score(pool(t, offs, shared.value[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], [b.schema.names[0], "score"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
