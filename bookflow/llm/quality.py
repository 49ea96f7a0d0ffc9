"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded into
shape features (letter classes, marks, repetition, word lengths), its words
hashed into HASHED signed counts of length one, and one hidden layer over both. Gated attention, learned from document labels alone, weighs the passages;
the weighted representation gives the document's score. Training runs on a
bounded, documented sample of labelled documents; scoring is one pass over the
table with the model in the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.llm.kernels import LOWER, RangeHash, passes, text_bytes, word_ranges

PASSAGE = 64
#: Labelled documents that training reads at most; fewer labels are all used.
TRAIN_DOCS = 3000
HIDDEN, GATES = 12, 8
STEPS, RATE = 250, 0.03
DECAY = 1e-4
#: Decay of the encoder's weights for hashed words, which are many and would fit single labels.
WORD_DECAY = 0.1
THRESHOLD = 0.3
FOLDS = 5

#: Classes of bytes that are counted: three fields of 21 bits in each table; passages of more bytes are counted byte by byte.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "|", "!?", "%#$*&@^~", ".,;:", "<>{}[]()=/\\_\"'", "")
FIELD = 21


def _tables() -> list[np.ndarray]:
    tables = [np.zeros(256, np.uint64) for _ in range(3)]
    for k, letters in enumerate(CLASSES):
        codes = [ord(c) for c in letters] or list(range(128, 256))
        for c in codes:
            tables[k // 3][c] = np.uint64(1 << (FIELD * (k % 3)))
    return tables


TABLES = _tables()
SHAPES = len(CLASSES) + 7
#: Cells that the words of a passage are hashed into; a power of two.
HASHED = 128
N_FEATURES = SHAPES + HASHED


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a batch, and the n + 1 bounds of each text's passages; a text without words is one zero passage."""
    rows, counts = [], []
    for first, last in passes(bounds):
        part = data[bounds[first] : bounds[last]]
        own = bounds[first : last + 1] - bounds[first]
        x, n = _encode_pass(part, own)
        rows.append(x)
        counts.append(n)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(rows) if rows else np.zeros((0, N_FEATURES), np.float32)), np.r_[0, np.cumsum(n)]


def _encode_pass(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs = len(bounds) - 1
    start, end, row = word_ranges(data, bounds)
    per_doc = np.bincount(row, minlength=docs) if len(row) else np.zeros(docs, np.int64)
    passages = np.maximum(-(-per_doc // PASSAGE), 1)
    offset = np.r_[0, np.cumsum(passages)]
    out = np.zeros((offset[-1], N_FEATURES), np.float32)
    if not len(row):
        return out, passages
    word_first = np.r_[0, np.cumsum(per_doc)]
    place = np.arange(len(row)) - word_first[row]
    passage = offset[row] + place // PASSAGE
    heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    tails = np.r_[heads[1:], len(row)] - 1
    ids, a, z = passage[heads], start[heads], end[tails]
    size = (z - a).astype(np.float32)
    n_words = (tails - heads + 1).astype(np.float32)
    for k, table in enumerate(TABLES):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data], out=sums[1:])
        packed = sums[z] - sums[a]
        for j in range(3):
            out[ids, 3 * k + j] = (packed >> np.uint64(FIELD * j) & np.uint64((1 << FIELD) - 1)).astype(np.float32) / size
    for i in np.flatnonzero(z - a >= 1 << FIELD):
        seen = np.bincount(data[a[i] : z[i]], minlength=256)
        for k in range(len(CLASSES)):
            counted = TABLES[k // 3] == np.uint64(1 << (FIELD * (k % 3)))
            out[ids[i], k] = seen[counted].sum() / size[i]
    low = LOWER[data]
    words = RangeHash(low).of(start, end)
    same = np.zeros(len(row), np.float32)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    near = np.zeros(len(row), np.float32)
    near[2:] = (words[2:] == words[:-2]) & (row[2:] == row[:-2])
    order = np.lexsort((words, passage))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=len(out))[ids]
    k = len(CLASSES)
    out[ids, k] = np.add.reduceat(same, heads) / n_words
    out[ids, k + 1] = np.add.reduceat(near, heads) / n_words
    out[ids, k + 2] = distinct / n_words
    out[ids, k + 3] = np.log1p(size / n_words)
    out[ids, k + 4] = np.log1p(n_words)
    out[ids, k + 5] = 1.0
    out[ids, k + 6] = np.log1p(per_doc[row[heads]].astype(np.float32))
    cell = passage * HASHED + (words & np.uint64(HASHED - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * (words >> np.uint64(63)).astype(np.float64)
    content = np.bincount(cell, sign, minlength=len(out) * HASHED).reshape(-1, HASHED)
    content /= np.maximum(np.sqrt(np.einsum("ij,ij->i", content, content)), 1)[:, None]
    out[:, SHAPES:] = content
    return out, passages


@dataclass(frozen=True)
class Model:
    """Weights of the network and the scaling of its inputs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def scores(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        return _forward(self.weights, np.clip((x - self.mean) / self.scale, -8, 8), bounds)[0]


def _forward(w: tuple[np.ndarray, ...], x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, tuple]:
    w1, b1, v, u, g, c, b = w
    h = np.tanh(x @ w1 + b1)
    t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    e = (t * s) @ g
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    e = np.exp(e - np.maximum.reduceat(e, bounds[:-1])[of])
    a = e / np.add.reduceat(e, bounds[:-1])[of]
    z = np.add.reduceat(a[:, None] * h, bounds[:-1])
    p = 1 / (1 + np.exp(-np.clip(z @ c + b[0], -30, 30)))
    return p, (h, t, s, a, z, of)


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Learn encoder, gated attention and classifier from bags and their labels, by Adam on all bags."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
    w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or i in (4, 5) else np.zeros(s) for i, s in enumerate(shapes)]
    decay = np.full((x.shape[1], 1), DECAY)
    decay[SHAPES:] = WORD_DECAY
    m, q = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, STEPS + 1):
        p, (h, t, s, a, z, of) = _forward(tuple(w), x, bounds)
        d = (p - y) / len(y)
        dz = d[:, None] * w[5]
        at = (h * dz[of]).sum(axis=1)
        de = a * (at - np.add.reduceat(a * at, bounds[:-1])[of])
        dg = de[:, None] * w[4]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz[of] + dt @ w[2].T + ds @ w[3].T) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, np.array([d.sum()])]
        rate = RATE * (1 - 0.9 * step / STEPS)
        for i, grad in enumerate(grads):
            grad = grad + (DECAY if i else decay) * w[i]
            m[i] = 0.9 * m[i] + 0.1 * grad
            q[i] = 0.99 * q[i] + 0.01 * grad * grad
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(q[i] / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, tuple(w))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: one id in FOLDS, by checksum; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, bounds = encode(*text_bytes(batch.column("text")))
        bags = [x[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(bags, pa.binary())], names=["quality", "bag"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit a model on at most `most` labelled documents that are not held out, those with the smallest hashes of their ids.

    Rows without a label, text or id are left out; of several labels of an id the
    smallest counts, and of several texts the first in order. Without any usable rows the model is fitted on one empty
    text of each label and scores every text 0.5.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    source = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    source = source.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = source.join(F.broadcast(chosen), "doc_id").select("quality", "text")  # `most` rows at most
    bags = rows.mapInArrow(_bags, "quality int, bag binary").collect()
    bags = [(r["quality"], bytes(r["bag"])) for r in bags] or [(q, np.zeros(N_FEATURES, np.float32).tobytes()) for q in (0, 1)]
    bags.sort()
    parts = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, b in bags]
    bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
    return fit(np.concatenate(parts).astype(np.float64), bounds, np.array([q for q, _ in bags], float))


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(*encode(*text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    * null and empty texts are one empty passage and get that passage's score
    * a score depends on the text alone, so repeated rows and equal texts score alike
    * ties in score keep no order; a very long text is encoded whole, in passages, by the task that reads it
    * an empty table gives no rows; other columns are ignored
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")


def _filter(model: Model, at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(*encode(*text_bytes(batch.column(at)))) >= THRESHOLD))

    return keep


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text the model accepts, with all their columns; no shuffle."""
    at = docs.columns.index("text")
    return docs.mapInArrow(_filter(model, at), T.StructType(docs.schema.fields))
