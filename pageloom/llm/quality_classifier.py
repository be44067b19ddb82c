"""Quality classifier: supervised subword embeddings.

Words, word pairs and runs of 3 and 4 bytes are hashed to rows of one table of learned vectors. A document is
the average of its word vectors plus that of its byte-run vectors; a softmax layer gives the class.
Vectors and layer are trained together by numpy stochastic gradient descent on a bounded sample of
labelled documents (``SAMPLE``). For scoring, each vector is multiplied with the layer beforehand,
so that a document needs one number per feature.

Defined cases: a null or empty text has the zero vector and so the score of the layer's bias; a null
doc_id is in no fold (held_out null) and is scored; repeated rows are scored each; without labels of
both classes the score is the share of label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from . import tokens as T
from .shared import table

SAMPLE = 4000  # labelled documents at most
BITS, DIM, EPOCHS, RATE = 17, 8, 6, 0.5
FOLDS, HELD_OUT = 3, 1
_RUNS = (3, 4)


def features(s: T.Slice) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For words and for byte runs: (row of the slice, row of the table), sorted by row of the slice."""
    shift, n = np.uint64(64 - BITS), s.hi - s.lo
    w = T.words(s)
    h = T.word_hashes(s, w)
    pair = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    # a word that follows itself is one feature, whatever the word
    two = np.where(h[pair] == h[pair + 1], np.uint64(0x5851F42D4C957F2D), T.window_hashes(h, 2)[pair] if len(pair) else h[pair])
    doc = np.concatenate([w.doc, w.doc[pair]])
    order = np.argsort(doc, kind="stable")
    groups = [(doc[order], (np.concatenate([h, two]) >> shift)[order].astype(np.int64))]
    runs, rows = [], []
    b = s.buf.astype(np.uint64)
    for k in _RUNS:
        m = len(b) - k + 1
        if m > 0:
            code = np.full(m, k, np.uint64)
            for j in range(k):
                code = (code << np.uint64(8)) | b[j : j + m]
            row = np.repeat(np.arange(n), np.diff(s.offsets))
            inside = np.flatnonzero(row[:m] == row[k - 1 :])
            runs.append(((code * np.uint64(T._BASE)) >> shift)[inside].astype(np.int64))
            rows.append(row[:m][inside])
    for row, run in zip(rows, runs, strict=True):
        groups.append((row, run))
    return groups, n


def _means(groups, n: int, value: np.ndarray) -> np.ndarray:
    """Sum over the groups of the mean value of a row's features."""
    total = np.zeros(n)
    for row, idx in groups:
        c = np.bincount(row, minlength=n)
        total += np.bincount(row, value[idx], minlength=n) / np.maximum(c, 1)
    return total


def shares(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's features, each once, with its share of its group; never more than the table has rows, however long the text."""
    docs = []
    for s in T.slices(column):
        groups, n = features(s)
        bounds = [np.searchsorted(row, np.arange(n + 1)) for row, _ in groups]
        for i in range(n):
            idx, c = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
            for (_, group), at in zip(groups, bounds, strict=True):
                own = group[at[i] : at[i + 1]]
                if len(own):
                    u, k = np.unique(own, return_counts=True)
                    idx.append(u.astype(np.int32))
                    c.append((k / len(own)).astype(np.float32))
            docs.append((np.concatenate(idx), np.concatenate(c)))
    return docs


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """The value of each feature and the bias: the difference of the two logits."""
    return fitted(shares(pa.array(texts, pa.string())), labels, seed)


def fitted(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """The same from the documents' shares of features."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(seed)
    emb = ((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    layer[1], layer[0] = rng.normal(0, 0.1, DIM), rng.normal(0, 0.1, DIM)
    weight = len(y) / (2.0 * np.bincount(y.clip(0, 1), minlength=2))
    steps, step = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            idx, c = docs[i]
            rate = RATE * (1 - step / steps)
            step += 1
            v = c @ emb[idx] if len(idx) else np.zeros(DIM, np.float32)
            z = layer @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i] > 0)] -= 1
            g = np.float32(rate * weight[int(y[i] > 0)]) * p.astype(np.float32)
            back = g @ layer
            layer -= np.outer(g, v)
            bias -= 0.1 * g
            if len(idx):
                emb[idx] -= 20 * c[:, None] * back
    return emb @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def scored(docs: DataFrame, sample: DataFrame, parts: int = FOLDS, out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. ``sample`` (text, label) is bounded by its maker."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, c = zip(*((u.tobytes(), v.tobytes()) for u, v in shares(b.column(2))), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx, pa.binary()), pa.array(c, pa.binary())], ["doc_id", "label", "idx", "c"])

    # texts become counts where they are; only the sample's counts reach the driver
    rows = sorted(tuple(r) for r in sample.select("doc_id", "label", "text").mapInArrow(counted, "doc_id long, label int, idx binary, c binary").collect())
    model = docs.sparkSession.sparkContext.broadcast(fitted([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], [r[1] for r in rows]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias = model.value
        value = value.astype(np.float64)
        for b in batches:
            for s in T.slices(b.column(1)):
                groups, n = features(s)
                p = 1 / (1 + np.exp(-np.clip(_means(groups, n, value) + bias, -60, 60)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, n), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, predicted int")
    return got.select("doc_id", (labelled.fold(F.col("doc_id"), parts) == out).alias("held_out"), "score", "predicted")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, labelled.sample(docs, table(spark, sf_dir, "labels"), "quality", FOLDS, HELD_OUT, SAMPLE))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
