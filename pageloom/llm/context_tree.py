"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, each but the last followed by a space, and one end byte. Each byte
is decomposed into eight binary decisions; each decision has a tree of contexts, the 0 to ``DEPTH``
bytes before. Every node holds Krichevsky-Trofimov estimates of its counts, and a node's
weighted probability is the even mixture of its own estimate and the product of its children's. The
counts of the training documents are gathered once; a byte's probability then mixes the estimates of
all depths along its context by the posterior weights of the trees. ``bits_per_byte`` is the code
length.

Documents are dealt into blocks by a hash of doc_id. A block sends each different string of
``DEPTH + 1`` bytes once, with its training count, to a bucket by hash; buckets sum the counts and
pass each string on to the part of the trees that has its last two context bytes. Nodes above (at
most 65,536 with a context of one byte) are summed and broadcast. Probabilities go back by the same
buckets to the blocks that asked. Word counts for the base score travel likewise.

Defined cases: a null or blank text is the end byte alone; a null doc_id is in no fold (held_out
null): scored, not learned from; repeated rows are learned from and scored each; without training
documents every bit has probability one half; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .shared import table, written

DEPTH = 5
BLOCK_DOCS = 8192
FOLDS, HELD_OUT = 5, 1
_SLICE = 1 << 21
_END = 10
_END_WORD = np.uint64(0xA5A5A5A55A5A5A5B)
_FOUND = "_bucket int, _block int, h binary, n binary"


def _lgamma_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([math.lgamma(i + 0.5) for i in range(n)]), np.array([math.lgamma(i + 1.0) for i in range(n)])


_HALF, _WHOLE = _lgamma_table(4096)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """For large x: Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    half = lambda n: np.where(n < len(_HALF), _HALF[np.minimum(n, len(_HALF) - 1)], _lgamma(np.maximum(n, 1) + 0.5))
    t = a + b
    whole = np.where(t < len(_WHOLE), _WHOLE[np.minimum(t, len(_WHOLE) - 1)], _lgamma(np.maximum(t, 1) + 1.0))
    return half(a) + half(b) - whole - math.log(math.pi)


def _groups(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values for each different key."""
    o = np.argsort(key, kind="stable")
    k = key[o]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return (k[at], *(np.add.reduceat(v[o], at) if len(at) else v for v in values))


def _bit_nodes(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context << 8 | path of bits), zeros, ones, from counts of (context << 8 | byte)."""
    keys, zeros, ones = [], [], []
    for k in range(8):
        bit = (key >> np.uint64(7 - k)) & np.uint64(1)
        path = (np.uint64(1) << np.uint64(k)) | ((key & np.uint64(255)) >> np.uint64(8 - k))
        node = (key & ~np.uint64(255)) | path
        u, a, b = _groups(node, np.where(bit == 0, n, 0), np.where(bit == 1, n, 0))
        keys.append(u)
        zeros.append(a)
        ones.append(b)
    u, a, b = (np.concatenate(v) for v in (keys, zeros, ones))
    o = np.argsort(u, kind="stable")
    return u[o], a[o], b[o]


class Subtree:
    """The nodes with contexts of 2 to ``depth`` bytes, from counts of strings of depth + 1 bytes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, least: int = 2) -> None:
        self.depth, self.least, self.levels = depth, least, {}
        seen = n > 0
        gram, n = gram[seen], n[seen]
        below: tuple[np.ndarray, np.ndarray] | None = None
        for d in range(depth, least - 1, -1):
            gram, n = _groups(gram & np.uint64((1 << 8 * (d + 1)) - 1), n)
            key, a, b = _bit_nodes(gram, n)
            own = kt_log(a, b)
            if below is None:
                weighted, stop = own, np.ones(len(own))
            else:
                # the children's keys without their oldest byte are this level's keys
                up, s = _groups(below[0] & np.uint64((1 << 8 * (d + 1)) - 1), below[1])
                assert len(up) == len(key)
                weighted = np.logaddexp(own, s) - math.log(2)
                stop = np.exp(own - math.log(2) - weighted)
            self.levels[d] = (key, a, b, stop)
            below = (key, weighted)
        self.top = below

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """For each string, the probabilities of its eight bits, mixed over this subtree's depths."""
        out = np.empty((len(gram), 8))
        for k in range(8):
            bit = (gram >> np.uint64(7 - k)) & np.uint64(1)
            path = (np.uint64(1) << np.uint64(k)) | ((gram & np.uint64(255)) >> np.uint64(8 - k))
            node = (gram & ~np.uint64(255)) | path
            p = np.full(len(gram), 0.5)
            for d in range(self.depth, self.least - 1, -1):
                key, a, b, stop = self.levels[d]
                if not len(key):
                    continue
                own = node & np.uint64((1 << 8 * (d + 1)) - 1)
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                has = key[at] == own
                kt = (np.where(bit == 0, a[at], b[at]) + 0.5) / (a[at] + b[at] + 1.0)
                p = np.where(has, stop[at] * kt + (1 - stop[at]) * p, 0.5)
            out[:, k] = p
        return out


class Top:
    """The nodes with contexts of one and no byte, as full tables over (context, path of bits)."""

    def __init__(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray) -> None:
        """key: context byte << 8 | path; children: sums of the weighted logarithms of the nodes below."""
        self.one = np.zeros((3, 1 << 16))
        own = kt_log(a, b)
        weighted = np.logaddexp(own, children) - math.log(2)
        self.one[0][key], self.one[1][key], self.one[2][key] = a, b, np.exp(own - math.log(2) - weighted)
        u, a, b, s = _groups(key & 255, a, b, weighted)
        self.none = np.zeros((3, 256))
        own = kt_log(a, b)
        self.none[0][u], self.none[1][u], self.none[2][u] = a, b, np.exp(own - np.logaddexp(own, s))

    def log10(self, gram: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte, given the bits' probabilities from the subtrees."""
        out = np.zeros(len(gram))
        for k in range(8):
            bit = ((gram >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
            path = ((1 << k) | ((gram & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64))
            p = bits[:, k]
            for t, at in ((self.one, ((gram >> np.uint64(8)) & np.uint64(255)).astype(np.int64) << 8 | path), (self.none, path)):
                a, b, stop = t[0][at], t[1][at], t[2][at]
                kt = (np.where(bit == 0, a, b) + 0.5) / (a + b + 1)
                p = np.where(a + b > 0, stop * kt + (1 - stop) * p, 0.5)
            out += np.log10(p)
        return out


def is_training(doc_id: int, folds: int, out: int) -> bool:
    return doc_id != T.NO_ID and zlib.crc32(str(doc_id).encode()) % folds != out


def _streams(t: pa.Table, depth: int, folds: int, out: int):
    """Slice by slice: strings of depth + 1 bytes, their rows, word hashes (with the ends), their rows, and which rows are for training."""
    ids = T.ids(t.column("doc_id"))
    train = np.array([is_training(i, folds, out) for i in ids.tolist()], bool)
    pad = bytes([_END]) * depth
    for s in T.slices(t.column("text"), _SLICE):
        n = s.hi - s.lo
        texts = [pad + b" ".join(s.text(i).lower().split()) + bytes([_END]) for i in range(n)]
        size = np.array([len(x) for x in texts])
        b = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        gram = np.zeros(len(b) - depth, np.uint64)
        for j in range(depth + 1):
            gram = (gram << np.uint64(8)) | b[j : len(b) - depth + j]
        row = np.repeat(np.arange(n), size - depth)
        keep = np.arange(len(row)) + depth * row  # a row's first strings start in its padding
        w = T.words(s)
        yield s.lo, s.hi, gram[keep], row, np.concatenate([T.word_hashes(s, w, lower=True), np.full(n, _END_WORD)]), np.concatenate([w.doc, np.arange(n)]), train[s.lo : s.hi]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _groups(np.concatenate([p[0] for p in parts] + [np.zeros(0, np.uint64)]), np.concatenate([p[1] for p in parts] + [np.zeros(0, np.int64)]))


def _once(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash with the sum of a 0/1 count. Hashes of at most 63 bits are sorted together with it."""
    if h.max(initial=0) >> np.uint64(63):
        return _groups(h, count.astype(np.int64))
    u, n = np.unique((h << np.uint64(1)) | count.astype(np.uint64), return_counts=True)
    return _groups(u >> np.uint64(1), np.where(u & np.uint64(1), n, 0))


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((T.mix(h) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _packed(h: np.ndarray, n: np.ndarray, block: int, buckets: int, kind: type) -> pa.Table:
    bucket = _bucket_of(h, buckets)
    o = np.lexsort((h, bucket))
    own, first = np.unique(bucket[o], return_index=True)
    h, n = h[o], n[o].astype(kind)
    spans = list(zip(first.tolist(), [*first.tolist(), len(h)][1:], strict=True))
    return pa.table({"_bucket": pa.array(own.astype(np.int32)), "_block": pa.array(np.full(len(own), block), pa.int32()), "h": pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())})


def _count_block(depth: int, folds: int, out: int, buckets: int, words: bool):
    def one(key, t):
        parts = []
        for _, _, gram, row, word, at, train in _streams(t, depth, folds, out):
            h, r = (word, at) if words else (gram, row)
            parts.append(_once(h, train[r]))
            if len(parts) > 6:
                parts = [_counted(parts)]
        return _packed(*_counted(parts), key[0].as_py(), buckets, np.uint32)

    return one


def _unpacked(t: pa.Table, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, values, and the row of each."""
    hs = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
    ns = [np.frombuffer(x, kind) for x in t.column("n").to_pylist()]
    return np.concatenate([*hs, np.zeros(0, np.uint64)]), np.concatenate([*ns, np.zeros(0, kind)]), np.repeat(np.arange(len(hs)), [len(x) for x in hs])


def _sum_grams(parts: int):
    """Of a bucket of strings: the training count of each, on to the trees' parts."""

    def one(t):
        h, n, _ = _unpacked(t)
        h, n = _groups(h, n.astype(np.int64))
        part = (T.mix((h >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(parts)).astype(np.int64)
        o = np.argsort(part, kind="stable")
        own, first = np.unique(part[o], return_index=True)
        spans = list(zip(first.tolist(), [*first.tolist(), len(h)][1:], strict=True))
        h, n = h[o], n[o]
        return pa.table({"part": pa.array(own.astype(np.int32)), "h": pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())})

    return one


def _top_sums(depth: int):
    def one(t):
        h, n, _ = _unpacked(t, np.int64)
        tree = Subtree(h, n, depth)
        key, _, _, _ = tree.levels[2]
        up, s = _groups(key & np.uint64(0xFFFF), tree.top[1])
        _, a, b = _groups(key & np.uint64(0xFFFF), tree.levels[2][1], tree.levels[2][2])
        return pa.table({"key": pa.array(up.astype(np.int64)), "a": pa.array(a), "b": pa.array(b), "s": pa.array(s)})

    return one


def _probabilities(depth: int, top, buckets: int):
    def one(t):
        h, n, _ = _unpacked(t, np.int64)
        tree = Subtree(h, n, depth)
        out = [top.value.log10(h[i : i + 200_000], tree.bits(h[i : i + 200_000])) for i in range(0, len(h), 200_000)]
        return _packed(h, np.concatenate(out), 0, buckets, np.float32).drop_columns(["_block"])

    return one


def _answer(asked, known):
    """Of a bucket: each asking block's strings with their log10 probabilities."""
    h, p, _ = _unpacked(known, np.float32)
    o = np.argsort(h)
    h, p = h[o], p[o]
    back = [p[np.searchsorted(h, np.frombuffer(x, np.uint64))].tobytes() for x in asked.column("h").to_pylist()]
    return pa.table({"_block": asked.column("_block"), "kind": pa.array([0] * len(back), pa.int32()), "h": asked.column("h"), "n": pa.array(back, pa.binary())})


def _word_totals(t):
    """Of a bucket of words: counts back to the asking blocks, and (block -1) the numbers of tokens and of different ones."""
    h, n, row = _unpacked(t)
    u, total = _groups(h, n.astype(np.int64))
    back = [total[np.searchsorted(u, np.frombuffer(x, np.uint64))].tobytes() for x in t.column("h").to_pylist()]
    sums = np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()
    return pa.table({"_block": pa.array([*t.column("_block").to_pylist(), -1], pa.int32()), "kind": pa.array([1] * (len(back) + 1), pa.int32()), "h": pa.array([*t.column("h").to_pylist(), b""], pa.binary()), "n": pa.array([*back, sums], pa.binary())})


def _score_block(depth: int, folds: int, out: int, tokens: int, different: int):
    schema = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]

    def one(key, t, back):
        kind = np.array(back.column("kind").to_pylist(), np.int64)
        (gh, gp, _), (wh, wc, _) = _unpacked(back.filter(pa.array(kind == 0)), np.float32), _unpacked(back.filter(pa.array(kind == 1)), np.int64)
        o = np.argsort(gh)
        gh, gp = gh[o], gp[o].astype(np.float64)
        o = np.argsort(wh)
        wh, wc = wh[o], wc[o]
        cols: list[list] = [[] for _ in range(6)]
        ids = T.ids(t.column("doc_id"))
        for lo, hi, gram, row, word, at, _ in _streams(t, depth, folds, out):
            n = hi - lo
            c = wc[np.searchsorted(wh, word)]
            base = np.log10((c + 0.5) / (tokens + 0.5 * (different + 1)))
            u, inverse = np.unique(gram, return_inverse=True)
            p = gp[np.searchsorted(gh, u)][inverse]
            for k, v in enumerate((np.bincount(at, minlength=n), np.bincount(at[c > 0], minlength=n), np.bincount(at, base, n), np.bincount(row, p, n), np.bincount(row, minlength=n))):
                cols[k].append(v)
        cat = [np.concatenate(c) for c in cols[:5]]
        held = pa.array([None if i == T.NO_ID else not is_training(i, folds, out) for i in ids.tolist()], pa.bool_())
        return pa.table([T.id_array(ids), held, pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(np.full(len(ids), tokens), pa.int64()), pa.array(cat[2]), pa.array(cat[3]), pa.array(cat[4].astype(np.int64)), pa.array(-cat[3] / cat[4] * math.log2(10))], schema)

    return one


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def scored(docs: DataFrame, depth: int = DEPTH, folds: int = FOLDS, out: int = HELD_OUT, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Scores of every row of docs (doc_id, text) by a model of the rows outside the fold ``out``; depth is 3 to 6."""
    spark = docs.sparkSession
    docs, blocks = T.with_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), block_docs)
    buckets = 4 * blocks
    asked = written(docs.groupBy("_block").applyInArrow(_count_block(depth, folds, out, buckets, False), _FOUND))
    words = written(docs.groupBy("_block").applyInArrow(_count_block(depth, folds, out, buckets, True), _FOUND).groupBy("_bucket").applyInArrow(_word_totals, "_block int, kind int, h binary, n binary"))
    sums = words.where("_block = -1").select("n").collect()  # two numbers a bucket
    tokens, different = (int(x) for x in np.sum([np.frombuffer(r["n"], np.int64) for r in sums], axis=0)) if sums else (0, 0)
    grams = written(asked.groupBy("_bucket").applyInArrow(_sum_grams(min(4096, 2 * buckets)), "part int, h binary, n binary"))
    rows = grams.groupBy("part").applyInArrow(_top_sums(depth), "key long, a long, b long, s double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("s").alias("s")).collect()  # 65,536 rows at most
    rows.sort()
    key, a, b = (np.array([r[c] for r in rows], np.int64) for c in ("key", "a", "b"))
    top = spark.sparkContext.broadcast(Top(key, a, b, np.array([r["s"] for r in rows], float)))
    known = grams.groupBy("part").applyInArrow(_probabilities(depth, top, buckets), "_bucket int, h binary, n binary")
    back = asked.groupBy("_bucket").cogroup(known.groupBy("_bucket")).applyInArrow(_answer, "_block int, kind int, h binary, n binary")
    back = back.unionByName(words.where("_block >= 0"))
    return docs.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(_score_block(depth, folds, out, tokens, different), SCHEMA)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op5_context_tree": op5_context_tree}
ORACLES: dict[str, str] = {}
