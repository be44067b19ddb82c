"""Substring dedup by level-wise doubling.

A window of words can only repeat in another document if its halves do. So the first level looks at
half windows (of each full window the one with the smallest hash, which equal windows choose
alike), the next extends those that repeat to the full window, and ``longest_repeats`` goes on to
twice that length, and so on, until no candidate survives. At each level the documents, dealt into
blocks by a hash of doc_id, send every different window hash once a block with the smallest and
largest doc_id there; what comes back to a block are the hashes that repeat, with the smallest
doc_id of all.

A window of a hot passage is thus one row a block, not one a document. Windows are 64-bit hashes.

Defined cases: a null or blank text has no words; a null doc_id comes after all others and is never
smaller than another; rows that repeat a doc_id are one document's and never remove each other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .shared import table, written

WINDOW = 13
BLOCK_DOCS = 4096  # documents of a block, on average
#: What a block sends to a bucket: sorted hashes, the smallest doc_id with each, and a bit for those in several of its documents.
_FOUND = "_bucket int, _block int, h binary, lo binary, several binary"
#: What comes back: the hashes that repeat, with the smallest doc_id of all.
_BACK = "_block int, h binary, lo binary"


def _smallest(h: np.ndarray, k: int) -> np.ndarray:
    """The minimum of each k consecutive entries."""
    n = len(h) - k + 1
    m = h[:n].copy()
    for j in range(1, k):
        np.minimum(m, h[j : j + n], out=m)
    return m


def _inside(w: T.Words, k: int) -> np.ndarray:
    """Whether each window of k words lies in one row."""
    n = len(w.doc) - k + 1
    return w.doc[:n] == w.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def _narrow(x: np.ndarray) -> bytes:
    """Integers as their minimum and 32-bit differences, or as they are where those don't fit."""
    if not len(x):
        return b""
    least = x.min()
    if x.max() - least < 1 << 32 and x.max() != T.NO_ID:
        return b"\x00" + np.int64(least).tobytes() + (x - least).astype(np.uint32).tobytes()
    return b"\x01" + x.tobytes()


def _wide(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    if b[0]:
        return np.frombuffer(b, np.int64, offset=1)
    return np.frombuffer(b, np.uint32, offset=9).astype(np.int64) + np.frombuffer(b, np.int64, 1, 1)[0]


def _unique(h: list[np.ndarray], doc: list[np.ndarray], block: int, buckets: int) -> pa.Table:
    """Each hash once, in a row for each bucket of hashes."""
    x, d = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((h, np.uint64), (doc, np.int64)))
    order = np.argsort(x, kind="stable")
    x, d = x[order], d[order]
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    lo, hi = (f.reduceat(d, at) if len(at) else d for f in (np.minimum, np.maximum))
    x, several = x[at], lo < hi
    # hashes that were chosen as the smallest of some are mixed again, so that buckets are even
    bucket = ((T.mix(x) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    x, lo, several = x[order], lo[order], several[order]
    own, first = np.unique(bucket[order], return_index=True)
    spans = list(zip(first.tolist(), [*first.tolist(), len(x)][1:], strict=True))
    return pa.table({
        "_bucket": pa.array(own.astype(np.int32)), "_block": pa.array(np.full(len(own), block), pa.int32()), "h": pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()),
        "lo": pa.array([_narrow(lo[a:b]) for a, b in spans], pa.binary()), "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary()),
    })


def _half_windows(size: int, buckets: int):
    """Level one: of each window of ``size`` words its half window with the smallest hash."""
    half = size // 2 + 1

    def one(key, t):
        hs, docs, ids = [], [], T.ids(t.column("doc_id"))
        for s in T.slices(t.column("text")):
            w = T.words(s)
            ok = _inside(w, size)
            if not ok.any():
                continue
            h = T.window_hashes(T.word_hashes(s, w), half)
            m = _smallest(h, size - half + 1)
            chosen = np.zeros(len(h), bool)
            for k in range(size - half + 1):
                chosen[k : k + len(m)] |= ok & (h[k : k + len(m)] == m)
            at = np.flatnonzero(chosen)
            hs.append(h[at])
            docs.append(ids[s.lo + w.doc[at]])
        return _unique(hs, docs, key[0].as_py(), buckets)

    return one


def _known(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(t.column("h").to_pylist()), np.uint64)
    lo = np.concatenate([np.zeros(0, np.int64), *map(_wide, t.column("lo").to_pylist())])
    order = np.argsort(h)
    return h[order], lo[order]


def _find(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known) or not len(h):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


def _windows(size: int, before: int, halves: bool, buckets: int):
    """A later level: windows of ``size`` words both of whose parts of ``before`` words repeat, or whose chosen half does."""

    def one(key, t, back):
        hs, docs, ids = [], [], T.ids(t.column("doc_id"))
        known, _ = _known(back)
        for s in T.slices(t.column("text")) if len(known) else ():
            w = T.words(s)
            ok = _inside(w, size)
            if not ok.any():
                continue
            wh = T.word_hashes(s, w)
            part = T.window_hashes(wh, before)
            if halves:
                ok &= _find(known, _smallest(part, size - before + 1))[1]
            else:
                hit = _find(known, part)[1]
                ok &= hit[: len(ok)] & hit[size - before :]
            at = np.flatnonzero(ok)
            hs.append(T.window_hashes(wh, size)[at])
            docs.append(ids[s.lo + w.doc[at]])
        return _unique(hs, docs, key[0].as_py(), buckets)

    return one


def _merge(t: pa.Table) -> pa.Table:
    """Of one bucket of hashes: those that are in two documents, back to each block that has them."""
    hs = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
    blocks = t.column("_block").to_pylist()
    h, lo = np.concatenate(hs), np.concatenate([_wide(x) for x in t.column("lo").to_pylist()])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, v in zip(t.column("several").to_pylist(), hs, strict=True)]) > 0
    row = np.repeat(np.arange(len(hs)), [len(v) for v in hs])
    order = np.argsort(h, kind="stable")
    h, lo, several, row = h[order], lo[order], several[order], row[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(at, len(h)))
    first = np.repeat(np.minimum.reduceat(lo, at), size)
    # blocks share no doc_id, so that two rows are two documents
    twice = np.repeat((size > 1) | np.logical_or.reduceat(several, at), size)
    h, first, row = h[twice], first[twice], row[twice]
    order = np.argsort(row, kind="stable")
    h, first = h[order], first[order]
    cut = np.searchsorted(row[order], np.arange(len(hs) + 1))
    some = [i for i in range(len(hs)) if cut[i] < cut[i + 1]]
    return pa.table({"_block": pa.array([blocks[i] for i in some], pa.int32()), "h": pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), "lo": pa.array([_narrow(first[cut[i] : cut[i + 1]]) for i in some], pa.binary())})


def _repeated(found: DataFrame) -> DataFrame:
    return found.groupBy("_bucket").applyInArrow(_merge, _BACK)


class Levels:
    """The levels over some documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, block_docs: int = BLOCK_DOCS) -> None:
        self.docs, n = T.with_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), block_docs)
        self.buckets = 2 * n

    def first(self, size: int) -> DataFrame:
        return _repeated(self.docs.groupBy("_block").applyInArrow(_half_windows(size, self.buckets), _FOUND))

    def next(self, back: DataFrame, size: int, before: int, halves: bool = False) -> DataFrame:
        return _repeated(self.docs.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(_windows(size, before, halves, self.buckets), _FOUND))

    def full(self, size: int) -> DataFrame:
        """_block, h, lo: the hashes of windows of ``size`` words that are in two documents."""
        if size < 4:
            return _repeated(self.docs.groupBy("_block").applyInArrow(_all_windows(size, self.buckets), _FOUND))
        return self.next(self.first(size), size, size // 2 + 1, halves=True)


def _all_windows(size: int, buckets: int):
    def one(key, t):
        hs, docs, ids = [], [], T.ids(t.column("doc_id"))
        for s in T.slices(t.column("text")):
            w = T.words(s)
            at = np.flatnonzero(_inside(w, size))
            hs.append(T.window_hashes(T.word_hashes(s, w), size)[at])
            docs.append(ids[s.lo + w.doc[at]])
        return _unique(hs, docs, key[0].as_py(), buckets)

    return one


def covered(s: T.Slice, w: T.Words, ids: np.ndarray, known: np.ndarray, lo: np.ndarray, size: int) -> np.ndarray:
    """The words of a slice that a window covers which also starts in a document with a smaller id."""
    out = np.zeros(len(w.doc), bool)
    ok = _inside(w, size)
    if ok.any() and len(known):
        at, hit = _find(known, T.window_hashes(T.word_hashes(s, w), size))
        starts = np.flatnonzero(hit & ok & (lo[at] < ids[w.doc[: len(ok)]]))
        change = np.zeros(len(w.doc) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + size, -1)
        out = np.cumsum(change[:-1]) > 0
    return out


def deduplicated(docs: DataFrame, size: int = WINDOW, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words (joined by one space) of every row."""
    levels = Levels(docs, block_docs)

    def cut(key, t, back):
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        ids = T.ids(t.column("doc_id"))
        known, lo = _known(back)
        for s in T.slices(t.column("text")):
            w = T.words(s)
            gone = covered(s, w, ids[s.lo : s.hi], known, lo, size)
            for i in range(s.hi - s.lo):
                a, b = w.first[i], w.first[i + 1]
                text = s.text(i).split()
                own = gone[a:b]
                n = int(own.sum())
                kept = b" ".join(compress(text, (~own).tolist()) if n else text)
                out["n_words"].append(int(b - a))
                out["n_removed"].append(n)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            out["doc_id"].append(ids[s.lo : s.hi])
        doc_id = T.id_array(np.concatenate(out.pop("doc_id"))) if ids.size else pa.array([], pa.int64())
        return pa.table({"doc_id": doc_id, "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary()).cast(pa.string())})

    return levels.docs.groupBy("_block").cogroup(levels.full(size).groupBy("_block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def _hashes(column: str):
    """The hashes of a packed column, as hexadecimal text."""
    return F.transform(F.sequence(F.lit(0), (F.octet_length(column) / 8).cast("int") - 1), lambda i: F.hex(F.substring(F.col(column), i * 8 + 1, F.lit(8))))


def longest_repeats(docs: DataFrame, size: int = WINDOW, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """window, n: for each doubled length the number of different windows that repeat, until there is none. One job a level."""
    levels, out = Levels(docs, block_docs), []
    back, length = written(levels.full(size)), size
    while n := back.select(F.explode(_hashes("h")).alias("h")).distinct().count():
        out.append((length, n))
        back, length = written(levels.next(back, 2 * length, length)), 2 * length
    return docs.sparkSession.createDataFrame(out, "window int, n long")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t)),
rep AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT rid, i + k AS i FROM rep, range(0, 13) r(k)),
words AS (SELECT rid, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS s, count(*) AS n FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (rid)
"""
QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES = {"op9_substring_dedup": ORACLE_SQL}
