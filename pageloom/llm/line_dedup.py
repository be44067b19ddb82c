"""Line dedup by pairwise alignment.

Documents that share a line are found through hashes: every line of some words, and every shortest run
of lines with enough words to be deleted, that also stands in a document with a smaller doc_id, however
many hold it, names the first such document as a partner. The runs that begin or end at a line cover
every block that may go, so that each such block names a document that holds it, or the runs it is made
of, whole. A document has at most three partners a line, and a group of copies has one partner in common
and no pairs among itself.
Each document is aligned with its partners by patience diff: the longest increasing chain of common
lines that are unique on both sides, again between the links of the chain, and equal lines at both
ends of a gap. Blocks of consecutive aligned lines that hold enough words are deleted from the later
document.

Hashes go to buckets once a block of documents, so that a line of a third of all documents is one
row a block.

Defined cases: a null or empty text has no line to delete (and stays null in ``deduplicated``); lines
are compared without the white space around them; blank lines never name a partner; a null doc_id is
after all others; rows that repeat a doc_id are not partners of each other; an empty table gives an
empty result; other columns are carried unchanged, but ``n_chars``, if there, is the new length.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .shared import table, written
from .substring_dedup import _narrow, _wide

LINE_WORDS = 3  # words of a line that may name a partner
BLOCK_WORDS = 8  # words of an aligned block that is deleted
BLOCK_DOCS = 4096


class Lines:
    """The lines of a slice: spans without white space around, rows, words, hashes."""

    def __init__(self, s: T.Slice) -> None:
        n, rows = len(s.buf), s.hi - s.lo
        size = np.diff(s.offsets)
        begins = np.zeros(n + 1, bool)
        begins[s.offsets[:-1][size > 0]] = True
        ends_row = np.zeros(n + 1, bool)
        ends_row[s.offsets[1:]] = True
        after = np.flatnonzero(s.buf == 10) + 1
        begins[after[~ends_row[after]]] = True
        self.raw = np.flatnonzero(begins[:n])
        self.row = np.searchsorted(s.offsets, self.raw, "right") - 1
        stop = np.append(self.raw[1:], n)
        if n:
            solid = ~T._SPACE[s.buf]
            at = np.arange(n)
            nxt = np.append(np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1], n)
            before = np.append(-1, np.maximum.accumulate(np.where(solid, at, -1)))
            a = np.minimum(nxt[self.raw], stop)
            b = np.maximum(before[stop] + 1, a)
            w = T.words(s)
            self.words = np.searchsorted(w.start, stop) - np.searchsorted(w.start, self.raw)
            self.hash = T.spans_hash(s.buf, a, b)
        else:
            self.words, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.row, np.arange(rows + 1))


def seeds(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that name partners, and their rows: lines, and the shortest runs of BLOCK_WORDS words from each line on and up to each line."""
    n = len(x.hash)
    line = np.flatnonzero(x.words >= LINE_WORDS)
    if not n:
        return x.hash[line], x.row[line]
    total = np.append(0, np.cumsum(x.words))
    at = np.arange(n)
    stop = np.searchsorted(total, total[:n] + BLOCK_WORDS)  # of the run that begins at a line
    ok = stop <= x.first[x.row + 1]
    begin = np.searchsorted(total, total[1:] - BLOCK_WORDS, "right") - 1  # of the run that ends at a line
    back = (begin >= x.first[x.row]) & (total[1:] - total[x.first[x.row]] >= BLOCK_WORDS)
    a, b = np.append(at[ok], begin[back]), np.append(stop[ok], at[back] + 1)
    a, b = a[b - a > 1], b[b - a > 1]  # one line is there already
    p = T.powers(T._STEP, n)
    sums = np.append(np.uint64(0), np.cumsum(x.hash * p, dtype=np.uint64))
    run = T.mix((sums[b] - sums[a]) * T.powers(pow(T._STEP, -1, 1 << 64), n)[a] + (b - a).astype(np.uint64))
    return np.append(x.hash[line], run), np.append(x.row[line], x.row[a])


def patience(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict[int, int] = {}
        for i in range(a, b):
            once[x[i]] = -1 if x[i] in once else i
        twice: dict[int, int] = {}
        for j in range(c, d):
            twice[y[j]] = -1 if y[j] in twice else j
        both = sorted((i, twice[k]) for k, i in once.items() if i >= 0 and twice.get(k, -1) >= 0)
        # the longest chain with increasing second position
        tails: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(both):
            p = bisect.bisect_left(tails, j)
            if p == len(tails):
                tails.append(j)
                last.append(k)
            else:
                tails[p], last[p] = j, k
            back.append(last[p - 1] if p else -1)
        chain, k = [], last[-1] if last else -1
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        if chain:
            p, q = a, c
            for i, j in chain[::-1]:
                out.append((i, j))
                todo.append((p, i, q, j))
                p, q = i + 1, j + 1
            todo.append((p, b, q, d))
    return sorted(out)


def _found(buckets: int):
    def one(key, t):
        hs, ds, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], T.ids(t.column("doc_id"))
        for s in T.slices(t.column("text")):
            h, row = seeds(Lines(s))
            hs.append(h)
            ds.append(ids[s.lo + row])
        h, d = np.concatenate(hs), np.concatenate(ds)
        o = np.lexsort((d, h))
        h, d = h[o], d[o]
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
        h, d = h[new], d[new]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)] if len(h) else np.zeros(0, np.int64)
        h, lo, n = h[at], d[at], np.diff(np.append(at, len(h)))
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        own, first = np.unique(bucket, return_index=True)
        spans = list(zip(first.tolist(), [*first.tolist(), len(h)][1:], strict=True))
        pack = lambda v, f: pa.array([f(v[a:b]) for a, b in spans], pa.binary())
        return pa.table({"_bucket": pa.array(own.astype(np.int32)), "_block": pa.array([key[0].as_py()] * len(own), pa.int32()), "h": pack(h, np.ndarray.tobytes), "lo": pack(lo, _narrow), "n": pack(n.astype(np.uint32), np.ndarray.tobytes)})

    return one


def _merged(t):
    """Of a bucket of hashes: those of several documents, back to the blocks, with the first document."""
    hs = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
    h, lo = np.concatenate(hs), np.concatenate([_wide(x) for x in t.column("lo").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("n").to_pylist()]).astype(np.int64)
    row = np.repeat(np.arange(len(hs)), [len(v) for v in hs])
    o = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.append(True, h[o][1:] != h[o][:-1]))
    size = np.diff(np.append(at, len(h)))
    first, total = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    first[o], total[o] = np.repeat(np.minimum.reduceat(lo[o], at), size), np.repeat(np.add.reduceat(n[o], at), size)
    keep = total > 1
    blocks, out = t.column("_block").to_pylist(), []
    for i in range(len(hs)):
        a, b = np.searchsorted(row, (i, i + 1))
        k = np.arange(a, b)[keep[a:b]]
        if len(k):
            out.append((blocks[i], h[k].tobytes(), _narrow(first[k])))
    cols = list(zip(*out, strict=True)) or [[]] * 3
    del hs, h, lo, n, row, o, first, total, keep
    T.released()
    return pa.table({"_block": pa.array(cols[0], pa.int32()), "h": pa.array(cols[1], pa.binary()), "lo": pa.array(cols[2], pa.binary())})


def _partners(key, t, back):
    """The pairs of a document and an earlier one that holds one of its lines or runs first."""
    h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in back.column("h").to_pylist())])
    lo = np.concatenate([np.zeros(0, np.int64), *map(_wide, back.column("lo").to_pylist())])
    o = np.argsort(h)
    h, lo = h[o], lo[o]
    ids, pairs = T.ids(t.column("doc_id")), set()
    for s in T.slices(t.column("text")) if len(h) else ():
        x, row = seeds(Lines(s))
        at = np.minimum(np.searchsorted(h, x), len(h) - 1)
        own = ids[s.lo + row]
        k = np.flatnonzero((h[at] == x) & (lo[at] < own))
        pairs.update(zip(own[k].tolist(), lo[at[k]].tolist(), strict=True))
    cols = list(zip(*sorted(pairs), strict=True)) or [[], []]
    return pa.table({"_block": pa.array([key[0].as_py()] * len(cols[0]), pa.int32()), "later": pa.array(cols[0], pa.int64()), "earlier": pa.array(cols[1], pa.int64())})


def _line_hashes(key, t, wanted):
    want, out = set(wanted.column("earlier").to_pylist()), []
    ids = T.ids(t.column("doc_id"))
    for s in T.slices(t.column("text")) if want else ():
        if want.isdisjoint(ids[s.lo : s.hi].tolist()):
            continue
        x = Lines(s)
        for i, d in enumerate(ids[s.lo : s.hi].tolist()):
            if d in want:  # of rows with the same doc_id, each
                out.append((d, x.hash[x.first[i] : x.first[i + 1]].tobytes()))
    cols = list(zip(*out, strict=True)) or [[], []]
    return pa.table({"earlier": pa.array(cols[0], pa.int64()), "lines": pa.array(cols[1], pa.binary())})


def removed_lines(own: list[int], words: list[int], partners: list[list[int]]) -> set[int]:
    """The lines of a document in aligned blocks of at least BLOCK_WORDS words."""
    gone: set[int] = set()
    for other in partners:
        block: list[int] = []
        before = (-9, -9)
        for i, j in [*patience(other, own), (-5, -5)]:
            if (i, j) != (before[0] + 1, before[1] + 1):
                if sum(words[k] for k in block) >= BLOCK_WORDS:
                    gone.update(block)
                block = []
            block.append(j)
            before = (i, j)
    return gone


def _cut(text_at: int, chars_at: int | None, digest: bool, block: str):
    def one(key, t, sent):
        partners: dict[int, list[int]] = {}
        lines: dict[int, list[list[int]]] = {}
        for d, e, x in zip(sent.column("later").to_pylist(), sent.column("earlier").to_pylist(), sent.column("lines").to_pylist(), strict=True):
            if x is None:
                partners.setdefault(d, []).append(e)
            else:
                lines.setdefault(e, []).append(np.frombuffer(x, np.uint64).tolist())
        t = t.drop_columns([block])
        ids, texts, n_lines, n_gone = T.ids(t.column("doc_id")), [], [], []
        null = t.column(text_at).is_null().to_pylist()
        for s in T.slices(t.column(text_at)):
            x = Lines(s)
            for i in range(s.hi - s.lo):
                a, b = x.first[i], x.first[i + 1]
                raw = s.text(i)
                n_lines.append(int(b - a))
                mine = [x for e in partners.get(int(ids[s.lo + i]), ()) for x in lines[e]]
                gone = removed_lines(x.hash[a:b].tolist(), x.words[a:b].tolist(), mine) if mine else ()
                if gone:
                    raw = b"\n".join(v for k, v in enumerate(raw.split(b"\n")) if k not in gone)
                n_gone.append(len(gone))
                texts.append(None if null[s.lo + i] else raw.decode())
        if digest:
            return pa.table({"doc_id": t.column("doc_id"), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array([hashlib.sha256((v or "").encode()).hexdigest() for v in texts], pa.string())})
        new = t.set_column(text_at, t.schema.field(text_at), pa.array(texts, pa.string()))
        if chars_at is not None:
            length = [None if v is None else len(v) for v in texts]
            new = new.set_column(chars_at, t.schema.field(chars_at), pa.array(length, pa.int64()).cast(t.schema.field(chars_at).type))
        emptied = [n > 0 and not (v or "").strip() for n, v in zip(n_gone, texts, strict=True)]
        return new.filter(pa.array([not e for e in emptied], pa.bool_()))

    return one


def _run(docs: DataFrame, digest: bool, block_docs: int = BLOCK_DOCS) -> DataFrame:
    schema, name = docs.schema, "_block"
    while name in docs.columns:  # a column of the input may have this name
        name += "_"
    dealt, n = T.with_blocks(docs, block_docs, name)
    back = dealt.groupBy(name).applyInArrow(_found(2 * n), "_bucket int, _block int, h binary, lo binary, n binary").groupBy("_bucket").applyInArrow(_merged, "_block int, h binary, lo binary")
    pairs = written(dealt.groupBy(name).cogroup(back.groupBy("_block")).applyInArrow(_partners, "_block int, later long, earlier long"))
    wanted = pairs.select("earlier").distinct().withColumn("_block", F.pmod(F.xxhash64("earlier"), F.lit(n)).cast("int"))
    lines = dealt.groupBy(name).cogroup(wanted.groupBy("_block")).applyInArrow(_line_hashes, "earlier long, lines binary")
    # a partner's lines go once to each block that has documents to align with it
    whole = pairs.select("_block", "earlier").distinct().join(lines, "earlier").select("_block", F.lit(None).cast("long").alias("later"), "earlier", "lines")
    sent = pairs.select("_block", "later", "earlier", F.lit(None).cast("binary").alias("lines")).unionByName(whole)
    names = [f.name for f in schema]
    chars = names.index("n_chars") if "n_chars" in names else None
    out = "doc_id long, n_lines long, n_removed long, kept_sha256 string" if digest else schema
    return dealt.groupBy(name).cogroup(sent.groupBy("_block")).applyInArrow(_cut(names.index("text"), chars, digest, name), out)


def deduplicated(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs (with doc_id and text) without the repeated blocks; documents of which nothing is left go."""
    return _run(docs, False, block_docs)


def removals(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by line ends) of every row."""
    return _run(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), True, block_docs)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES: dict[str, str] = {}
