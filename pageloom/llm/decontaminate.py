"""Benchmark decontamination by greedy string tiling.

Documents that share a seed (five consecutive words, lower-cased, without punctuation) with a
benchmark item are tiled against it: the longest common run of unmarked words is found by
Karp-Rabin hashing and marked, again and again, until no run of five words is left. The share of the
item's words that tiles cover is what counts, so that passages whose parts were put in another order
are caught too. A pair is found through the item's rarer seeds: its most common ones are left out of
the search, as many as no pair over the threshold needs, and come back in the tiling.

The benchmark is broadcast in chunks of a checked size (``CHUNK_BYTES``), each tried against all
documents in one pass over them without a shuffle; a larger benchmark means more passes.

Defined cases: null or empty texts match nothing; a null doc_id or item_id stays null and matches like
any other; repeated documents and repeated items are each reported; of matches of a length the one
that stands first in the item, then in the document, is marked first; an item of fewer than five
words matches where it stands whole; an empty table gives an empty result; of other columns
``filtered`` carries all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .shared import table

MIN_RUN = 5  # words of the shortest tile, and of a seed
COVERAGE = 0.5
CHUNK_BYTES = 16 << 20  # of benchmark texts in one broadcast

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SCHEMA = "doc_id long, item_id long, n_item_words long, n_tiled long, n_tiles long, coverage double"


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


class Index:
    """Items' word hashes, and keys -> items as sorted arrays.

    Keys are the seeds of an item but for its most common ones, as many as a document over the threshold
    can't do without: tiles of ``c`` words hold at least ``c / MIN_RUN`` of the item's windows. An item
    with fewer words than a seed has one key, all its words.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], coverage: float = COVERAGE) -> None:
        self.item_id, self.words, self.seeds = [], [], []
        short: dict[int, list] = {}
        for item_id, text in items:
            for s in T.slices(_lowered(pa.array([text or ""], pa.string())), 1 << 62):
                h = T.word_hashes(s, T.words(s, _GAP))
                if len(h) >= MIN_RUN:
                    self.seeds.append(np.unique(T.window_hashes(h, MIN_RUN), return_counts=True))
                    self.item_id.append(item_id)
                    self.words.append(h)
                elif len(h):
                    short.setdefault(len(h), []).append((T.window_hashes(h, len(h))[0], item_id))
        self.short = {n: (np.array([h for h, _ in v], np.uint64), [i for _, i in v]) for n, v in short.items()}
        common, n = np.unique(np.concatenate([v for v, _ in self.seeds] + [np.zeros(0, np.uint64)]), return_counts=True)
        keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (v, times) in enumerate(self.seeds):
            o = np.argsort(-n[np.searchsorted(common, v)], kind="stable")
            spare = -(-coverage * len(self.words[i]) // MIN_RUN) - 1
            k = o[np.cumsum(times[o]) > spare]
            keys.append(v[k])
            owner.append(np.full(len(k), i))
        key, own = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], own[order]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_RUN) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in item, start in doc, length), longest first, then by place."""
    free_i, free_d, out = np.ones(len(item), bool), np.ones(len(doc), bool), []
    size = max(least, min(len(item), len(doc)))
    while True:
        # Karp-Rabin: hashes of the unmarked runs of this size on both sides
        wi, wd = T.window_hashes(item, size), T.window_hashes(doc, size)
        if len(wi) and len(wd):
            full = lambda free, n: np.flatnonzero(np.convolve(free, np.ones(size, np.int64), "valid")[:n] == size)
            at: dict[int, list[int]] = {}
            for j in full(free_d, len(wd)).tolist():
                at.setdefault(int(wd[j]), []).append(j)
            found = []
            for i in full(free_i, len(wi)).tolist():
                for j in at.get(int(wi[i]), ()):
                    if i and j and free_i[i - 1] and free_d[j - 1] and item[i - 1] == doc[j - 1]:
                        continue  # part of a longer one
                    k = size
                    while i + k < len(item) and j + k < len(doc) and free_i[i + k] and free_d[j + k] and item[i + k] == doc[j + k]:
                        k += 1
                    found.append((-k, i, j))
            heapq.heapify(found)
            while found:
                k, i, j = heapq.heappop(found)
                free = free_i[i : i - k] & free_d[j : j - k]
                if free.all():
                    free_i[i : i - k] = False
                    free_d[j : j - k] = False
                    out.append((i, j, -k))
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if b - a >= size:  # shorter rests are found again with smaller sizes
                        heapq.heappush(found, (a - b, i + a, j + a))
        if size == least:
            return out
        size = max(least, size // 2)


def _matches(s: T.Slice, index: Index, coverage: float) -> list[tuple]:
    """(row of the slice, item_id, words, tiled, tiles, coverage) of the pairs over the threshold."""
    w = T.words(s, _GAP)
    h = T.word_hashes(s, w)
    out = []
    for n, (whole, ids) in index.short.items():
        runs = T.window_hashes(h, n)
        at = np.flatnonzero(np.isin(runs, whole) & (w.doc[: len(runs)] == w.doc[n - 1 :]))
        for row, v in sorted({(int(w.doc[p]), int(runs[p])) for p in at.tolist()}):
            out += [(row, ids[k], n, n, 1, 1.0) for k in np.flatnonzero(whole == np.uint64(v)).tolist()]
    win = T.window_hashes(h, MIN_RUN)
    if not len(win) or not len(index.key):
        return out
    lo = np.searchsorted(index.key, win)
    hit = np.flatnonzero((index.key[np.minimum(lo, len(index.key) - 1)] == win) & (w.doc[: len(win)] == w.doc[MIN_RUN - 1 :]))
    lo, many = lo[hit], np.searchsorted(index.key, win[hit], "right") - lo[hit]
    pairs = [np.zeros(0, np.int64)]
    a = 0
    while a < len(hit):  # hits and their owners, about a million at a time
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(many[a : a + 1_000_000]), 1_000_000)))
        at = np.repeat(lo[a:b], many[a:b]) + np.arange(many[a:b].sum()) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b])
        pairs.append(np.unique(np.repeat(w.doc[hit[a:b]], many[a:b]) * len(index.words) + index.owner[at]))
        a = b
    for pair in np.unique(np.concatenate(pairs)).tolist():
        row, own = divmod(pair, len(index.words))
        item, first, end = index.words[own], w.first[row], w.first[row + 1]
        # no tile lies outside the document's windows that are seeds of the item
        at = first + np.flatnonzero(np.isin(win[first : end - MIN_RUN + 1], index.seeds[own][0]))
        covered = np.unique((at[:, None] + np.arange(MIN_RUN)).ravel())
        if min(len(covered), len(item)) < coverage * len(item):
            continue
        gaps = np.flatnonzero(np.diff(covered) > 1) + 1
        doc = np.concatenate([x for part in np.split(h[covered], gaps) for x in (part, [np.uint64(row)])])
        t = tiles(item, doc)
        n = sum(k for _, _, k in t)
        if n >= coverage * len(item):
            out.append((row, index.item_id[own], len(item), n, len(t), n / len(item)))
    return out


def _chunks(benchmark: DataFrame, chunk_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The pairs of a document and a benchmark item of whose words at least ``coverage`` lie in tiles."""
    spark, out = docs.sparkSession, None
    for items in _chunks(benchmark, chunk_bytes):
        index = spark.sparkContext.broadcast(Index(items, coverage))

        def rows(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in T.slices(_lowered(b.column(1))):
                    m = _matches(s, index.value, coverage)
                    if m:
                        row, *rest = zip(*m, strict=True)
                        doc = b.column(0).slice(s.lo, s.hi - s.lo).take(pa.array(row, pa.int64()))
                        yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int64()) for c in rest[:4]), pa.array(rest[4], pa.float64())], SCHEMA.replace(",", "").split()[::2])

        got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out


def filtered(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` without those that hold a benchmark item; no shuffle."""
    at = docs.columns.index("text")
    for items in _chunks(benchmark, chunk_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, coverage))

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                for s in T.slices(_lowered(b.column(at))):
                    ok[[s.lo + m[0] for m in _matches(s, index.value, coverage)]] = False
                yield b.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES: dict[str, str] = {}
