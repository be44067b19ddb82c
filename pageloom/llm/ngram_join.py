"""N-gram Jaccard join in metric space, exact, with the components of its links.

The Jaccard distance is a metric, and so is its numerator, the size of the symmetric difference,
which a link bounds by a share of the two sizes. The join goes down through regions:

1. The first pivots are sets of one shingle. A document is at distance ``1 - 1/n`` from each of its n
   shingles and at 1 from all others, so its region is tied between its own; a link needs
   ``ceil(t*n)`` common shingles, so it is enough to replicate a document to the first
   ``n - ceil(t*n) + 1`` of them in an order of all shingles that puts frequent ones last. (Documents
   as first pivots separate nothing: nearly all are at distance 1 from any other document.)
2. Regions with one member go. The others are joined over parity sketches of the sets, whose Hamming
   distance never exceeds the symmetric difference: large regions are split again by member pivots
   into Voronoi regions, boundary members replicated by the triangle inequality's window, down to
   regions small enough to compare all.
3. What is left is verified on the whole sets. In a first round only a spanning forest of the
   candidate pairs is, and its links give components; a second round verifies all remaining pairs
   across components. So a group of many near copies makes a few links a member, not all pairs, and
   no link between different components is lost.

Shingles and sets are 64-bit hashes. Copies share one set and take part once.

Defined cases: a null or blank text has no shingles and is its own component; fewer words than a
shingle make one shingle of all; a null doc_id comes after all others as a component's id; repeated
rows are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .components import components
from .shared import discarded, table, written

SHINGLE, PERCENT = 4, 85
LATE = 200_000  # most frequent shingles that are put last in the order; broadcast
SMALL = 1024  # a region is split if it has more pairs than the square of this


def sets(s: T.Slice, k: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each row of a slice."""
    w = T.words(s)
    wh = T.word_hashes(s, w, lower=True)
    by_size = {j: T.window_hashes(wh, j) for j in range(1, k + 1)}
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(by_size[k][a : b - k + 1]))
        else:
            out.append(by_size[b - a][a : a + 1] if b > a else np.zeros(0, np.uint64))
    return out


def _sketch(x: np.ndarray) -> bytes:
    """The parities of the numbers of shingles by their low bits; more of them for larger sets."""
    bits = 8 if len(x) <= 200 else 10 if len(x) <= 1500 else 12 if len(x) <= 6000 else 14 if len(x) <= 40000 else 16
    return np.packbits(np.bincount((x & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


def _sid(x: np.ndarray) -> int:
    import xxhash

    v = xxhash.xxh3_64_intdigest(x.tobytes())
    return v - (1 << 64) if v >> 63 else v


def _nodes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id (T.NO_ID for null), n, sid, sketch of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = T.ids(b.column(0))
            for s in T.slices(b.column(1)):
                x = sets(s, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s.lo : s.hi]), pa.array([len(v) for v in x], pa.int32()), pa.array([_sid(v) for v in x], pa.int64()), pa.array([_sketch(v) if len(v) else b"" for v in x], pa.binary())], ["doc_id", "n", "sid", "sketch"])

    return docs.mapInArrow(rows, "doc_id long, n int, sid long, sketch binary")


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles by rising frequency, the most frequent ones only. Any order of shingles gives the same links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(1), 2 * T.SLICE_BYTES):
                different = {_sid(v): v for v in sets(s, k)}
                h, c = np.unique(np.concatenate([*different.values(), np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[c > 2].view(np.int64)), pa.array(c[c > 2].astype(np.int64))], ["h", "c"])

    got = docs.mapInArrow(rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(LATE)
    return np.array([r["h"] for r in got.orderBy("c", "h").collect()], np.int64).view(np.uint64)


def _first_regions(docs: DataFrame, k: int, percent: int, late: np.ndarray) -> DataFrame:
    """h, sid, n, top: each set's replicas in the regions of its first shingles, and the size of the largest partner there.

    The region that counts for a pair is that of its first common shingle. If that is a set's i-th, the
    two have at most n - i in common, which bounds the partner's size.
    """
    order = np.argsort(late)
    known = docs.sparkSession.sparkContext.broadcast((late[order], order))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = known.value
        seen: set[int] = set()
        for b in batches:
            for s in T.slices(b.column(1)):
                hs, sids, ns, tops = [], [], [], []
                for x in sets(s, k):
                    if not len(x) or (sid := _sid(x)) in seen:
                        continue
                    seen.add(sid)
                    n = len(x)
                    p = n + (-percent * n // 100) + 1
                    if len(late):
                        at = np.minimum(np.searchsorted(late, x), len(late) - 1)
                        is_late = late[at] == x
                        early = x[~is_late]
                        if len(early) < p:
                            early = np.concatenate([early, x[is_late][np.argsort(rank[at[is_late]])]])
                        x = early
                    hs.append(x[:p])
                    sids.append(np.full(p, sid))
                    ns.append(np.full(p, n))
                    tops.append((n - np.arange(p)) * (100 + percent) // percent - n)
                if len(seen) > 200_000:  # copies are then sent again, which changes nothing
                    seen.clear()
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(ns), pa.int32()), pa.array(np.concatenate(tops), pa.int32())], ["h", "sid", "n", "top"])

    return docs.mapInArrow(rows, "h long, sid long, n int, top int")


def _shared_regions(percent: int):
    """Of a bucket of replicas: those in whose region another set has a size that allows a link."""

    def one(t):
        h, sid, n, top = (t.column(c).to_numpy() for c in ("h", "sid", "n", "top"))
        o = np.lexsort((sid, n, h))
        o = o[np.append(True, (h[o][1:] != h[o][:-1]) | (sid[o][1:] != sid[o][:-1]))[: len(o)]]
        for _ in range(2):  # a second time without those that the first has excluded
            h, sid, n, top = h[o], sid[o], n[o].astype(np.int64), top[o].astype(np.int64)
            region = np.cumsum(np.append(False, h[1:] != h[:-1])[: len(h)]) << 32
            size = region + n
            first, end = np.searchsorted(size, region + -(-percent * n // 100)), np.searchsorted(size, region + top, "right")
            # some other set is small enough for this one, and this one is small enough for some set as large as any of those
            o = np.flatnonzero(end - first > (top >= n))
        out = pa.table({"h": h[o], "sid": sid[o]})
        del h, sid, n, top, region, size, first, end, o
        T.released()
        return out

    return one


class _Region:
    """The sets of one bucket and the search for pairs that may link."""

    def __init__(self, n: np.ndarray, sketches: list[bytes], percent: int) -> None:
        self.n, self.percent = n.astype(np.int64), percent
        self.width = np.array([len(c) for c in sketches], np.int64)
        self.folds: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by width: the row of each set, and the rows
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width >= w)
            row = np.full(len(sketches), -1)
            row[at] = np.arange(len(at))
            self.folds[w] = row, np.stack([self.folded(sketches[i], w) for i in at.tolist()])

    @staticmethod
    def folded(sketch: bytes, width: int) -> np.ndarray:
        """The sketch that fewer low bits give."""
        v = np.frombuffer(sketch, np.uint64)
        return v if len(sketch) == width else np.bitwise_xor.reduce(v.reshape(-1, width // 8), axis=0)

    def apart(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hamming distances of sketches folded to the smaller of two widths, and these widths in bits."""
        w, out = np.minimum(self.width[a], self.width[b]), np.zeros(len(a), np.int64)
        for one, (row, v) in self.folds.items():
            k = np.flatnonzero(w == one)
            if len(k):
                out[k] = np.bitwise_count(v[row[a[k]]] ^ v[row[b[k]]]).sum(-1, dtype=np.int64)
        return out, 8 * w

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of linked sets of these sizes; -1 if the sizes exclude a link."""
        t = self.n[a] + self.n[b]
        most = t - 2 * -(-self.percent * t // (100 + self.percent))
        return np.where(100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b]), most, -1)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that sketches don't exclude, and the symmetric difference that the sketches let expect over the largest that links."""
        out = []
        for i in range(0, len(a), 100_000):
            x, y = a[i : i + 100_000], b[i : i + 100_000]
            most = self.bound(x, y)
            ok = most >= 0
            x, y, most = x[ok], y[ok], most[ok]
            d, bits = self.apart(x, y)
            ok = d <= most
            x, y, most, d, bits = x[ok], y[ok], most[ok], d[ok], bits[ok]
            out.append((x, y, -np.log(np.maximum(1 - 2 * d / bits, 1e-9)) * bits / 2 / np.maximum(most, 1)))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def hubs(self, members: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of the member in the middle of those that no hub has joined yet and the others, as long as many get joined (in ``root``)."""
        row, v = self.folds[int(self.width[members].min())]
        while len(members) > SMALL // 4:
            own = v[row[members]]
            some = np.unpackbits(own[np.linspace(0, len(own) - 1, min(len(own), 1024)).astype(np.int64)].view(np.uint8), axis=1)
            middle = np.packbits(2 * some.sum(0) > len(some)).view(np.uint64)
            hub = members[np.bitwise_count(own ^ middle).sum(1, dtype=np.int64).argmin()]
            others = members[members != hub]
            yield self.may_link(np.full(len(others), hub), others)
            left = members[root[members] != root[hub]]
            if len(left) > 0.9 * len(members):
                return
            members = left

    def pairs(self, members: np.ndarray, root: np.ndarray | None = None, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Once each, the pairs of members of different roots that may link, but for pairs of two that are ``done``; without roots all that may link."""
        root = np.arange(len(self.n)) if root is None else root
        r, n = np.unique(root[members], return_counts=True)
        if len(r) > 1:
            most = root[members] == r[n.argmax()]
            if done is not None and done.sum() > most.sum():
                most = done
            yield from self._cells(members[~most], members[most], root)

    def _cells(self, home: np.ndarray, guest: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of a home member and another member: the home members' cells around pivots, with the guests within the window."""
        members, m = np.append(home, guest), len(home)
        if m * len(members) <= SMALL * SMALL or m <= SMALL // 16:
            yield from self._windows(home, guest, root)
            return
        row, v = self.folds[int(self.width[members].min())]
        pivots = home[np.argsort(self.n[home], kind="stable")[np.linspace(0, m - 1, 12).astype(np.int64)]]
        d = np.stack([np.bitwise_count(v[row[members]] ^ v[row[p]]).sum(1, dtype=np.int64) for p in pivots.tolist()], axis=1)
        cell, at_home = d.argmin(1), np.arange(len(members)) < m
        # a partner is at most so far away, whatever its size
        reach = (self.n[members] * (1 + 100 / self.percent) * (100 - self.percent) / (100 + self.percent)).astype(np.int64) + 1
        near = d - d.min(1)[:, None] <= 2 * reach[:, None]
        for p in range(len(pivots)):
            a = members[at_home & (cell == p)]
            b = members[near[:, p] & (~at_home | (cell > p))]
            if len(a) * (len(a) + len(b)) > 0.5 * m * len(members):
                yield from self._windows(a, b, root)
            elif len(a):
                yield from self._cells(a, b, root)

    def _windows(self, home: np.ndarray, guest: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same by comparing every pair whose sizes allow a link."""
        home, guest = home[np.argsort(self.n[home], kind="stable")], guest[np.argsort(self.n[guest], kind="stable")]
        n, most = self.n[home], 100 * self.n[home] // self.percent
        least = -(-self.percent * n // 100)
        for others, first, end in ((home, np.arange(1, len(home) + 1), np.searchsorted(n, most, "right")), (guest, np.searchsorted(self.n[guest], least), np.searchsorted(self.n[guest], most, "right"))):
            total = np.append(0, np.cumsum(end - first))
            i = 0
            while i < len(home):
                j = max(i + 1, int(np.searchsorted(total, total[i] + 500_000, "right")) - 1)
                size = end[i:j] - first[i:j]
                a = np.repeat(home[i:j], size)
                b = others[np.arange(len(a)) - np.repeat(np.cumsum(size) - size - first[i:j], size)]
                k = root[a] != root[b]
                yield self.may_link(a[k], b[k])
                i = j


def _regions(members, sketches, percent: int) -> tuple[np.ndarray, _Region, list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The different sets of a bucket in order, the large regions, and the pairs of the small ones. Members without a sketch are left out."""
    sid = sketches.column("own").to_numpy()
    o = np.argsort(sid)
    own = sid[o]
    region = _Region(sketches.column("n").to_numpy()[o], sketches.column("sketch").take(pa.array(o)).to_pylist(), percent)
    h, sid = members.column("h").to_numpy(), members.column("sid").to_numpy()
    at = np.minimum(np.searchsorted(own, sid), max(0, len(own) - 1))
    known = own[at] == sid if len(own) else np.zeros(len(sid), bool)
    h, at = h[known], at[known]
    o = np.lexsort((at, h))
    h, at = h[o], at[o]
    new = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))[: len(h)]
    h, at = h[new], at[new]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)] if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    large = [at[i : i + m] for i, m in zip(start[size > 48].tolist(), size[size > 48].tolist(), strict=True)]
    keys = [np.zeros(0, np.int64)]
    for m in np.unique(size[(size > 1) & (size <= 48)]).tolist():
        i, j = np.triu_indices(m, 1)
        rows = at[start[size == m][:, None] + np.arange(m)]
        keys.append(np.unique(rows[:, i] * len(own) + rows[:, j]))
    key = np.unique(np.concatenate(keys))
    return own, region, sorted(large, key=len, reverse=True), (key // max(1, len(own)), key % max(1, len(own)))


def _searched(region: _Region, large: list[np.ndarray], small: tuple[np.ndarray, np.ndarray], root: np.ndarray, hubs: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of different roots that share a region and may link; ``root`` may be joined further between two of them."""
    before = np.zeros((len(large), -(-len(root) // 8)), np.uint8)  # members of the regions searched before, in bits
    for i, members in enumerate(large):
        own = np.zeros(len(root), bool)
        own[members] = True
        before[i] = np.packbits(own)
        common = np.bitwise_count(before[:i] & before[i]).sum(1, dtype=np.int64)
        done = np.unpackbits(before[common.argmax()], count=len(root))[members] > 0 if i else None
        if hubs and (done is None or (~done).sum() > SMALL // 4):
            yield from region.hubs(members, root)
        yield from region.pairs(members, root, done)
    k = root[small[0]] != root[small[1]]
    yield region.may_link(small[0][k], small[1][k])


def _forest(percent: int):
    """a, b: of the pairs of a bucket that may link, enough to connect all that they connect, likely ones first."""

    def one(members, sketches):
        own, region, large, small = _regions(members, sketches, percent)
        root, out = np.arange(len(own)), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def join(a: np.ndarray, b: np.ndarray) -> None:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((x, y))
            while not np.array_equal(up := root[root], root):
                root[:] = up

        def open_(held):
            """The most likely pair of each two roots that are still apart."""
            a, b, d = (np.concatenate(v) for v in zip(*held, strict=True))
            p, q = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            o = np.lexsort((d, q, p))
            new = np.append(True, (p[o][1:] != p[o][:-1]) | (q[o][1:] != q[o][:-1]))[: len(o)]
            o = o[new & (p[o] != q[o])]
            return a[o], b[o], d[o]

        held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for a, b, d in _searched(region, large, small, root, True):
            k = np.flatnonzero(d <= 1)
            k = k[np.argsort(d[k], kind="stable")]
            join(a[k], b[k])
            k = np.flatnonzero((d > 1) & (root[a] != root[b]))
            held.append((a[k], b[k], d[k]))
            n += len(k)
            if n > 500_000:
                held = [open_(held)]
                n = len(held[0][0]) // 2
        a, b, d = open_(held)
        o = np.argsort(d, kind="stable")
        join(a[o], b[o])
        x, y = (own[np.array(v, np.int64)] for v in (zip(*out, strict=True) if out else ([], [])))
        del region, held, a, b, d
        T.released()
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return one


def _across(percent: int):
    """a, b: the pairs of a bucket that may link and lie in different components."""

    def one(members, sketches):
        own, region, large, small = _regions(members, sketches, percent)
        label = sketches.column("label").to_numpy()[np.argsort(sketches.column("own").to_numpy())]
        found = [np.zeros(0, np.int64)]
        for a, b, _ in _searched(region, large, small, label, False):
            found.append(np.minimum(a, b) * len(own) + np.maximum(a, b))
        key = np.unique(np.concatenate(found))
        del region, found
        T.released()
        return pa.table({"a": own[key // max(1, len(own))], "b": own[key % max(1, len(own))]})

    return one


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    x, y = whole.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), whole.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("t"))
    return both.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def _whole(docs: DataFrame, k: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(1)):
                x = sets(s, k)
                ends = np.concatenate([[0], np.cumsum([len(v) for v in x])])
                yield pa.RecordBatch.from_arrays([pa.array([_sid(v) for v in x], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).view(np.int64)))], ["sid", "shingles"])

    return docs.mapInArrow(rows, "sid long, shingles array<long>")


def _placed(shared: DataFrame, sets_: DataFrame) -> DataFrame:
    """part and the columns of sets_ (own, ...): a set once for each bucket that has regions of it."""
    return shared.select(F.col("bucket").alias("part"), F.col("sid").alias("own")).distinct().join(sets_, "own")


def clustered(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    nodes = written(_nodes(docs, k))
    buckets = max(1, nodes.count() // 2048)
    kinds = nodes.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    bucket = F.pmod(F.col("h"), F.lit(buckets)).alias("bucket")
    shared = written(_first_regions(docs, k, percent, _frequent(docs, k)).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_shared_regions(percent), "h long, sid long"))
    sketches = nodes.where("n > 0").select(F.col("sid").alias("own"), "n", "sketch").join(shared.select(F.col("sid").alias("own")).distinct(), "own", "left_semi").dropDuplicates(["own"])
    shared_in = shared.withColumn("bucket", bucket)
    first = written(shared_in.groupBy("bucket").cogroup(_placed(shared_in, sketches).groupBy("part")).applyInArrow(_forest(percent), "a long, b long").distinct())
    near = written(first.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    members = nodes.join(near, "sid", "left_semi").select(F.when(F.col("doc_id") != T.NO_ID, F.col("doc_id")).alias("doc_id")).distinct()
    whole = written(_whole(docs.join(members, docs["doc_id"].eqNullSafe(members["doc_id"]), "left_semi"), k).join(near, "sid", "left_semi").dropDuplicates(["sid"]))
    links = written(_verified(first, whole, percent))
    labels = components(links)
    # A component of candidates that the verified links don't hold together: its parts are searched for other links.
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("l" + c))
    torn = first.join(links, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")).where("x <> y")
    torn = torn.select(F.explode(F.array("x", "y")).alias("label")).distinct()
    parts = near.withColumnRenamed("sid", "node").join(labels, "node", "left").select(F.col("node").alias("own"), F.coalesce("label", "node").alias("label")).join(torn, "label", "left_semi")
    parts = written(parts.select("own", "label"))
    if not parts.isEmpty():
        open_ = shared_in.join(parts.select(F.col("own").alias("sid")), "sid", "left_semi")
        rest = open_.groupBy("bucket").cogroup(_placed(open_, sketches.join(parts, "own")).groupBy("part")).applyInArrow(_across(percent), "a long, b long").distinct()
        more = written(_verified(rest.join(first, ["a", "b"], "left_anti"), whole, percent))
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    named = kinds.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc_id", F.coalesce("label", "sid").alias("label"))
    groups = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = written(named.join(groups, "label").select("sid", "component_id"))
    discarded(shared, first, near, whole, links, parts)
    out = nodes.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(named, "sid", "left")
    null = lambda c: F.when(c != T.NO_ID, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null(F.coalesce("component_id", "doc_id")).alias("component_id"))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that are not the first of their component, by doc_id and then by row.

    Rows are numbered, so that of repeated rows one stays, and of rows that share a doc_id only those
    go whose own text is in the component. Rows without an id stay and are never a component's first.
    """
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    docs_ = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = clustered(docs_.select(F.col(row).alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("row"), "component_id")
    many = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("component_id")
    held = groups.join(many, "component_id").join(docs_.select(F.col(row).alias("row"), "doc_id").where("doc_id is not null"), "row")
    held = written(held.select("component_id", "doc_id", "row"))
    first = held.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("component_id", F.col("first.row").alias("first"))
    gone = held.join(first, "component_id").where("row <> first").select(F.col("row").alias(row))
    return docs_.join(gone, row, "left_anti").select(*docs.columns)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
both_ AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (SELECT x, y FROM both_ JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT rid AS x, rid AS y FROM t UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT x AS rid, min(doc_id) AS component_id FROM reach JOIN t ON t.rid = y GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM t JOIN comp USING (rid) LEFT JOIN n USING (rid)
"""
QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
ORACLES = {"op7_ngram_jaccard_join": ORACLE_SQL}
