"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores by context.

The lexicon is a short fixed list plus the words that the labelled documents show to be toxic. A
word is looked up by walking the automaton "at most one edit (or swap of neighbours) from a term"
over the trie: the pairs of trie node and edits so far are the states, made into a deterministic
table as words need them, so that a whole slice of words takes one step together. Terms under five
bytes must match exactly.

A hit counts as quoted if a quotation mark is open within the words before it or a reporting word
stands there, and as directed if a second-person word is near. A logistic layer weighs exact,
misspelled, quoted and directed hits; its weights are drawn to fixed ones where labels say nothing.

Defined cases: a null or empty text has no hit and gets the score of the bias; a null doc_id is in no
fold (held_out null) and is scored; repeated rows are scored each; without labels the fixed list and
weights are used; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from . import tokens as T
from .shared import table

SAMPLE = 20_000  # labelled documents at most
MIN_TOXIC, MIN_ODDS = 3, 2.0  # toxic documents with the word; natural logarithm of its odds
FOLDS, HELD_OUT = 5, 0
BEFORE, NEAR = 12, 4  # words of the context windows
FIXED_WEIGHT = 3.0
# Common insults, reporting words and second-person words.
TERMS = "idiot moron scum trash clown loser pathetic worthless stupid disgusting imbecile bastard dumbass scumbag idiote imbécile connard ordure crétin débile trottel arschloch dummkopf abschaum vollidiot idiota imbécil estúpido basura payaso".split()
REPORTING = {x.encode() for x in "said says wrote called calls quote quoted quotes word term phrase insult slur dit écrit appelé mot sagte schrieb nannte wort dijo escribió llamó palabra".split()}
SECOND = {x.encode() for x in "you your you're youre u ur yourself du dich dir dein deine ihr euch tu toi te ton ta vous votre tú usted eres vos".split()}
PRIOR = np.array([-2.5, 2.0, 1.0, 0.2, 3.0, 0.3])  # bias, exact, misspelled, quoted, density, directed
STATES = 100_000  # the deterministic table is emptied beyond; it is then made again as needed

_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SCHEMA = "doc_id long, exact double, fuzzy double, quoted double, directed double, n_words long"


class Automaton:
    """terms: (lower-cased bytes, weight). State 0 is dead, 1 the start."""

    def __init__(self, terms: list[tuple[bytes, float]]) -> None:
        self.terms = terms
        self.child: list[dict[int, int]] = [{}]
        self.term = [-1]
        for k, (t, _) in enumerate(terms):
            node = 0
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                node = self.child[node][c]
            if self.term[node] < 0:
                self.term[node] = k
        used = sorted({c for t, _ in terms for c in t})
        self.cls = np.zeros(256, np.int64)  # class 0: bytes of no term
        self.cls[used] = np.arange(1, len(used) + 1)
        self.byte = [-1, *used]
        self._clear()

    def _clear(self) -> None:
        self.sets: list[frozenset] = [frozenset(), self._close({(0, 0, -1)})]
        self.number = {s: i for i, s in enumerate(self.sets)}
        self.table = np.full((64, len(self.byte)), -1, np.int32)
        self.table[0] = 0
        self.hit = [(-1, 0), self._accept(self.sets[1])]

    def _close(self, states: set) -> frozenset:
        """Adds what a missing letter leads to; drops what an equal node with fewer edits makes needless."""
        best = dict.fromkeys(((n, need) for n, _, need in states), 9)
        for n, e, need in states:
            best[n, need] = min(best[n, need], e)
        for (n, need), e in list(best.items()):
            if e == 0 and need < 0:
                for m in self.child[n].values():
                    best[m, -1] = min(best.get((m, -1), 9), 1)
        return frozenset((n, e, need) for (n, need), e in best.items())

    def _accept(self, states: frozenset) -> tuple[int, int]:
        found = [(e, -self.terms[k][1], k) for n, e, need in states if need < 0 and (k := self.term[n]) >= 0 and (e == 0 or len(self.terms[k][0]) >= 5)]
        return (min(found)[2], min(found)[0]) if found else (-1, 0)

    def _step(self, state: int, cls: int) -> int:
        c, out = self.byte[cls], set()
        for n, e, need in self.sets[state]:
            if need >= 0:
                if c == need:
                    out.add((n, e, -1))
                continue
            kids = self.child[n]
            if c in kids:
                out.add((kids[c], e, -1))
            if e == 0:
                out.add((n, 1, -1))
                for d, m in kids.items():
                    if d != c:
                        out.add((m, 1, -1))
                        if c in self.child[m]:
                            out.add((self.child[m][c], 1, d))
        new = self._close(out) if out else frozenset()
        if new not in self.number:
            self.number[new] = len(self.sets)
            self.sets.append(new)
            self.hit.append(self._accept(new))
            if len(self.sets) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.number[new]

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans that match: their index, the term, and the edits."""
        if len(self.sets) > STATES:
            self._clear()
        live, size, at = np.arange(len(start)), end - start, []
        state, j = np.ones(len(start), np.int64), 0
        while len(live):
            done = size[live] == j
            at.append((live[done], state[done]))
            live, state = live[~done], state[~done]
            if not len(live):
                break
            c = self.cls[buf[start[live] + j]]
            nxt = self.table[state, c]
            if (nxt < 0).any():
                todo = np.unique(state[nxt < 0] * len(self.byte) + c[nxt < 0])
                for x in todo.tolist():
                    s, k = divmod(x, len(self.byte))
                    to = self._step(s, k)
                    self.table[s, k] = to
                nxt = self.table[state, c]
            ok = nxt > 0
            live, state, j = live[ok], nxt[ok].astype(np.int64), j + 1
        idx, st = (np.concatenate(x) for x in zip(*at, strict=True)) if at else (np.zeros(0, np.int64),) * 2
        hit = np.array(self.hit, np.int64)
        good = hit[st, 0] >= 0
        return idx[good], hit[st[good], 0], hit[st[good], 1]


def trimmed(s: T.Slice) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """Words, and each one's span without the punctuation around it (empty if there is nothing else)."""
    w, buf, n = T.words(s), s.buf, len(s.buf)
    if not n:
        return w, w.start, w.end
    solid = _SOLID[buf]
    nxt = np.append(buf[1:], 0)
    wide = np.flatnonzero((buf == 0xE2) & ((nxt == 0x80) | (nxt == 0x81)))  # general punctuation
    pair = np.flatnonzero((buf == 0xC2) & np.isin(nxt, (0xA1, 0xAB, 0xBB, 0xBF)))
    for k in range(3):
        solid[np.minimum(wide + k, n - 1)] = False
    for k in range(2):
        solid[np.minimum(pair + k, n - 1)] = False
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, at, -1))
    a = np.minimum(after[w.start], w.end)
    return w, a, np.maximum(before[w.end - 1] + 1, a)


def _context(s: T.Slice, w: T.Words, i: int) -> tuple[bool, bool]:
    """Whether the word i is quoted, and whether it is aimed at somebody."""
    row = w.doc[i]
    first, last = w.first[row], w.first[row + 1]
    lo = max(first, i - BEFORE)
    text = s.buf[w.start[lo] : w.start[i]].tobytes()
    own = s.buf[w.start[i] : w.end[i]].tobytes()
    lead = own[: max(0, len(own) - len(own.lstrip(b"\"'([*_\xe2\x80\x9c\x9e\x98\xc2\xab")))]
    opened = (text + lead).count(b'"') % 2 == 1
    for a, b in ((b"\xe2\x80\x9c", b"\xe2\x80\x9d"), (b"\xe2\x80\x9e", b"\xe2\x80\x9c"), (b"\xc2\xab", b"\xc2\xbb")):
        opened |= (text + lead).rfind(a) > (text + lead).rfind(b)
    near = [x.strip(b".,:;!?\"'()") for x in text.lower().split()[-NEAR:]]
    tail = s.buf[w.start[i] : w.end[min(last - 1, i + NEAR)]].tobytes().lower().split()[1:]
    quoted = opened or any(x in REPORTING for x in near)
    return quoted, not quoted and any(x.strip(b".,:;!?\"'()") in SECOND for x in [*near, *tail])


def measure(s: T.Slice, auto: Automaton) -> np.ndarray:
    """Per row of a slice of lower-cased texts: sums of weights of exact, misspelled, quoted, directed hits, and the number of words."""
    w, a, b = trimmed(s)
    out = np.zeros((s.hi - s.lo, 5))
    out[:, 4] = np.diff(w.first)
    if len(a):
        idx, term, edits = auto.find(s.buf, a, b)
        for i, k, e in zip(idx.tolist(), term.tolist(), edits.tolist(), strict=True):
            quoted, aimed = _context(s, w, i)
            row, weight = w.doc[i], auto.terms[k][1]
            out[row, 2 if quoted else int(e > 0)] += weight
            if aimed:
                out[row, 3] += weight
    return out


_KEPT: dict[object, Automaton] = {}


def _automaton(terms: tuple) -> Automaton:
    """One automaton a Python worker, so that its table serves all tasks."""
    if terms not in _KEPT:
        _KEPT.clear()
        _KEPT[terms] = Automaton(list(terms))
    return _KEPT[terms]


def measured(docs: DataFrame, terms: tuple) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(known.value)
        for b in batches:
            for s in T.slices(pc.utf8_lower(b.column(1))):
                x = measure(s, auto)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.hi - s.lo), *(pa.array(x[:, k]) for k in range(4)), pa.array(x[:, 4].astype(np.int64))], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, SCHEMA)


def _inputs(exact, fuzzy, quoted, directed, n_words) -> np.ndarray:
    exact, fuzzy, quoted, directed = (np.asarray(x, float) for x in (exact, fuzzy, quoted, directed))
    plain = exact + 0.5 * fuzzy
    return np.stack([np.ones(len(exact)), np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), plain / (plain + np.asarray(n_words, float) / 20 + 1), np.log1p(directed)], axis=1)


def fit_layer(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 0.5) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to the prior."""
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step / max(1, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def word_counts(sample: DataFrame) -> DataFrame:
    """word, half, toxic, clean: documents of each half of a sample (doc_id, text, label) that have the word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, half = b.column(1).to_pylist(), b.column(2).to_pylist()
            count: Counter = Counter()
            for s in T.slices(pc.utf8_lower(b.column(0))):
                w, a, e = trimmed(s)
                low = s.buf.tobytes()
                for i in range(s.hi - s.lo):
                    own = slice(w.first[i], w.first[i + 1])
                    count.update((x, half[s.lo + i], label[s.lo + i] > 0) for x in {low[p:q] for p, q in zip(a[own].tolist(), e[own].tolist(), strict=True)} if x)
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([count[k] * k[2] for k in keys], pa.int64()), pa.array([count[k] * (not k[2]) for k in keys], pa.int64())], ["word", "half", "toxic", "clean"])

    return sample.select("text", "label", "half").mapInArrow(rows, "word binary, half int, toxic long, clean long").groupBy("word", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _terms(counts: DataFrame, sizes: dict[tuple[int, int], int], halves: tuple[int, ...]) -> tuple:
    """Terms and weights from the documents of some halves, with the fixed list."""
    toxic, clean = (sum(sizes.get((h, c), 0) for h in halves) for c in (1, 0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1) * (clean + 1) / (F.col("clean") + 0.5))
    rows = (
        counts.where(F.col("half").isin(*halves)).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= MIN_TOXIC).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
        .collect()  # words of the bounded sample
    )
    return tuple(sorted(({t.encode(): FIXED_WEIGHT for t in TERMS} | {bytes(r["word"]): min(float(r["odds"]), 8.0) for r in rows}).items()))


def scored(docs: DataFrame, sample: DataFrame, parts: int = FOLDS, out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. ``sample`` (doc_id, text, label) is bounded by its maker.

    Terms learned on one half of the sample give the inputs on which the layer is fitted on the other
    half; the terms used for scoring are then learned on both.
    """
    sample = sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")).persist()
    sizes = {(r["half"], r["c"]): r["count"] for r in sample.groupBy("half", (F.col("label") > 0).cast("int").alias("c")).count().collect()}
    counts = word_counts(sample).persist()
    terms, layer = _terms(counts, sizes, (0, 1)), PRIOR
    if sizes.get((1, 1)) and sizes.get((1, 0)):
        part = sample.where("half = 1")
        got = measured(part, _terms(counts, sizes, (0,))).join(part.select("doc_id", "label"), "doc_id").collect()
        if got:
            cols = list(zip(*((r["exact"], r["fuzzy"], r["quoted"], r["directed"], r["n_words"], r["label"] > 0) for r in got), strict=True))
            layer = fit_layer(_inputs(*cols[:5]), np.array(cols[5], float))
    counts.unpersist()
    sample.unpersist()
    score = F.lit(float(layer[0]))
    plain = F.col("exact") + 0.5 * F.col("fuzzy")
    for k, x in enumerate((F.log1p("exact"), F.log1p("fuzzy"), F.log1p("quoted"), plain / (plain + F.col("n_words") / 20 + 1), F.log1p("directed"))):
        score = score + float(layer[k + 1]) * x
    got = measured(docs, terms).withColumn("score", 1 / (1 + F.exp(-score)))
    return got.select("doc_id", (labelled.fold(F.col("doc_id"), parts) == out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "exact", "fuzzy", "quoted", "directed")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, labelled.sample(docs, table(spark, sf_dir, "labels"), "toxic", FOLDS, HELD_OUT, SAMPLE))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
