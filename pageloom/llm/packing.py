"""Packing by concatenate and cut.

Pass one tokenises every document once and stores, per task, the ids and their place in the task's
run. The tasks' token totals (one row a task) give each task its global offset by a prefix sum, and
pass two cuts the one long run into windows of ``length`` ids with a record for each piece. Only the
last window can be shorter.

Ids come from the ``tokenizers`` file. Its pre-tokeniser never joins a visible character to a
following white space, nor a letter, an ASCII digit and another visible ASCII character to each other
(but for an apostrophe before letters), nor the last of some white space to that before it, nor
white space other than a blank to what follows. Texts are cut at such places, a whole slice at once,
and a bounded table remembers the ids of short parts met before; a part is looked up by all its
bytes. A text with white space outside ASCII or with an added token is encoded whole, as the argument
does not hold there.

Defined cases: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are
packed each; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .shared import table, written

LENGTH = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"  # of public_tokenizers
CACHE_PARTS, SHORT = 1 << 20, 15  # short parts (in bytes) remembered by a Python worker; the table is emptied when full
RUN = 200  # parts encoded as one text
SLICE_BYTES = 1 << 20

_ODD_SPACE = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")
_MAYBE_ODD = np.zeros(256, bool)  # bytes that such white space begins with
_MAYBE_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_OTHER, _APOSTROPHE, _LETTER, _DIGIT, _BLANK, _GAP, _UNKNOWN = range(7)
_KIND = np.repeat(np.array([_OTHER, _UNKNOWN], np.uint8), 128)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58], _KIND[9:14], _KIND[32], _KIND[39] = _DIGIT, _GAP, _BLANK, _APOSTROPHE
_SPACE = (_KIND == _BLANK) | (_KIND == _GAP)
_CUTS = np.zeros((7, 8), bool)  # whether a text can be cut between two kinds; white space after white space is not decided here
for _a in (_OTHER, _APOSTROPHE, _LETTER, _DIGIT, _UNKNOWN):
    _CUTS[_a, [_BLANK, _GAP]] = _CUTS[_GAP, _a] = True
_CUTS[_OTHER, [_LETTER, _DIGIT]] = _CUTS[_LETTER, [_OTHER, _APOSTROPHE, _DIGIT]] = _CUTS[_DIGIT, [_OTHER, _APOSTROPHE, _LETTER]] = True
_CUTS = _CUTS.ravel()
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # masks of the first bytes of eight
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (n[0] numbers), then those from at[1] on, and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(at - (ends - n), n)


class Encoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, cache: int = CACHE_PARTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.leads = np.zeros(size, bool)  # ids whose bytes begin with a space
        self.leads[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True
        self.line_end = vocab.get("\u010a", -1)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the table: slots of open addressing (0: free), and for each part its bytes and length as two numbers, and its ids
        self.bits = max(4, (2 * cache).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.low, self.high, self.at = np.zeros(cache + 1, np.uint64), np.zeros(cache + 1, np.uint64), np.zeros(cache + 1, np.int32)
        self.n = np.zeros(cache + 1, np.int32)
        self.ids = np.zeros(SHORT * cache + 1, np.uint16 if size <= 1 << 16 else np.uint32)  # a part has at most as many ids as bytes
        self.used, self.used_ids, self.full = 1, 0, False

    def _parts(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of a slice that holds bytes begin, and which rows are one part each, however long."""
        buf, offsets, n = s.buf, s.offsets, len(s.buf)
        kind = _KIND[buf]
        lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC8))  # U+00C0 to U+023F are letters but for two
        if len(lead):
            lead = lead[(buf[lead] > 0xC3) | ((buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7))]
            kind[lead] = kind[lead + 1] = _LETTER
        cut = np.ones(n + 1, bool)
        cut[1:n] = _CUTS[kind[:-1] * 8 + kind[1:]]
        row_ends = np.zeros(n + 1, bool)
        row_ends[offsets] = True
        gap = _SPACE[buf]
        last = np.flatnonzero(gap[:-2] & gap[1:-1] & ~gap[2:]) + 1
        cut[last[~row_ends[last + 1]]] = True
        cut[row_ends] = True
        whole = [i for i in np.unique(np.searchsorted(offsets, np.flatnonzero(_MAYBE_ODD[buf]), "right") - 1).tolist() if _ODD_SPACE.search(s.text(i).decode())]
        raw = buf.tobytes() if self.added else b""
        for token in self.added:
            whole += [int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in re.finditer(re.escape(token), raw)]
        for i in whole:
            cut[offsets[i] + 1 : offsets[i + 1]] = False
        return np.flatnonzero(cut[:n]), np.array(sorted(set(whole)), np.int64)

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.ids.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, buf: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ids of different parts, as (which, all their ids, how many each). Many are encoded as one text: words after a blank as they are, as
        only the first id of each begins with a blank, and what holds no white space with a line end after each, which is an id of its own."""
        out, rest = [], np.ones(len(at), bool)
        blank = (buf[at] == 32) & (n > 1) & ~_SPACE[buf[at + 1]]
        for which, ended in ((np.flatnonzero(blank), 0), (np.flatnonzero(~_SPACE[buf[at]]), 1)):
            if not len(which):
                continue
            size = n[which] + ended
            ends = np.cumsum(size)
            text = buf[_spread(at[which], size)]
            if ended:
                text[ends - 1] = 10
            raw, cuts = text.tobytes(), [0, *ends[RUN - 1 : -1 : RUN].tolist(), int(ends[-1])]
            ids = np.concatenate(self._texts([raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]))
            mark = np.flatnonzero(ids == self.line_end if ended else self.leads[ids])
            if len(mark) == len(which):
                first = np.concatenate([[0], mark[:-1] + 1]) if ended else mark
                count = (mark if ended else np.append(mark[1:], len(ids))) - first
                out.append((which, ids[_spread(first, count)], count))
                rest[which] = False
        which = np.flatnonzero(rest)
        if len(which):
            ids = self._texts([buf[a : a + k].tobytes().decode() for a, k in zip(at[which].tolist(), n[which].tolist(), strict=True)])
            out.append((which, np.concatenate(ids), np.array([len(x) for x in ids])))
        return out

    def _find(self, low: np.ndarray, high: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The place of each part in the table, 0 if it isn't there."""
        place = self.slots[slot]
        open_ = np.flatnonzero((self.low[place] != low) | (self.high[place] != high))
        slot = slot[open_]
        while len(open_):
            more = place[open_] != 0
            open_, slot = open_[more], (slot[more] + 1) & (len(self.slots) - 1)
            here = place[open_] = self.slots[slot]
            differ = (self.low[here] != low[open_]) | (self.high[here] != high[open_])
            open_, slot = open_[differ], slot[differ]
        return place

    def _keep(self, low: np.ndarray, high: np.ndarray, slot: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Adds different parts that aren't in the table, and returns their places; 0 for those that find no room."""
        k = min(len(low), self.cache + 1 - self.used)
        self.full |= k < len(low)
        place, slot, size = np.arange(self.used, self.used + k, dtype=np.int32), slot[:k].copy(), int(n[:k].sum())
        self.low[place], self.high[place], self.n[place] = low[:k], high[:k], n[:k]
        self.at[place] = self.used_ids + np.cumsum(n[:k]) - n[:k]
        self.ids[self.used_ids : self.used_ids + size] = ids[:size]
        self.used, self.used_ids, todo = self.used + k, self.used_ids + size, np.arange(k)
        while len(todo):
            free = todo[self.slots[slot[todo]] == 0]
            self.slots[slot[free]] = place[free]
            todo = todo[self.slots[slot[todo]] != place[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        return np.append(place, np.zeros(len(low) - k, np.int32))

    def slice(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, and where each row's begin (one entry more than rows)."""
        if not len(s.buf):
            return np.zeros(0, self.ids.dtype), np.zeros(s.hi - s.lo + 1, np.int64)
        if self.full:
            self.slots[:] = 0
            self.used, self.used_ids, self.full = 1, 0, False
        start, whole = self._parts(s)
        if len(s.buf) > 2 * SLICE_BYTES and not len(whole):  # one long row; before white space after something visible it can be cut whatever follows
            safe = start[1:][_SPACE[s.buf[start[1:]]] & ~_SPACE[s.buf[start[1:] - 1]]]
            cuts = np.unique([0, *safe[np.unique(safe // SLICE_BYTES, return_index=True)[1]].tolist(), len(s.buf)]).tolist()
            if len(cuts) > 2:
                ids = np.concatenate([self.slice(T.Slice(0, 1, s.buf[a:b], np.array([0, b - a])))[0] for a, b in zip(cuts, cuts[1:], strict=False)])
                return ids, np.where(s.offsets > 0, len(ids), 0)
        size = np.diff(start, append=len(s.buf))
        of_row = np.searchsorted(start, s.offsets)
        known = np.minimum(size, SHORT + 1)
        known[of_row[whole]] = SHORT + 1  # no key in the table has that length
        buf = np.zeros(len(s.buf) + 16, np.uint8)
        buf[: len(s.buf)] = s.buf
        eight = np.ndarray(len(s.buf) + 9, "V8", buf, strides=(1,))  # the eight bytes from each place on
        low = eight[start].view("<u8") & _FIRST[np.minimum(size, 8)]
        high = (eight[start + 8].view("<u8") & _FIRST[np.clip(size - 8, 0, SHORT - 8)]) | known.astype(np.uint64) << np.uint64(56)
        hashed = T.mix(low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F))
        slot = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        place = self._find(low, high, slot)

        own: dict[int, np.ndarray] = {}  # ids of parts that aren't in the table
        missing = np.flatnonzero(place == 0)
        short = missing[known[missing] <= SHORT]
        _, one, which = np.unique(hashed[short], return_index=True, return_inverse=True)
        one = short[one]
        same = (low[short] == low[one[which]]) & (high[short] == high[one[which]])
        places = np.zeros(len(one), np.int32)
        for w, ids, n in self._fresh(buf, start[one], size[one]):
            places[w] = self._keep(low[one[w]], high[one[w]], slot[one[w]], ids, n)
            left = places[w] == 0
            if left.any():
                ends = np.cumsum(n)
                late = {int(i): ids[b - k : b] for i, b, k in zip(w[left], ends[left], n[left], strict=True)}
                own.update((int(p), late[int(i)]) for p, i in zip(short, which, strict=True) if int(i) in late)
        place[short] = places[which]
        alone: dict[bytes, list[int]] = {}
        for p in [*missing[known[missing] > SHORT].tolist(), *short[~same].tolist()]:
            alone.setdefault(buf[start[p] : start[p] + size[p]].tobytes(), []).append(p)
        for at, ids in zip(alone.values(), self._texts([x.decode() for x in alone]), strict=True):
            own.update((p, ids) for p in at)

        n, at = self.n[place].astype(np.int64), self.at[place].astype(np.int64)
        for p, ids in own.items():
            n[p] = len(ids)
        ends = np.concatenate([[0], np.cumsum(n)])
        out = self.ids.take(_spread(at, n), mode="clip")
        for p, ids in own.items():
            out[ends[p] : ends[p + 1]] = ids
        return out, ends[of_row]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for s in T.slices(pa.array(texts, pa.large_string()), SLICE_BYTES):
            ids, first = self.slice(s)
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(first, first[1:], strict=False)]
        return out


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One encoder a Python worker, so that its table serves all tasks."""
    return Encoder(path)


def _binary(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """A row's ids in 16 bits where all fit, else in 32."""
    if len(ids) and ids.max() >= 1 << 16:
        rows = [ids[a:b] for a, b in zip(first, first[1:], strict=False)]
        return pa.array([x.astype(np.uint32 if len(x) and x.max() >= 1 << 16 else np.uint16).tobytes() for x in rows], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, np.uint16))])


def tokenized(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, part (the task), before (ids of that task before this document), n_tokens, ids (binary, unsigned 32-bit; 16-bit where all fit)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(path), TaskContext.get().partitionId(), 0
        names = ["doc_id", "part", "before", "n_tokens", "ids"]
        for b in batches:
            for s in T.slices(b.column(1), SLICE_BYTES):
                ids, first = encoder.slice(s)
                rows = s.hi - s.lo
                if end_id is not None:
                    ids = np.insert(ids if end_id <= np.iinfo(ids.dtype).max else ids.astype(np.uint32), first[1:], end_id)
                    first = first + np.arange(rows + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, rows), pa.array(np.full(rows, part), pa.int32()), pa.array(before + first[:-1]), pa.array(np.diff(first)), _binary(ids, first)], names)
                before += len(ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encoded, "doc_id long, part int, before long, n_tokens long, ids binary")


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces of a stored ``tokenized`` table. What the driver sees is one total a task of pass one."""
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    sums = np.concatenate([[0], np.cumsum([n for _, n in totals])]).astype(np.int64)
    base = {p: int(x) for (p, _), x in zip(totals, sums, strict=False)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, part, before, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                wide = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4")
                at, start = base[part] + before, 0
                while start < n:
                    offset = (at + start) % length
                    k = min(n - start, length - offset)
                    out.append((doc, start, k, zlib.crc32(wide[start : start + k].tobytes()), n, (at + start) // length, offset))
                    start += k
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.select("doc_id", "part", "before", "n_tokens", "ids").mapInArrow(rows, PIECES)


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int | None = END_ID) -> DataFrame:
    """Packs docs (doc_id, text); the tokenised documents are stored in the shared folder between the passes."""
    return cut(written(tokenized(docs, path or tokenizer_path(), end_id)), length)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
