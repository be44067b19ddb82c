"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores, per document, the measurements and one failure bit
per rule. Policies are versioned sets of rules: applying one is a bitwise AND with its mask, and
``ablations`` counts by bitwise aggregation what each rule rejects alone, so that neither reads the
texts again.

Defined cases: a null or blank text has no words and fails ``too_few_words``; a null doc_id stays
null; repeated rows are each measured; an empty table gives an empty ledger; other columns of the
input are ignored by ``ledger`` and carried unchanged by ``filtered``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .shared import table, written

#: Rule -> bit. Bits are never reused, so that stored ledgers stay readable.
RULES = {"too_few_words": 0, "repeated_windows": 1, "symbols": 2, "duplicate_lines": 3, "word_length": 4, "upper_case": 5, "few_letters": 6}
#: Policy version -> the rules it enforces.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "upper_case", "few_letters"),
}
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_wide")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", fail_mask long"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOW = np.zeros(256, bool)
_LOW[97:123] = True


def mask_of(policy: str) -> int:
    return sum(1 << RULES[r] for r in POLICIES[policy])


def _per_row(s: T.Slice, marks: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return np.diff(total[s.offsets])


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether an equal one is in the same row, and whether that is an earlier one."""
    key = T.mix(h + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, later = np.empty(len(k), bool), np.empty(len(k), bool)
    later[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, later


def measure(s: T.Slice) -> dict[str, np.ndarray]:
    """The measurements of each row of a slice."""
    n, w = s.hi - s.lo, T.words(s)
    h = T.word_hashes(s, w)
    lead = (s.buf & 0xC0) != 0x80
    out = {
        "n_words": np.diff(w.first),
        "word_chars": _per_row(s, lead & ~T._SPACE[s.buf]),
        "n_symbols": _per_row(s, _IS_SYMBOL[s.buf]),
        "n_upper": _per_row(s, _UPPER[s.buf]),
        "n_lower": _per_row(s, _LOW[s.buf]),
        "n_wide": _per_row(s, s.buf >= 0xC0),
    }
    cut = np.zeros(len(s.buf) + 1, bool)
    cut[s.offsets[:-1][np.diff(s.offsets) > 0]] = True
    begins = cut[:-1].copy()
    begins[1:] |= s.buf[:-1] == 10
    a = np.flatnonzero(begins)
    b = np.append(a[1:], len(s.buf))[: len(a)]
    doc = np.searchsorted(s.offsets, a, "right") - 1
    b -= (b > a) & (s.buf[np.maximum(b - 1, 0)] == 10) if len(b) else False
    solid = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(~T._SPACE[s.buf], out=solid[1:])
    has = solid[b] > solid[a]
    a, b, doc = a[has], b[has], doc[has]
    _, later = _repeats(doc, T.spans_hash(s.buf, a, b))
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[later], minlength=n)
    covered = np.zeros(len(h), bool)
    win = T.window_hashes(h, 3)
    at = np.flatnonzero(w.doc[: len(win)] == w.doc[2:]) if len(win) else np.zeros(0, np.int64)
    twice, _ = _repeats(w.doc[at], win[at])
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    return out


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """The failure bits. The limits are stated here and in ORACLE_SQL, in whole numbers."""
    n = m["n_words"]
    letters = m["n_upper"] + m["n_lower"]
    fails = {
        "too_few_words": n < 50,
        "repeated_windows": 100 * m["n_repeat_words"] > 50 * n,
        "symbols": 4 * m["n_symbols"] > n,
        "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "word_length": (m["word_chars"] < 2 * n) | (m["word_chars"] > 25 * n),
        "upper_case": 2 * m["n_upper"] > letters + m["n_wide"],
        "few_letters": 2 * (letters + m["n_wide"]) < m["word_chars"],
    }
    mask = np.zeros(len(n), np.int64)
    for rule, bit in RULES.items():
        mask |= fails[rule].astype(np.int64) << bit
    return mask


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in T.slices(batch.column(1)):
            m = measure(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(failures(m), pa.int64())], ["doc_id", *MEASURES, "fail_mask"])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): measurements and failure bits."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_rows, SCHEMA)


def failed(policy: str):
    return F.col("fail_mask").bitwiseAND(F.lit(mask_of(policy))) != 0


def verdicts(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Applies a policy to a ledger."""
    return book.withColumns({"base_failed": failed("base"), "kept": ~failed(policy), "policy": F.lit(policy)})


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, those that fail nothing else of the policy, and so how many the policy would keep without it."""
    m = mask_of(policy)
    inside = F.col("fail_mask").bitwiseAND(F.lit(m))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(inside == 0).alias("kept")]
    for r in POLICIES[policy]:
        sums += [F.count_if(inside.bitwiseAND(F.lit(1 << RULES[r])) != 0).alias(f"fails_{r}"), F.count_if(inside == (1 << RULES[r])).alias(f"only_{r}")]
    one = book.agg(*sums)
    rows = ", ".join(f"'{r}', fails_{r}, only_{r}, kept + only_{r}" for r in POLICIES[policy])
    return one.selectExpr("n", "kept", f"stack({len(POLICIES[policy])}, {rows}) AS (rule, n_fail, n_only, kept_without)").withColumn("policy", F.lit(policy))


def filtered(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns; no shuffle."""
    at, mask = docs.columns.index(text), mask_of(policy)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [failures(measure(s)) & mask == 0 for s in T.slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(ok) if ok else np.zeros(0, bool)))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(written(ledger(table(spark, sf_dir, "documents"))))  # the stored ledger serves any policy


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS tx FROM documents),
w AS (SELECT *, regexp_extract_all(tx, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
ln AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(tx, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(tx, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n_lines, 0)::BIGINT AS n_lines, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(tx, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(tx, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
    length(regexp_replace(tx, '[\x00-\x7F]', '', 'g'))::BIGINT AS n_wide
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (4 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT + 32 * (2 * n_upper > n_upper + n_lower + n_wide)::BIGINT
    + 64 * (2 * (n_upper + n_lower + n_wide) < word_chars)::BIGINT)::BIGINT AS fail_mask FROM m)
SELECT *, (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept, 'v1' AS policy FROM f
"""
QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": ORACLE_SQL}
