"""DuckDB SQL of the adapters and of common expressions, for the queries' SQL."""

from __future__ import annotations

from ..functions.quality import HANGUL, MOJIBAKE
from ..functions.text import CID, PAGE_NUMBER, STATUS, WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def match(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in patterns) + ")"


def count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {q(p)}))"


def normalized(x: str) -> str:
    one = strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")
    bare = strip(rf"regexp_replace(regexp_replace({one}, '\s+\d{{1,4}}\s*$', ''), '^\s*\d{{1,4}}\s+', '')")
    return rf"CASE WHEN regexp_matches({one}, '^\d+$') THEN '' ELSE {bare} END"


def page_number(x: str) -> str:
    return match(strip(x), *PAGE_NUMBER, STATUS)


def area(p: str = "") -> str:
    return f"(greatest(0.0, {p}x1 - {p}x0) * greatest(0.0, {p}y1 - {p}y0))"


def cross(p: str, r: str) -> str:
    return f"(greatest(0.0, least({p}x1, {r}x1) - greatest({p}x0, {r}x0)) * greatest(0.0, least({p}y1, {r}y1) - greatest({p}y0, {r}y0)))"


def iou(p: str, r: str) -> str:
    union = f"({area(p)} + {area(r)} - {cross(p, r)})"
    return f"(CASE WHEN {union} > 0 THEN {cross(p, r)} / {union} ELSE 0.0 END)"


def clean_cell(x: str) -> str:
    t = strip(f"regexp_replace({x}, {q(CID)}, '', 'g')")
    two = f"regexp_replace(regexp_replace({t}, '[{WS}]*\\n[{WS}]*', ' ', 'g'), '[{WS}]{{2,}}', ' ', 'g')"
    last = strip(f"regexp_replace({two}, '·{{3,}}', '', 'g')")
    return f"CASE WHEN regexp_matches({t}, {q(STATUS)}) THEN '' ELSE {last} END"


def health(x: str) -> str:
    n = " + ".join([count(x, r"\x{fffd}"), count(x, r"\p{Co}"), *(count(x, p) for p in MOJIBAKE)])
    return f"CASE WHEN length({x}) = 0 THEN 1.0::DOUBLE ELSE greatest(0.0, 1.0 - ({n}) / length({x})::DOUBLE * 3.0) END"


def cid_ratio(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 1.0::DOUBLE ELSE greatest(0.0, 1.0 - (length({x}) - length(regexp_replace({x}, {q(CID)}, '', 'g'))) / length({x})::DOUBLE * 2.0) END"


def printable(x: str) -> str:
    hidden = count(f"regexp_replace({x}, '[\\t\\n\\x0b\\f\\r\\x1c-\\x1f\\x{{85}}]', '', 'g')", r"\p{C}")
    return f"CASE WHEN length({x}) = 0 THEN 1.0::DOUBLE ELSE 1.0 - {hidden} / length({x})::DOUBLE END"


def consistency(x: str) -> str:
    total, h, a, w = count(x, f"[^{WS}]"), count(x, HANGUL), count(x, r"[\x{21}-\x{7e}]"), count(x, r"[\x{c0}-\x{24f}]")
    share = f"({w} / nullif({total}, 0)::DOUBLE)"
    return f"CASE WHEN length({strip(x)}) < 5 OR {total} = 0 THEN 1.0::DOUBLE WHEN {h} > 0 AND {share} < 0.1 THEN 1.0 WHEN {h} > 0 THEN greatest(0.3, 1.0 - {share} * 3.0) WHEN {w} > 0 THEN greatest(0.2, 0.6 - {share} * 2.0) WHEN {a} > 0 THEN 0.6 ELSE 0.5 END"


def readable(x: str) -> str:
    total = count(x, f"[^{WS}]")
    return f"CASE WHEN {total} = 0 THEN 1.0::DOUBLE ELSE {count(x, '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 'p{P}' + chr(92) + 'p{S}]')} / {total}::DOUBLE END"


CTES = rf"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
b AS (
  SELECT doc_id, (n // 10 + 1)::INTEGER AS page_num, n::INTEGER AS seq, text,
    CASE WHEN doc_id % 5 = 0 AND n % 2 = 1 THEN 320.0 ELSE 50.0 END::DOUBLE AS x0, (20 + 85 * (n % 10))::DOUBLE AS y0,
    CASE WHEN doc_id % 5 = 0 AND n % 2 = 0 THEN 280.0 ELSE 545.0 END::DOUBLE AS x1, (20 + 85 * (n % 10) + CASE WHEN length(text) <= 30 THEN 96 ELSE 80 END)::DOUBLE AS y1,
    CASE WHEN length(text) <= 30 THEN 14.0 ELSE 10.0 END::DOUBLE AS size, length(text) <= 30 AS is_bold,
    CASE WHEN doc_id % 3 = 0 THEN (40 + n % 60) / 100.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, 595.0::DOUBLE AS width, 880.0::DOUBLE AS height
  FROM raw WHERE regexp_matches(text, '\S')),
pg AS (
  SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY seq) AS raw_text, 595.0::DOUBLE AS width, 880.0::DOUBLE AS height, (doc_id % 10) / 20.0::DOUBLE AS image_ratio,
    doc_id % 10 > 0 AS has_images, (doc_id % 6)::INTEGER AS image_count FROM b GROUP BY doc_id, page_num),
bx AS (
  SELECT doc_id, page_num, (seq % 10)::INTEGER AS ord, list_value('Title', 'Text', 'Caption', 'Page-Footer', 'List')[(seq // 4) % 5 + 1] AS label, (50 + 2 * (seq % 20)) / 100.0::DOUBLE AS confidence,
    x0 - 2 AS x0, y0 - 1 AS y0, x1 + 3 AS x1, y1 + 2 AS y1 FROM b WHERE (seq % 10) % 4 = 0),
np AS (SELECT doc_id, count(DISTINCT page_num) AS n_pages FROM b GROUP BY doc_id),
nz AS (SELECT *, {normalized("text")} AS norm, (y0 + y1) / 2 AS yc FROM b),
cand AS (
  SELECT doc_id, norm AS pattern, CASE WHEN yc < height * 0.08 THEN 'header' WHEN yc > height * (1 - 0.08) THEN 'footer' END AS kind FROM nz WHERE norm <> ''
  UNION ALL SELECT doc_id, norm, CASE WHEN yc > height * 0.20 AND yc < height * 0.80 AND size > 20 THEN 'watermark' END FROM nz WHERE norm <> ''),
pat AS (
  SELECT doc_id, kind, pattern, n FROM (SELECT doc_id, kind, pattern, count(*) AS n FROM cand WHERE kind IS NOT NULL GROUP BY doc_id, kind, pattern) JOIN np USING (doc_id)
  WHERE n >= least(3, greatest(2, n_pages // 3))),
nc AS (
  SELECT nz.*, CASE WHEN {strip("text")} = '' THEN 'empty' WHEN {page_number("text")} THEN 'page_number' WHEN norm = '' THEN NULL
    WHEN yc < height * 0.08 AND EXISTS (SELECT 1 FROM pat p WHERE p.doc_id = nz.doc_id AND p.kind = 'header' AND p.pattern = nz.norm) THEN 'header'
    WHEN yc > height * (1 - 0.08) AND EXISTS (SELECT 1 FROM pat p WHERE p.doc_id = nz.doc_id AND p.kind = 'footer' AND p.pattern = nz.norm) THEN 'footer'
    WHEN yc > height * 0.20 AND yc < height * 0.80 AND EXISTS (SELECT 1 FROM pat p WHERE p.doc_id = nz.doc_id AND p.kind = 'watermark' AND p.pattern = nz.norm) THEN 'watermark' END AS noise
  FROM nz),
fs AS (
  SELECT doc_id, round(coalesce(avg(CASE WHEN size > 0 THEN size END), 10.0), 6) AS avg_font_size, round(coalesce(avg(CASE WHEN gap > 0 THEN gap END), 5.0), 6) AS avg_line_gap
  FROM (SELECT *, CASE WHEN page_num <= 10 THEN y0 - lag(y1) OVER (PARTITION BY doc_id, page_num ORDER BY y0, seq) END AS gap FROM b) GROUP BY doc_id),
ps AS (
  SELECT doc_id, page_num, count(*) AS n, avg(size) AS avg_size, avg((abs((x0 + x1) / 2 - width / 2) <= width * 0.25)::INT) AS centered,
    avg((length({strip("text")}) < 30)::INT) AS short, avg(regexp_matches({strip("text")}, '\d{{1,4}}\s*$')::INT) AS numbered FROM b GROUP BY doc_id, page_num)
"""


def with_ctes(select: str, *more: str) -> str:
    return "WITH " + ", ".join([CTES, *more]) + "\n" + select
