"""Queries about noise, pages, text quality and headings of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as X
from ..operators import classify, noise, pages, structure
from ..operators.classify import ACADEMIC_FIRST, DATA, LEVELS, NUMBERING, WEIGHTS
from ..operators.pages import ACADEMIC_WORDS, LEGAL_WORDS, TABLE_MARKS, TOC_LINES, TOC_WORDS
from ..operators.structure import POSTPOSITIONS, CONJUNCTIONS, SENTENCE_END, STRUCTURE_START, SUFFIXES
from ..sources import adapters as A
from . import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lines(A.spread(_texts(spark, sf_dir).select("doc_id", "text")))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spread(A.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _clean(b: DataFrame) -> DataFrame:
    return noise.kept(noise.classified(b, noise.learned(b)))


@query(S.with_ctes("SELECT doc_id, kind, pattern, n::BIGINT AS n FROM pat"))
def noise_patterns(spark, sf_dir):
    return noise.learned(blocks(spark, sf_dir))


@query(S.with_ctes("SELECT doc_id, count(*) FILTER (noise = 'header') AS n_header, count(*) FILTER (noise = 'footer') AS n_footer, count(*) FILTER (noise = 'page_number') AS n_page_number, count(*) FILTER (noise = 'watermark') AS n_watermark, count(*) FILTER (noise IS NULL) AS n_kept FROM nc GROUP BY doc_id"))
def noise_filter_stats(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return noise.stats(noise.classified(b, noise.learned(b)))


_LAYOUT_NOISE = f"""lh AS (SELECT b.doc_id, b.page_num, b.seq, arg_min(bx.label, bx.ord) AS label FROM b JOIN bx ON b.doc_id = bx.doc_id AND b.page_num = bx.page_num
  AND bx.label IN ('Footer', 'Page-Footer', 'Page-Number', 'Page-Header', 'Header') AND {S.iou("b.", "bx.")} >= 0.3 GROUP BY ALL)"""


@query(S.with_ctes("SELECT doc_id, page_num, seq, CASE WHEN label IN ('Footer', 'Page-Footer') THEN 'footer' WHEN label = 'Page-Number' THEN 'page_number' WHEN label IS NOT NULL THEN 'header' ELSE noise END AS noise FROM nc LEFT JOIN lh USING (doc_id, page_num, seq)", _LAYOUT_NOISE))
def noise_layout(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return noise.with_layout(noise.classified(b, noise.learned(b)), A.layout_boxes(b)).select("doc_id", "page_num", "seq", "noise")


@query(S.with_ctes("SELECT * FROM fs"))
def doc_font_stats(spark, sf_dir):
    return pages.font_stats(blocks(spark, sf_dir))


_COVER = "page_num <= 3 AND n <= 10 AND avg_size >= 14 AND centered >= 0.5"
_WORD = "(" + " OR ".join(f"contains(regexp_replace(raw_text, '목차로\\s*돌아가기', '', 'g'), '{w}')" for w in TOC_WORDS) + ")"
_TOC = f"({_WORD} OR (n >= 5 AND short >= 0.6 AND numbered >= 0.4))"
_LINES = f"list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')"
_SHARE = f"coalesce(len(list_filter({_LINES}, lambda x: {S.match('x', *TOC_LINES)})) / nullif(len({_LINES}), 0)::DOUBLE, 0.0)"
_CHARS = f"length({S.strip('raw_text')})"
_TYPE = f"""CASE WHEN {_COVER} THEN 'cover' WHEN {_TOC} THEN 'toc' WHEN {_CHARS} < 5 AND NOT has_images THEN 'noise' WHEN {_SHARE} > 0.4 THEN 'noise'
  WHEN {_CHARS} >= 50 AND {S.readable('raw_text')} < 0.3 THEN 'scanned' WHEN {_CHARS} < 50 THEN 'scanned' WHEN image_ratio > 0.15 THEN 'mixed' ELSE 'digital' END"""
_PT = f"pt AS (SELECT pg.*, ps.n, avg_size, centered, short, numbered, {_TYPE} AS page_type FROM pg JOIN ps USING (doc_id, page_num))"


@query(S.with_ctes("SELECT doc_id, page_num, page_type FROM pt", _PT))
def page_type(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return pages.typed(A.pages(b), b).select("doc_id", "page_num", "page_type")


@query(S.with_ctes(f"SELECT doc_id, page_num, n::BIGINT AS n, round(avg_size, 6) AS avg_size, round(centered, 6) AS centered FROM ps WHERE {_COVER}"))
def cover_pages(spark, sf_dir):
    s = pages.page_stats(blocks(spark, sf_dir))
    return s.where(pages.is_cover()).select("doc_id", "page_num", "n", F.round("avg_size", 6).alias("avg_size"), F.round("centered", 6).alias("centered"))


@query(S.with_ctes(f"SELECT doc_id, page_num, {_TOC} AS is_toc, round({_SHARE}, 6) AS toc_line_share FROM pg JOIN ps USING (doc_id, page_num)"))
def toc_pages(spark, sf_dir):
    b = blocks(spark, sf_dir)
    p = A.pages(b).join(pages.page_stats(b), ["doc_id", "page_num"])
    return p.select("doc_id", "page_num", pages.is_toc().alias("is_toc"), F.round(F.coalesce(pages.toc_line_share(F.col("raw_text")), F.lit(0.0)), 6).alias("toc_line_share"))


_MARK = "(" + " OR ".join(f"contains(raw_text, {S.q(m)})" for m in TABLE_MARKS) + ")"


@query(S.with_ctes(f"""SELECT *, round(total_chars / total_pages::DOUBLE, 1) AS avg_chars_per_page, CASE WHEN image_only_pages / total_pages::DOUBLE >= 0.5 THEN 'image_heavy' WHEN image_only_pages > 0 AND image_area_ratio > 0.15 THEN 'mixed'
  WHEN has_tables OR image_area_ratio > 0.15 THEN 'text_with_tables' ELSE 'text_only' END AS complexity FROM (SELECT doc_id, count(*) AS total_pages, count(*) FILTER ({_CHARS} >= 50) AS text_pages,
  count(*) FILTER ({_CHARS} < 50 AND has_images) AS image_only_pages, sum({_CHARS})::BIGINT AS total_chars, round(sum(image_ratio * width * height) / sum(width * height), 4) AS image_area_ratio, bool_or({_MARK}) AS has_tables FROM pg GROUP BY doc_id)"""))
def doc_profile(spark, sf_dir):
    return pages.profile(A.pages(blocks(spark, sf_dir)))


_T = S.strip("raw_text")
_SLINES = f"list_filter(list_transform(string_split({_T}, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')"
_SWORD = "(" + " OR ".join(f"contains({_T}, '{w}')" for w in TOC_WORDS) + ")"
_SKIP = f"((length({_T}) < 10 AND image_count = 0) OR {_SWORD} OR (len({_SLINES}) >= 5 AND len(list_filter({_SLINES}, lambda x: regexp_matches(x, '\\.{{3,}}'))) / greatest(len({_SLINES}), 1)::DOUBLE > 0.3))"
_ST = f"""hg AS (SELECT doc_id, page_num, count(CASE WHEN size > 0 THEN size END) >= 5 AND coalesce(stddev_pop(CASE WHEN size > 0 THEN size END) / avg(CASE WHEN size > 0 THEN size END) < 0.05, false) AS homogeneous FROM b GROUP BY ALL),
st AS (SELECT doc_id, page_num, CASE WHEN {_SKIP} THEN 'skip' WHEN length({_T}) / (width * height) < 0.05 AND image_count > 0 THEN 'ocr' WHEN {_T} <> '' AND 1 - {S.readable(_T)} > 0.15 THEN 'ocr' ELSE 'text' END AS method,
  image_count > 3 OR homogeneous AS layout_needed, CASE WHEN image_count > 3 THEN 'image_heavy' ELSE 'simple' END AS page_complexity, homogeneous FROM pg JOIN hg USING (doc_id, page_num))"""


@query(S.with_ctes("SELECT doc_id, page_num, method, layout_needed, page_complexity FROM st", _ST))
def page_strategy(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return pages.strategies(A.pages(b), b).select("doc_id", "page_num", "method", "layout_needed", "page_complexity")


@query(S.with_ctes("SELECT doc_id, count(*) FILTER (method = 'text') AS n_text, count(*) FILTER (method = 'ocr') AS n_ocr, count(*) FILTER (method = 'skip') AS n_skip, count(*) FILTER (layout_needed) AS n_layout FROM st GROUP BY doc_id", _ST))
def strategy_counts(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return pages.strategy_report(pages.strategies(A.pages(b), b))


@query(S.with_ctes("SELECT doc_id, page_num, homogeneous FROM st", _ST))
def font_homogeneous(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("doc_id", "page_num").agg(pages.homogeneous().alias("homogeneous"))


_L = lambda p: f"sum({S.count('left(raw_text, 500)', p)})"


@query(S.with_ctes(f"""SELECT doc_id, CASE WHEN h / t > 0.15 THEN 'ko' WHEN c / t > 0.15 THEN 'zh' WHEN l / t > 0.3 THEN 'en' ELSE 'ko' END AS language FROM (SELECT doc_id, {_L(f"[^{X.WS}]")}::DOUBLE AS t, {_L(Q.HANGUL)} AS h, {_L("[" + chr(92) + "x{4e00}-" + chr(92) + "x{9fff}]")} AS c, {_L("[A-Za-z]")} AS l FROM pg WHERE page_num <= 5 GROUP BY doc_id)"""))
def language_detect(spark, sf_dir):
    return pages.language(A.pages(blocks(spark, sf_dir)))


def _density(words):
    own = lambda w: "l" if any(c.isascii() and c.isalpha() for c in w) else "t"
    return "(" + " + ".join(f"(length({own(w)}) - length(replace({own(w)}, {S.q(w)}, ''))) / {len(w)}.0::DOUBLE" for w in words) + ") / length(l)"


@query(S.with_ctes(f"""SELECT doc_id, round(a, 6) AS legal_density, round(c, 6) AS academic_density, CASE WHEN c >= 0.002 AND (a < 0.002 OR c > a) THEN 'academic' WHEN a >= 0.002 THEN 'legal_korean' ELSE 'general' END AS document_type
  FROM (SELECT doc_id, {_density(LEGAL_WORDS)} AS a, {_density(ACADEMIC_WORDS)} AS c FROM (SELECT doc_id, string_agg(raw_text, chr(10) ORDER BY page_num) AS t, lower(string_agg(raw_text, chr(10) ORDER BY page_num)) AS l FROM pg WHERE page_num <= 10 GROUP BY doc_id))"""))
def doc_type_density(spark, sf_dir):
    return pages.document_type(A.pages(blocks(spark, sf_dir)))


@query(f"SELECT doc_id, round({S.readable('text')}, 6) AS readable_ratio, {S.readable('text')} < 0.3 AS undecodable FROM documents")
def readable_ratio(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.round(Q.readable_ratio(F.col("text")), 6).alias("readable_ratio"), Q.is_undecodable(F.col("text")).alias("undecodable"))


_SIG = f"sg AS (SELECT doc_id, {S.health('text')} AS e, {S.cid_ratio('text')} AS c, {S.printable('text')} AS p, {S.consistency('text')} AS l FROM documents)"


@query(f"WITH {_SIG} SELECT doc_id, round(e, 6) AS encoding_health, round(c, 6) AS cid_ratio, round(p, 6) AS printable_ratio, round(l, 6) AS language_consistency, round(e * 0.35 + c * 0.30 + p * 0.20 + l * 0.15, 6) AS quality_score FROM sg")
def quality_signals(spark, sf_dir):
    s = Q.signals(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", *(F.round(v, 6).alias(k) for k, v in s.items()), F.round(Q.composite(s), 6).alias("quality_score"))


@query(f"WITH {_SIG} SELECT doc_id, score >= 0.8 AS passes, round(score, 6) AS quality_score, CASE WHEN score < 0.4 THEN 'confidence_downgrade' ELSE 'none' END AS repair_method, CASE WHEN score < 0.4 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence_penalty FROM (SELECT *, e * 0.35 + c * 0.30 + p * 0.20 + l * 0.15 AS score FROM sg)")
def quality_gate(spark, sf_dir):
    """None of the test texts holds glyph references, so that the SQL leaves that repair out."""
    g = Q.gate(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", (~g["needs_repair"]).alias("passes"), F.round(g["quality_score"], 6).alias("quality_score"), g["repair_method"].alias("repair_method"), g["confidence_penalty"].alias("confidence_penalty"))


@query(f"WITH {_SIG} SELECT quality, toxic, count(*) AS n, round(avg(e * 0.35 + c * 0.30 + p * 0.20 + l * 0.15), 6) AS mean_score FROM sg JOIN labels USING (doc_id) GROUP BY quality, toxic")
def quality_vs_label(spark, sf_dir):
    s = _texts(spark, sf_dir).select("doc_id", Q.composite(Q.signals(F.col("text"))).alias("score"))
    return s.join(A.table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


_GB = f"(CASE WHEN {S.strip('text')} = '' THEN 0.0 ELSE 1 - {S.readable(S.strip('text'))} END)"


@query(S.with_ctes(f"""SELECT doc_id, page_num, seq, round(s, 6) AS block_score, s < 0.6 OR confidence < 0.6 OR g > 0.2 AS needs_retry, CASE WHEN NOT (s < 0.6 OR confidence < 0.6 OR g > 0.2) THEN 'none' WHEN g > 0.5 OR length({S.strip('text')}) < 5 THEN 'vlm' WHEN g > 0.2 THEN 'ocr' ELSE 'none' END AS fallback
  FROM (SELECT *, {_GB} AS g, greatest(0.0, least(1.0, confidence * (1 - {_GB}))) AS s FROM b)"""))
def block_quality(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("block_type", F.lit("text"))
    return Q.block_scores(b).select("doc_id", "page_num", "seq", F.round("block_score", 6).alias("block_score"), "needs_retry", "fallback")


_TT = S.strip("text")


def _signals_sql(table: str = "b") -> str:
    sig = {
        "font_deviation": "CASE WHEN size <= 0 OR av <= 0 THEN 0.0 WHEN dev >= 2 THEN 1.0 WHEN dev >= 1 THEN 0.5 + 0.5 * (dev - 1) WHEN dev >= 0.5 THEN 0.25 * (dev - 0.5) / 0.5 ELSE 0.0 END",
        "font_weight": "is_bold::INT", "bbox_height_ratio": "CASE WHEN md <= 0 THEN 0.0 WHEN (y1 - y0) / md >= 1.5 THEN 1.0 WHEN (y1 - y0) / md >= 1.2 THEN ((y1 - y0) / md - 1) / 0.5 ELSE 0.0 END",
        "vertical_gap": "CASE WHEN bf IS NULL THEN 0.0 WHEN greatest(0.0, y0 - bf) / height >= 0.05 THEN 1.0 WHEN greatest(0.0, y0 - bf) / height >= 0.02 THEN (greatest(0.0, y0 - bf) / height - 0.02) / 0.03 ELSE 0.0 END",
        "text_length": "CASE WHEN length(t) = 0 THEN 0.0 WHEN length(t) <= 10 THEN 1.0 WHEN length(t) <= 30 THEN 0.7 WHEN length(t) <= 60 THEN 0.3 WHEN length(t) <= 100 THEN 0.1 ELSE 0.0 END",
        "has_numbering": S.match("t", *NUMBERING) + "::INT", "layout_label": "0", "ends_without_period": "(NOT (t = '' OR regexp_matches(t, '[.。]$')))::INT",
        "width_ratio": "CASE WHEN (x1 - x0) / width <= 0.3 THEN 1.0 WHEN (x1 - x0) / width <= 0.5 THEN 0.6 WHEN (x1 - x0) / width <= 0.7 THEN 0.3 ELSE 0.0 END", "data_bearing": S.match("t", *DATA) + "::INT",
    }
    total = " + ".join(f"s_{k} * CASE WHEN same THEN {w1} ELSE {w0} END" for k, (w0, w1) in WEIGHTS.items())
    level = "CASE " + " ".join(f"WHEN regexp_matches(t, {S.q(p)}) THEN {v}" for p, v in LEVELS) + r" WHEN dec <> '' THEN least(2 + length(dec) - length(replace(dec, '.', '')), 6) WHEN s_font_deviation >= 0.8 THEN 2 WHEN s_font_deviation >= 0.5 THEN 3 WHEN s_font_deviation >= 0.25 THEN 4 ELSE 2 END"
    return f"""f0 AS (SELECT {table}.*, avg_font_size AS av, {_TT} AS t, coalesce(stddev_samp(CASE WHEN size > 0 THEN size END) OVER w, 0) AS sd, count(CASE WHEN size > 0 THEN size END) OVER w AS nf, avg(CASE WHEN size > 0 THEN size END) OVER w AS mf,
      coalesce(median(CASE WHEN y1 > y0 THEN y1 - y0 END) OVER w, 0) AS md, lag(y1) OVER (PARTITION BY doc_id, page_num ORDER BY seq) AS bf FROM {table} JOIN fs USING (doc_id) WINDOW w AS (PARTITION BY doc_id, page_num)),
    f1 AS (SELECT *, nf >= 5 AND sd / mf < 0.05 AS same, (size - av) / CASE WHEN sd > 0 THEN sd ELSE av * 0.15 END AS dev, regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\.\\s', 1) AS dec FROM f0),
    f2 AS (SELECT *, {", ".join(f"{v} AS s_{k}" for k, v in sig.items())} FROM f1),
    hc AS (SELECT *, CASE WHEN t <> '' AND score >= 0.35 THEN 'heading' ELSE 'text' END AS block_type, (CASE WHEN t <> '' AND score >= 0.35 THEN {level} ELSE 0 END)::INTEGER AS heading_level FROM (SELECT *, round({total}, 9) AS score FROM f2))"""


_HC = _signals_sql()


def _headings(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return classify.classified(b, pages.font_stats(b))


@query(S.with_ctes("SELECT doc_id, page_num, seq, round(score, 6) AS score, block_type, heading_level FROM hc", _HC))
def heading_classify(spark, sf_dir):
    return _headings(spark, sf_dir).select("doc_id", "page_num", "seq", F.round("score", 6).alias("score"), "block_type", "heading_level")


@query(S.with_ctes("SELECT heading_level, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hc GROUP BY heading_level", _HC))
def heading_levels(spark, sf_dir):
    return _headings(spark, sf_dir).groupBy("heading_level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def _hierarchy_sql(source: str, keys: str = "doc_id, page_num", order: str = "seq", name: str = "hh") -> str:
    bid = "substr(md5(printf('%s|%d|%.1f|%.1f', text, page_num, x0, y0)), 1, 12)"
    return f"""{name}0 AS (SELECT *, {bid} AS block_id, CASE WHEN block_type = 'heading' THEN CASE WHEN heading_level > 0 THEN heading_level ELSE 1 END END AS lv, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}),
    {name} AS (SELECT c.*, (SELECT arg_max(p.block_id, p.rn) FROM {name}0 p WHERE {" AND ".join(f"p.{k.strip()} = c.{k.strip()}" for k in keys.split(","))} AND p.rn < c.rn AND p.lv IS NOT NULL AND (c.lv IS NULL OR p.lv < c.lv)) AS parent_id FROM {name}0 c)"""


@query(S.with_ctes("SELECT doc_id, page_num, seq, block_id, parent_id FROM hh", _HC, _hierarchy_sql("hc")))
def heading_hierarchy(spark, sf_dir):
    return structure.hierarchy(_headings(spark, sf_dir)).select("doc_id", "page_num", "seq", "block_id", "parent_id")


_OCR = f"""oc AS (SELECT doc_id, page_num, seq, round(0.3 * title + 0.15 * CASE WHEN md <= 0 THEN 0.0 WHEN (y1 - y0) / md >= 1.5 THEN 1.0 WHEN (y1 - y0) / md >= 1.2 THEN ((y1 - y0) / md - 1) / 0.5 ELSE 0.0 END + 0.35 * (lev IS NOT NULL)::INT
  + 0.2 * (CASE WHEN length(t) = 0 THEN 0.0 ELSE CASE WHEN length(t) < 30 THEN 0.5 WHEN length(t) < 50 THEN 0.25 ELSE 0.0 END + CASE WHEN y0 < height * 0.3 THEN 0.5 ELSE 0.0 END END), 9) AS ocr_score, lev FROM (
  SELECT hc.*, CASE {" ".join(f"WHEN regexp_matches(t, {S.q(p)}) THEN {v}" for p, v in classify.OCR_LEVELS)} END AS lev,
    EXISTS (SELECT 1 FROM bx WHERE bx.doc_id = hc.doc_id AND bx.page_num = hc.page_num AND bx.label = 'Title' AND {S.iou("bx.", "hc.")} >= 0.3)::INT AS title FROM hc))"""


@query(S.with_ctes("SELECT doc_id, page_num, seq, ocr_score, CASE WHEN ocr_score > 0.4 THEN 'heading' ELSE 'text' END AS block_type, CASE WHEN ocr_score > 0.4 THEN coalesce(lev, 2) ELSE 0 END::INTEGER AS heading_level FROM oc", _HC, _OCR))
def ocr_headings(spark, sf_dir):
    b = blocks(spark, sf_dir)
    plain = b.withColumns({"size": F.lit(0.0), "block_type": F.lit("text"), "heading_level": F.lit(0)})
    return classify.ocr_headings(plain, A.layout_boxes(b)).select("doc_id", "page_num", "seq", "ocr_score", "block_type", "heading_level")


_ACAD = "CASE WHEN t = '' THEN 'text/0' " + " ".join(f"WHEN regexp_matches(t, {S.q(p)}) THEN '{k}/{v}'" for p, k, v in ACADEMIC_FIRST) + " WHEN av > 0 AND size > av * 1.3 AND is_bold AND length(t) <= 120 THEN 'heading/2' WHEN av > 0 AND size > av * 1.2 THEN 'heading/3' ELSE 'text/0' END"


@query(S.with_ctes(f"SELECT doc_id, page_num, seq, split_part(k, '/', 1) AS block_type, split_part(k, '/', 2)::INTEGER AS heading_level FROM (SELECT *, {_ACAD} AS k FROM f0)", _HC))
def profile_english(spark, sf_dir):
    b = blocks(spark, sf_dir).join(pages.font_stats(blocks(spark, sf_dir)).select("doc_id", "avg_font_size"), "doc_id")
    k = classify.english_academic(F.col("text"), F.col("size"), F.col("is_bold"), F.col("avg_font_size"))
    return b.withColumn("k", k).select("doc_id", "page_num", "seq", "k.block_type", "k.heading_level")


def _legal_sql(t: str, size: str, bold: str) -> str:
    base = f"(CASE WHEN av > 0 AND {size} > av * 1.3 AND {bold} THEN 2 WHEN av > 0 AND {size} > av * 1.2 THEN 3 END)"
    rules = [f"WHEN {t} = '' THEN 'text'"] + [f"WHEN regexp_matches({t}, {S.q(p)}) THEN '{k}'" for p, k, _ in classify.LEGAL_FIRST]
    rules += [f"WHEN regexp_matches({t}, {S.q(classify.LEGAL_DECIMAL)}) AND length({t}) <= 80 THEN 'heading'", f"WHEN {base} IS NOT NULL AND {S.match(t, *(p for p, _ in classify.LEGAL_DEPTH), classify.LEGAL_PREFIX)} THEN 'heading'", f"WHEN {base} IS NOT NULL AND {bold} AND length({t}) <= 80 THEN 'heading'"]
    rules += [f"WHEN regexp_matches({t}, {S.q(p)}) THEN '{k}'" for p, k, _ in classify.LEGAL_LAST]
    return "CASE " + " ".join(rules) + " ELSE 'text' END"


_MERGE = f"""m0 AS (SELECT hc.*, avg_line_gap AS lg, lag(text) OVER w AS pt0, {S.strip("lag(text) OVER w")} AS pt, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(size) OVER w AS psize, lag(is_bold) OVER w AS pbold FROM hc JOIN fs USING (doc_id) WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY seq)),
m1 AS (SELECT *, {_legal_sql("t", "size", "is_bold")} AS mine, {_legal_sql("pt", "psize", "pbold")} AS its, abs(size - psize) < 0.5 AND is_bold = pbold AS samefont, y0 - py1 AS gap, abs(x0 - px0) AS indent FROM m0),
m2 AS (SELECT *, CASE WHEN pt0 IS NULL THEN true WHEN t = '' OR pt = '' THEN true WHEN py1 - py0 > 0 AND gap >= (py1 - py0) * 1.2 THEN true WHEN regexp_matches(pt, '[\\(（\\[「『【]\\s*$') THEN false WHEN regexp_matches(t, '^\\s*[\\)）\\]」』】]') THEN false
  WHEN regexp_matches(pt, ',\\s*$') THEN false WHEN regexp_matches(pt, '[-–—]\\s*$') THEN false WHEN its = 'heading' THEN NOT (samefont AND (lg <= 0 OR gap <= lg * 1.5) AND indent <= 5 AND mine = 'text' AND length(pt) <= 40)
  WHEN mine <> 'text' THEN true WHEN lg > 0 AND gap > lg * 1.5 THEN true WHEN indent > 5 THEN true WHEN abs(size - psize) > 1 OR is_bold <> pbold THEN true WHEN regexp_matches(t, '^(?:{"|".join(POSTPOSITIONS + CONJUNCTIONS)})') THEN false
  WHEN regexp_matches(pt, '(?:\\d[\\d,.]+\\s*원|\\d{{4}}[./-]\\d{{1,2}}[./-]\\d{{1,2}})\\s*$') THEN false WHEN NOT regexp_matches(pt, '[.。?!:;]$') THEN false WHEN regexp_matches(pt, '(?:{"|".join(SUFFIXES)})$') THEN false WHEN samefont THEN false ELSE true END AS split FROM m1),
m3 AS (SELECT *, sum(split::INT) OVER (PARTITION BY doc_id, page_num ORDER BY seq) AS island, CASE WHEN split THEN t ELSE CASE WHEN regexp_matches(pt, '[\\(（\\[「『【]\\s*$') OR regexp_matches(t, '^\\s*[\\)）\\]」』】]') THEN '' WHEN regexp_matches(pt, '[가-힣]$') AND regexp_matches(t, '^[가-힣]') THEN '' ELSE ' ' END || t END AS piece FROM m2),
mg AS (SELECT doc_id, page_num, min(seq)::INTEGER AS seq, string_agg(piece, '' ORDER BY seq) AS text, arg_min(x0, seq) AS x0, arg_min(y0, seq) AS y0, greatest(arg_min(x1, seq), arg_max(x1, seq)) AS x1, arg_max(y1, seq) AS y1, arg_min(block_type, seq) AS block_type, arg_min(heading_level, seq) AS heading_level, count(*) AS n_lines FROM m3 GROUP BY doc_id, page_num, island)"""


def _paragraphs(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return structure.merged_lines(_headings(spark, sf_dir), pages.font_stats(b))


@query(S.with_ctes("SELECT * FROM mg WHERE text <> ''", _HC, _MERGE))
def line_merge(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", "page_num", "seq", "text", "x0", "y0", "x1", "y1", "block_type", "heading_level", "n_lines")


_BROKEN = f"""l0 AS (SELECT doc_id, n AS line_no, text AS line, {_TT} AS s, {S.strip("lead(text) OVER (PARTITION BY doc_id ORDER BY n)")} AS nx FROM raw),
l1 AS (SELECT *, coalesce(s <> '' AND NOT regexp_matches(s, {S.q(STRUCTURE_START)}) AND right(s, 1) NOT IN ({", ".join(S.q(c) for c in SENTENCE_END)}) AND nx <> '' AND NOT regexp_matches(nx, {S.q(STRUCTURE_START)}), false) AS can FROM l0),
l2 AS (SELECT *, coalesce(sum((NOT can)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM l1),
l3 AS (SELECT *, can AND row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) % 2 = 1 AS takes FROM l2),
l4 AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS taken FROM l3)"""


@query(S.with_ctes("SELECT doc_id, line_no::INTEGER AS line_no, CASE WHEN takes THEN left(line, length(line) - length(s)) || s || CASE WHEN regexp_matches(s, '[가-힣]$') AND regexp_matches(nx, '^[가-힣]') THEN '' ELSE ' ' END || nx ELSE line END AS line FROM l4 WHERE NOT taken", _BROKEN))
def merge_broken_lines(spark, sf_dir):
    d = _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return structure.merged_broken_lines(d)


@query(S.with_ctes("""SELECT doc_id, count(DISTINCT page_num) AS pages, count(*) AS blocks, count(*) FILTER (block_type = 'heading') AS headings, max(heading_level)::INTEGER AS max_level, count(*) FILTER (parent_id IS NOT NULL) AS with_parent, round(avg(confidence), 6) AS avg_confidence
  FROM hh GROUP BY doc_id""", "bc AS (SELECT * FROM nc WHERE noise IS NULL)", _signals_sql("bc"), _hierarchy_sql("hc")))
def entry_structure_profile(spark, sf_dir):
    """The flagship: noise learned and removed, headings found and arranged, one row a document."""
    b = blocks(spark, sf_dir)
    h = structure.hierarchy(classify.classified(_clean(b), pages.font_stats(b)))
    return h.groupBy("doc_id").agg(
        F.count_distinct("page_num").alias("pages"), F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("block_type") == "heading").alias("headings"), F.max("heading_level").alias("max_level"),
        F.count_if(F.col("parent_id").isNotNull()).alias("with_parent"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )
