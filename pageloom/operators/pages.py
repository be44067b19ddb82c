"""What kind of page a page is, and what kind of document a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import quality as Q
from ..functions import text as X
from ..plans.config import DEFAULT, Config

# Marks of tables of contents, table lines, document kinds.
TOC_LINES = (r"\.{3,}", "…{2,}", r"^.{2,50}\s*\.{3,}\s*\d{1,4}\s*$", r"^.{2,50}\s+\d{1,4}\s*$")
TOC_WORDS = ("목 차", "목차", "차 례", "차례", "Contents", "CONTENTS")
TABLE_MARKS = ("─", "━", "│", "┃", "|", "+", "-+-")
LEGAL_WORDS = ("약관", "조항", "제1조", "제2조", "제3조", "계약", "법률", "시행령", "시행규칙", "갑", "을", "보험", "보험금", "피보험자", "보험계약자", "면책", "해지", "배상", "손해", "조항", "별표", "부칙")
ACADEMIC_WORDS = (
    "abstract", "references", "introduction", "methodology", "conclusion", "et al.", "doi", "fig.", "table", "acknowledgment", "acknowledgement", "bibliography", "hypothesis",
    "literature review", "results", "discussion", "appendix", "초록", "참고문헌", "서론", "결론", "연구방법",
)
DENSITY = 0.002


def _has_word(c):
    t = F.when(X.has(c, ("목차로",)), F.regexp_replace(c, r"목차로\s*돌아가기", "")).otherwise(c)
    out = F.lit(False)
    for w in TOC_WORDS:
        out = out | t.contains(w)
    return out


def page_stats(blocks: DataFrame) -> DataFrame:
    """Per page: what the rules for covers and tables of contents look at."""
    b = G.box()
    t = X.strip(F.col("text"))
    return blocks.groupBy("doc_id", "page_num").agg(
        F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg_size"),
        F.avg((F.abs(G.center_x(b) - F.col("width") / 2) <= F.col("width") * 0.25).cast("double")).alias("centered"),
        F.avg((F.length(t) < 30).cast("double")).alias("short"), F.avg(X.last_in(t, "0-9").cast("double")).alias("numbered"),
    )


def is_cover():
    return (F.col("page_num") <= 3) & (F.col("n") <= 10) & (F.col("avg_size") >= 14) & (F.col("centered") >= 0.5)


def is_toc(word=None):
    """``word``: whether the page's text has a word for contents, if that is known."""
    return (_has_word(F.col("raw_text")) if word is None else word) | ((F.col("n") >= 5) & (F.col("short") >= 0.6) & (F.col("numbered") >= 0.4))


def toc_line_share(c):
    """The share of lines that look like entries of a table of contents; null without lines."""
    ls = F.filter(F.transform(F.split(c, "\n"), X.strip), lambda x: x != "")
    entry = lambda x: F.when(X.has(x, ("...", "……")) | X.last_in(x, "0-9"), X.matches(x, TOC_LINES)).otherwise(False)  # noqa: E731  no other line can be one
    return F.size(F.filter(ls, entry)) / F.nullif(F.size(ls), F.lit(0))


def typed(pages: DataFrame, blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds ``page_type``: cover, toc, noise, scanned, mixed or digital."""
    t = F.col("raw_text")
    # all that looks at a page's text comes before the join, through which the text then needn't go
    p = pages.withColumns({"_chars": F.length(X.strip(t)), "_word": _has_word(t), "_share": F.coalesce(toc_line_share(t), F.lit(0.0))})
    chars = F.col("_chars")
    enough = chars >= cfg.min_chars_per_page
    p = p.withColumn("_broken", F.coalesce(enough & (Q.is_undecodable(t) | ((chars < cfg.garble_text_trust_chars) & Q.is_garbled(t))), F.lit(False)))
    kind = (
        F.when(is_cover(), "cover").when(is_toc(F.col("_word")), "toc").when((chars < 5) & ~F.col("has_images"), "noise").when(F.col("_share") > cfg.toc_threshold, "noise")
        .when(F.col("_broken"), "scanned").when(~enough, "scanned").when(F.col("image_ratio") > cfg.image_area_table_hint, "mixed").otherwise("digital")
    )
    return p.join(page_stats(blocks), ["doc_id", "page_num"]).withColumn("page_type", kind).drop("_chars", "_word", "_share", "_broken")


def profile(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per document: pages, text pages, characters, image share, table marks, and how complex it is."""
    t = X.strip(F.col("raw_text"))
    mark = F.lit(False)
    for m in TABLE_MARKS:
        mark = mark | F.col("raw_text").contains(m)
    size = F.col("width") * F.col("height")
    out = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if(F.length(t) >= cfg.min_chars_per_page).alias("text_pages"),
        F.count_if((F.length(t) < cfg.min_chars_per_page) & F.col("has_images")).alias("image_only_pages"), F.sum(F.length(t)).alias("total_chars"),
        F.round(F.sum(F.col("image_ratio") * size) / F.sum(size), 4).alias("image_area_ratio"), F.bool_or(mark).alias("has_tables"),
    )
    image = F.col("image_area_ratio") > cfg.image_area_table_hint
    kind = F.when(F.col("image_only_pages") / F.col("total_pages") >= cfg.image_heavy_ratio, "image_heavy").when((F.col("image_only_pages") > 0) & image, "mixed").when(F.col("has_tables") | image, "text_with_tables").otherwise("text_only")
    return out.withColumns({"avg_chars_per_page": F.round(F.col("total_chars") / F.col("total_pages"), 1), "complexity": kind})


def strategies(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page: how to read it, from cheap figures alone."""
    t = X.strip(F.col("raw_text"))
    ls = F.filter(F.transform(F.split(t, "\n"), X.strip), lambda x: x != "")
    dots = F.size(F.filter(ls, lambda x: x.rlike(r"\.{3,}")))
    word = F.lit(False)
    for w in TOC_WORDS:
        word = word | t.contains(w)
    skip = ((F.length(t) < 10) & (F.col("image_count") == 0)) | word | ((F.size(ls) >= 5) & (dots / F.greatest(F.size(ls), F.lit(1)) > 0.3))
    density = F.length(t) / (F.col("width") * F.col("height"))
    method = F.when(skip, "skip").when((density < 0.05) & (F.col("image_count") > 0), "ocr").when(Q.garbled_ratio(t) > 0.15, "ocr").otherwise("text")
    same = blocks.groupBy("doc_id", "page_num").agg(homogeneous().alias("homogeneous"))
    out = pages.join(same, ["doc_id", "page_num"]).withColumn("method", method)
    return out.withColumns({"layout_needed": (F.col("image_count") > 3) | F.col("homogeneous"), "page_complexity": F.when(F.col("image_count") > 3, "image_heavy").otherwise("simple")})


def homogeneous():
    """Aggregate: at least five font sizes that hardly differ."""
    s = F.when(F.col("size") > 0, F.col("size"))
    return (F.count(s) >= 5) & F.coalesce(F.stddev_pop(s) / F.avg(s) < 0.05, F.lit(False))


def strategy_report(strategies_: DataFrame) -> DataFrame:
    """Per document: pages by method and pages that need layout detection."""
    return strategies_.groupBy("doc_id").agg(*(F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("text", "ocr", "skip")), F.count_if("layout_needed").alias("n_layout"))


def language(pages: DataFrame) -> DataFrame:
    """Per document: the language that the letters at the start of its first five pages suggest."""
    t = F.substring("raw_text", 1, 500)
    n = lambda p: F.sum(Q.count(t, p))
    total = n(f"[^{X.WS}]")
    got = pages.where("page_num <= 5").groupBy("doc_id").agg((n(Q.HANGUL) / total).alias("hangul"), (n(r"[\x{4e00}-\x{9fff}]") / total).alias("cjk"), (n("[A-Za-z]") / total).alias("latin"))
    return got.select("doc_id", F.when(F.col("hangul") > 0.15, "ko").when(F.col("cjk") > 0.15, "zh").when(F.col("latin") > 0.3, "en").otherwise("ko").alias("language"))


def document_type(pages: DataFrame) -> DataFrame:
    """Per document: legal, academic or general, by the density of keywords on its first ten pages."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "raw_text"))), lambda x: x["raw_text"]), "\n")
    d = pages.where("page_num <= 10").groupBy("doc_id").agg(text.alias("t")).withColumn("l", F.lower("t"))

    def density(words: tuple[str, ...]):
        out = F.lit(0)
        for w in words:
            own = F.col("l") if any(c.isascii() and c.isalpha() for c in w) else F.col("t")
            out = out + (F.length(own) - F.length(F.replace(own, F.lit(w), F.lit("")))) / len(w)
        return out / F.length("l")

    d = d.withColumns({"legal": density(LEGAL_WORDS), "academic": density(ACADEMIC_WORDS)})
    legal = F.col("legal") >= DENSITY
    kind = F.when((F.col("academic") >= DENSITY) & (~legal | (F.col("academic") > F.col("legal"))), "academic").when(legal, "legal_korean").otherwise("general")
    return d.select("doc_id", F.round("legal", 6).alias("legal_density"), F.round("academic", 6).alias("academic_density"), kind.alias("document_type"))


def font_stats(blocks: DataFrame) -> DataFrame:
    """Per document: mean font size, and mean positive gap between lines on its first ten pages."""
    from pyspark.sql import Window

    gap = F.col("y0") - F.lag("y1").over(Window.partitionBy("doc_id", "page_num").orderBy("y0", "seq"))
    b = blocks.withColumn("gap", F.when(F.col("page_num") <= 10, gap))
    return b.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(10.0)), 6).alias("avg_font_size"), F.round(F.coalesce(F.avg(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(5.0)), 6).alias("avg_line_gap"))
