"""Headings by weighted signals, for printed and for recognised (OCR) text, and domain profiles as ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..plans.config import DEFAULT, Config

# Patterns, weights, thresholds, levels.
NUMBERING = (r"^제\s*\d+\s*(?:편|장|절|관|조)", "^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]", r"^\d+(?:\.\d+)*\.\s", r"^[가-하]\.\s", r"^\(\d+\)\s", r"(?i)^\([a-z]\)\s", r"(?i)^(?:chapter|section|part)\s+\d+")
NUMBERED = "0-9(가-하제①-⑳CcSsPp"  # what those begin with
DATA = (r"^[A-Za-z가-힣]+\s*:\s+\S", "[→⇒⟶]|->", r"\d{4}[-/]\d{2}[-/]\d{2}", r"\d{1,2}:\d{2}", "[A-Z]{2,}/[A-Z]{2,}")
DATA_MARKS = (":", "-", "/", "→", "⇒", "⟶")  # of which each of those needs one
LEVELS = ((r"^제\s*\d+\s*편", 1), (r"^제\s*\d+\s*장", 2), (r"^제\s*\d+\s*절", 3), (r"^제\s*\d+\s*관", 3), (r"^제\s*\d+\s*조", 4), (r"(?i)^(?:chapter|part)\s+\d+", 1), (r"(?i)^section\s+\d+", 2))
WEIGHTS = {"font_deviation": (0.13, 0.0), "font_weight": (0.10, 0.0), "bbox_height_ratio": (0.10, 0.0), "vertical_gap": (0.08, 0.25), "text_length": (0.10, 0.12), "has_numbering": (0.25, 0.25), "layout_label": (0.12, 0.15), "ends_without_period": (0.05, 0.05), "width_ratio": (0.07, 0.08), "data_bearing": (0.0, -0.25)}  # on usual pages, on pages of one font
THRESHOLD = 0.35
OCR_LEVELS = ((r"^제\s*\d+\s*편", 1), (r"^제\s*\d+\s*장", 2), (r"^제\s*\d+\s*절", 3), (r"^제\s*\d+\s*관", 3), (r"^제\s*\d+\s*조", 4), (r"^\d+\.\s", 3), (r"^[가-하]\.\s", 3))
OCR_WEIGHTS = {"title": 0.3, "height": 0.15, "pattern": 0.35, "position": 0.2}
OCR_THRESHOLD = 0.4


def _first(c: Column, rules, otherwise: Column | None = None) -> Column:
    out = None
    for pattern, value in rules:
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out.otherwise(otherwise) if otherwise is not None else out


def with_page_figures(blocks: DataFrame) -> DataFrame:
    """Adds what signals compare a block with: spread and sameness of the page's font sizes, median height, the block before."""
    page = Window.partitionBy("doc_id", "page_num")
    size, height = F.when(F.col("size") > 0, F.col("size")), F.col("y1") - F.col("y0")
    std = F.coalesce(F.stddev_samp(size).over(page), F.lit(0.0))
    return blocks.withColumns({
        "_std": std, "_same": (F.count(size).over(page) >= 5) & (std / F.avg(size).over(page) < 0.05),
        "_median": F.coalesce(F.median(F.when(height > 0, height)).over(page), F.lit(0.0)),
        "_before": F.lag("y1").over(page.orderBy("seq")),
    })


def _ratio_signal(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, 1.0).when(ratio >= 1.2, (ratio - 1.0) / 0.5).otherwise(0.0)


def signals(avg: Column, label: Column) -> dict[str, Column]:
    """The ten signals of a block with page figures; label is the layout label or null."""
    t, c = X.strip(F.col("text")), F.col
    n, width = F.length(t), c("x1") - c("x0")
    dev = (c("size") - avg) / F.when(c("_std") > 0, c("_std")).otherwise(avg * 0.15)
    gap = F.greatest(F.lit(0.0), c("y0") - c("_before")) / c("height")
    ratio = width / c("width")
    return {
        "font_deviation": F.when((c("size") <= 0) | (avg <= 0), 0.0).when(dev >= 2, 1.0).when(dev >= 1, 0.5 + 0.5 * (dev - 1)).when(dev >= 0.5, 0.25 * (dev - 0.5) / 0.5).otherwise(0.0),
        "font_weight": c("is_bold").cast("double"),
        "bbox_height_ratio": F.when(c("_median") <= 0, 0.0).otherwise(_ratio_signal((c("y1") - c("y0")) / c("_median"))),
        "vertical_gap": F.when(c("_before").isNull() | (c("height") <= 0), 0.0).when(gap >= 0.05, 1.0).when(gap >= 0.02, (gap - 0.02) / 0.03).otherwise(0.0),
        "text_length": F.when(n == 0, 0.0).when(n <= 10, 1.0).when(n <= 30, 0.7).when(n <= 60, 0.3).when(n <= 100, 0.1).otherwise(0.0),
        "has_numbering": F.when(X.first_in(t, NUMBERED), X.matches(t, NUMBERING)).otherwise(False).cast("double"),
        "layout_label": F.coalesce(label.isin("Title", "Section-header", "title", "section-header"), F.lit(False)).cast("double"),
        "ends_without_period": F.when((n == 0) | X.last_in(t, ".。"), 0.0).otherwise(1.0),
        "width_ratio": F.when((c("width") <= 0) | (width <= 0), 0.0).when(ratio <= 0.3, 1.0).when(ratio <= 0.5, 0.6).when(ratio <= 0.7, 0.3).otherwise(0.0),
        "data_bearing": F.when(n == 0, 0.0).otherwise(F.when(X.has(t, DATA_MARKS), X.matches(t, DATA)).otherwise(False).cast("double")),
    }


def classified(blocks: DataFrame, avg_font_size: DataFrame, label: str | None = None) -> DataFrame:
    """Adds score, block_type (heading or text) and heading_level. ``avg_font_size``: doc_id, avg_font_size."""
    lab = F.col(label) if label else F.lit(None).cast("string")
    b = with_page_figures(blocks.join(avg_font_size.select("doc_id", F.col("avg_font_size").alias("_avg")), "doc_id"))  # rows dealt by document serve the pages' windows too
    s = signals(F.col("_avg"), lab)
    b = b.withColumns({f"_s_{k}": v for k, v in s.items()})
    score = F.lit(0.0)
    for k, (usual, same) in WEIGHTS.items():
        score = score + F.col(f"_s_{k}") * F.when(F.col("_same"), same).otherwise(usual)
    t, font = X.strip(F.col("text")), F.col("_s_font_deviation")
    depth = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\.\s", 1)
    dots = F.length(depth) - F.length(F.replace(depth, F.lit("."), F.lit("")))
    by_font = F.when(depth != "", F.least(2 + dots, F.lit(6))).when(font >= 0.8, 2).when(font >= 0.5, 3).when(font >= 0.25, 4).when(F.coalesce(lab.isin("Title", "title"), F.lit(False)), 1).otherwise(2)
    # the sum is rounded so that its order of addition can't decide at the threshold
    b = b.withColumn("score", F.round(score, 9))
    heading = (t != "") & (F.col("score") >= THRESHOLD)
    out = b.withColumns({"block_type": F.when(heading, "heading").otherwise("text"), "heading_level": F.when(heading, _first(t, LEVELS, by_font)).otherwise(0).cast("int")})
    return out.drop("_std", "_same", "_median", "_before", "_avg", *(f"_s_{k}" for k in s))


def ocr_headings(blocks: DataFrame, titles: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Headings among recognised blocks (font size 0); blocks with a size are returned unchanged. ``titles``: layout boxes."""
    b = with_page_figures(blocks)
    box = titles.where("label = 'Title'").select("doc_id", "page_num", *(F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = b.select("doc_id", "page_num", "seq", "x0", "y0", "x1", "y1").join(box, ["doc_id", "page_num"]).where(G.iou(G.box(), G.box("l_")) >= cfg.layout_iou).select("doc_id", "page_num", "seq").distinct().withColumn("_title", F.lit(1.0))
    t = X.strip(F.col("text"))
    n, level = F.length(t), _first(t, OCR_LEVELS)
    place = F.when(n == 0, 0.0).otherwise(F.when(n < 30, 0.5).when(n < 50, 0.25).otherwise(0.0) + F.when((F.col("height") > 0) & (F.col("y0") < F.col("height") * 0.3), 0.5).otherwise(0.0))
    height = F.when(F.col("_median") <= 0, 0.0).otherwise(_ratio_signal((F.col("y1") - F.col("y0")) / F.col("_median")))
    score = F.coalesce(F.col("_title"), F.lit(0.0)) * OCR_WEIGHTS["title"] + height * OCR_WEIGHTS["height"] + level.isNotNull().cast("double") * OCR_WEIGHTS["pattern"] + place * OCR_WEIGHTS["position"]
    out = b.join(hit, ["doc_id", "page_num", "seq"], "left").withColumn("ocr_score", F.round(score, 9))
    heading = (F.col("size") == 0) & (F.col("ocr_score") > OCR_THRESHOLD)
    return out.withColumns({"block_type": F.when(heading, "heading").otherwise(F.col("block_type")), "heading_level": F.when(heading, F.coalesce(level, F.lit(2))).otherwise(F.col("heading_level")).cast("int")}).drop("_std", "_same", "_median", "_before", "_title")


# Domain profiles: (pattern, type, level), tried in this order. Fixed values.
_KR = "[가나다라마바사아자차카타파하]"
LEGAL_FIRST = (
    (r"^제\s*\d+\s*편\b", "heading", 1), (r"^제\s*\d+\s*장\b", "heading", 2), (r"^제\s*\d+\s*절\b", "heading", 3), (r"^제\s*\d+\s*관\b", "heading", 3),
    (r"^제\s*\d+조(?:의\d+)?(?:\s*[\(（].*?[\)）])?\s", "heading", 4), (r"^제\s*\d+조(?:의\d+)?(?:\s*[\(（].*?[\)）])?\s*$", "heading", 4),
    ("^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]", "clause", 0), (rf"^{_KR}\)", "item", 0), (r"^[ⅰ-ⅹ]\)", "item", 0),
)
LEGAL_DECIMAL = r"^\d+\.\d+(?:\.\d+)?\s+"
LEGAL_DEPTH = ((r"^\d+\.\d+\.\d+\s+", 3), (r"^\d+\.\d+\s+", 1), (rf"^{_KR}\.\s+", 2), (r"^\(\d+\)\s*", 2))
LEGAL_PREFIX = rf"^(\d+\.\d+(?:\.\d+)?\s|\d+\.\s|{_KR}\.\s|\(\d+\)\s)"
LEGAL_LAST = ((r"^\d+\.\s+", "subclause", 0), (rf"^{_KR}\.\s+", "subclause", 0))
LEGAL_MARKS = "0-9(제가나다라마바사아자차카타파하①-⑳ⅰ-ⅹ"
ACADEMIC_FIRST = (
    (r"(?i)^part\s+[ivxlcdm\d]+\b", "heading", 1), (r"(?i)^chapter\s+\d+\b", "heading", 1), (r"(?i)^section\s+\d+\b", "heading", 2), (r"^\d+\.\d+\.\d+\s+\S", "heading", 4), (r"^\d+\.\d+\s+\S", "heading", 3), (r"^\d+\.\s+\S", "heading", 2),
    (r"(?i)^figure\s+\d+", "item", 0), (r"(?i)^table\s+\d+", "item", 0), (r"^[\-\*•]\s+", "item", 0), (r"(?i)^\([a-z]\)\s+", "item", 0), (r"(?i)^[a-z]\)\s+", "item", 0),
)


def _pair(kind: str, level) -> Column:
    return F.struct(F.lit(kind).alias("block_type"), (level if isinstance(level, Column) else F.lit(level)).cast("int").alias("heading_level"))


def korean_legal(text: Column, size: Column, bold: Column, avg: Column, cfg: Config = DEFAULT) -> Column:
    """struct(block_type, heading_level) by the rules for Korean legal texts."""
    t = X.strip(text)
    out = F.when(t == "", _pair("text", 0))
    for p, kind, level in LEGAL_FIRST:
        out = out.when(t.rlike(p), _pair(kind, level))
    head = F.regexp_extract(t, r"^(\S+)", 1)
    out = out.when(t.rlike(LEGAL_DECIMAL) & (F.length(t) <= 80), _pair("heading", F.least(3 + F.length(head) - F.length(F.replace(head, F.lit("."), F.lit(""))), F.lit(6))))
    base = F.when((avg > 0) & (size > avg * cfg.heading_bold_ratio) & bold, 2).when((avg > 0) & (size > avg * cfg.heading_size_ratio), 3)
    for p, depth in LEGAL_DEPTH:
        out = out.when(base.isNotNull() & t.rlike(p), _pair("heading", F.least(base + depth, F.lit(6))))
    out = out.when(base.isNotNull() & t.rlike(LEGAL_PREFIX), _pair("heading", base)).when(base.isNotNull() & bold & (F.length(t) <= 80), _pair("heading", base))
    for p, kind, level in LEGAL_LAST:
        out = out.when(t.rlike(p), _pair(kind, level))
    return out.otherwise(_pair("text", 0))


def legal_type(text: Column, size: Column, bold: Column, avg: Column, cfg: Config = DEFAULT) -> Column:
    """The block type of ``korean_legal`` alone, as a smaller expression."""
    t = X.strip(text)
    large = (avg > 0) & (((size > avg * cfg.heading_bold_ratio) & bold) | (size > avg * cfg.heading_size_ratio))
    # every pattern needs a mark at the start
    out = F.when(t == "", "text").when(~X.first_in(t, LEGAL_MARKS), F.when(large & bold & (F.length(t) <= 80), "heading").otherwise("text"))
    for p, kind, _ in LEGAL_FIRST:
        out = out.when(t.rlike(p), kind)
    out = out.when(t.rlike(LEGAL_DECIMAL) & (F.length(t) <= 80), "heading")
    out = out.when(large & (X.matches(t, (*(p for p, _ in LEGAL_DEPTH), LEGAL_PREFIX)) | (bold & (F.length(t) <= 80))), "heading")
    for p, kind, _ in LEGAL_LAST:
        out = out.when(t.rlike(p), kind)
    return out.otherwise("text")


def english_academic(text: Column, size: Column, bold: Column, avg: Column, cfg: Config = DEFAULT) -> Column:
    """struct(block_type, heading_level) by the rules for academic texts."""
    t = X.strip(text)
    out = F.when(t == "", _pair("text", 0))
    for p, kind, level in ACADEMIC_FIRST:
        out = out.when(t.rlike(p), _pair(kind, level))
    return out.when((avg > 0) & (size > avg * cfg.heading_bold_ratio) & bold & (F.length(t) <= 120), _pair("heading", 2)).when((avg > 0) & (size > avg * cfg.heading_size_ratio), _pair("heading", 3)).otherwise(_pair("text", 0))


PROFILES = {"korean_legal": korean_legal, "english_academic": english_academic}


def profile(name: str):
    """A profile by name; unknown names give the legal one."""
    return PROFILES.get(name, korean_legal)
