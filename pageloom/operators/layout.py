"""Joins between text blocks and layout boxes, reading order by columns, captions, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..plans.config import DEFAULT, Config

# Label maps, routing rules, caption pattern.
LABEL_TYPES = {
    "title": ("heading", 1), "section-header": ("heading", 2), "sectionheader": ("heading", 2), "caption": ("caption", 0), "footnote": ("footnote", 0), "formula": ("text", 0), "code": ("text", 0),
    "list-item": ("list", 0), "list": ("list", 0), "page-header": ("page_header", 0), "page-footer": ("page_footer", 0), "page_header": ("page_header", 0), "page_footer": ("page_footer", 0),
}
BOX_TYPES = {
    "Table": "table", "Figure": "figure", "Picture": "figure", "Title": "heading", "Section-header": "heading", "Section-Header": "heading", "SectionHeader": "heading", "Caption": "caption", "Text": "text", "Formula": "text",
    "Equation": "text", "List": "list", "List-item": "list", "Footer": "page_footer", "Page-Footer": "page_footer", "Page-Header": "page_header", "Header": "page_header", "Page-Number": "page_number", "Footnote": "footnote",
}
ROUTES = (  # type, from, below, action, priority
    ("table", 0.8, 1.01, "table_reader", 10), ("table", 0.0, 0.8, "vlm_crop", 10), ("chart", 0.0, 1.01, "vlm_chart", 10), ("figure", 0.0, 1.01, "vlm_caption", 10), ("text", 0.5, 1.01, "markdown", 5), ("heading", 0.0, 1.01, "markdown", 5),
    ("clause", 0.0, 1.01, "markdown", 5), ("subclause", 0.0, 1.01, "markdown", 5), ("item", 0.0, 1.01, "markdown", 5), ("footnote", 0.0, 1.01, "markdown", 5), ("caption", 0.0, 1.01, "markdown", 5), ("list", 0.0, 1.01, "markdown", 5),
    ("page_footer", 0.0, 1.01, "noise_filter", 10), ("page_number", 0.0, 1.01, "noise_filter", 10), ("page_header", 0.0, 1.01, "noise_filter", 10), ("text", 0.0, 0.5, "fallback", 5), ("unknown", 0.0, 1.01, "fallback", 0),
)
CAPTION = r"(?i)[\[<]?(그림|표|Fig|Figure|Table)\s*\d+[>\]]?"
KEYS = ["doc_id", "page_num"]


def _map(d: dict):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def best_box(blocks: DataFrame, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """doc_id, page_num, seq, label, box_confidence, ord, iou: for each block its box of greatest overlap of at least the threshold, the first on ties.

    An equi-join on the page with a residual filter; a page holds some dozens of boxes at most.
    """
    b = boxes.select(*KEYS, "ord", "label", F.col("confidence").alias("box_confidence"), *(F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")))
    j = blocks.select(*KEYS, "seq", "x0", "y0", "x1", "y1").join(b, KEYS).withColumn("iou", G.iou(G.box(), G.box("l_"))).where(F.col("iou") >= cfg.layout_iou)
    top = F.max_by(F.struct("label", "box_confidence", "ord", "iou"), F.struct("iou", -F.col("ord")))
    return j.groupBy(*KEYS, "seq").agg(top.alias("b")).select(*KEYS, "seq", "b.*")


def labelled(blocks: DataFrame, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds label; where the label is known it decides block_type and (unless a heading has one) heading_level."""
    best = best_box(blocks, boxes, cfg).select(*KEYS, "seq", "label")
    norm = F.lower(X.strip(F.col("label")))
    kind = F.element_at(_map({k: v[0] for k, v in LABEL_TYPES.items()}), norm)
    level = F.element_at(_map({k: v[1] for k, v in LABEL_TYPES.items()}), norm)
    keep = (kind == "heading") & (F.col("heading_level") > 0)
    out = blocks.join(best, [*KEYS, "seq"], "left").withColumns({"_kind": kind, "_level": F.when(keep, F.col("heading_level")).otherwise(level)})
    return out.withColumns({"block_type": F.coalesce("_kind", "block_type"), "heading_level": F.coalesce("_level", "heading_level").cast("int")}).drop("_kind", "_level")


def merged(blocks: DataFrame, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Text and layout as one list: matched pairs take the type of the more confident side, boxes without text are added."""
    best = best_box(blocks, boxes, cfg)
    kinds = _map(BOX_TYPES)
    j = blocks.join(best, [*KEYS, "seq"], "left")
    box_type = F.coalesce(F.element_at(kinds, F.col("label")), F.lit("unknown"))
    has = F.col("label").isNotNull()
    text = j.select(*KEYS, "seq", "ord", "text", F.when(has & (F.col("box_confidence") > F.col("confidence")), box_type).otherwise(F.col("block_type")).alias("block_type"), F.greatest("confidence", "box_confidence").alias("confidence"), F.when(has, "text+layout").otherwise("text").alias("source"))
    alone = boxes.join(best.select(*KEYS, "ord").distinct(), [*KEYS, "ord"], "left_anti")
    rest = alone.select(*KEYS, F.lit(None).cast("int").alias("seq"), "ord", F.lit("").alias("text"), box_type.alias("block_type"), "confidence", F.lit("layout").alias("source"))
    return text.unionByName(rest)


def routed(blocks: DataFrame) -> DataFrame:
    """Adds action: what is to be done with a block, by type and confidence; of the rules that fit, the first of the highest priority."""
    out = None
    for kind, lo, hi, action, _ in sorted(ROUTES, key=lambda r: -r[4]):
        rule = (F.col("block_type") == kind) & (F.col("confidence") >= lo) & (F.col("confidence") < hi)
        out = F.when(rule, action) if out is None else out.when(rule, action)
    return blocks.withColumn("action", out.otherwise("fallback"))


def captions(images: DataFrame, blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds caption to images (with an id column img): the nearby block that scores highest, if it touches or looks like a caption."""
    b = blocks.select(*KEYS, "seq", "text", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")), (F.col("label") if "label" in blocks.columns else F.lit(None).cast("string")).alias("label"))
    gap = G.vertical_gap(G.box(), G.box("b_"))
    score = (cfg.caption_proximity - gap) / cfg.caption_proximity + F.when(F.col("text").rlike(CAPTION), 10.0).otherwise(0.0) + F.when(F.coalesce(F.col("label") == "Caption", F.lit(False)), 20.0).otherwise(0.0)
    j = images.join(b, KEYS).where(gap <= cfg.caption_proximity).withColumn("score", score)
    best = j.groupBy(*KEYS, "img").agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("seq"))).alias("m"))
    return images.join(best, [*KEYS, "img"], "left").withColumn("caption", F.when(F.col("m.score") >= 1.0, X.strip(F.col("m.text")))).drop("m")


def outside(blocks: DataFrame, regions: DataFrame, share: float = 0.3) -> DataFrame:
    """Blocks of which at most a share lies in a region (a table, say); blocks without area stay."""
    r = regions.select(*KEYS, *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")))
    i = G.intersection(G.box(), G.box("r_"))
    inside = blocks.select(*KEYS, "seq", "x0", "y0", "x1", "y1").join(r, KEYS).where((i > 0) & (G.area(G.box()) > 0) & (i / G.area(G.box()) > share)).groupBy(*KEYS).agg(F.collect_set("seq").alias("_inside"))
    # by page, so that texts are dealt as the joins with pages deal them
    return blocks.join(inside, KEYS, "left").where(F.col("_inside").isNull() | ~F.coalesce(F.array_contains("_inside", F.col("seq")), F.lit(False))).drop("_inside")


def uncovered(hints: DataFrame, tables: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Hinted boxes that no known table overlaps."""
    t = tables.select(*KEYS, *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = hints.select(*KEYS, "ord", "x0", "y0", "x1", "y1").join(t, KEYS).where(G.iou(G.box(), G.box("t_")) > 0.3).select(*KEYS, "ord").distinct()
    return hints.join(hit, [*KEYS, "ord"], "left_anti")


def columns(blocks: DataFrame, min_gap: float = 0.05, tolerance: float = 2.0, least: int = 3, most: int = 4) -> DataFrame:
    """doc_id, page_num, n_columns, bounds: columns of a page between gaps that no block covers."""
    w = Window.partitionBy(*KEYS).orderBy("x0", "seq")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = blocks.withColumn("_reach", reach).where((F.col("x0") > F.col("_reach") + tolerance) & (F.col("x0") - F.col("_reach") >= F.col("width") * min_gap))
    cut = gaps.groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct(F.col("_reach").alias("a"), F.col("x0").alias("b")))).alias("cuts"))
    page = blocks.groupBy(*KEYS).agg(F.first("width").alias("width"), F.count(F.lit(1)).alias("n"), F.collect_list(G.center_x(G.box())).alias("centers"))
    p = page.join(cut, KEYS, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<a:double,b:double>>")))
    starts = F.concat(F.array(F.lit(0.0)), F.transform("cuts", lambda g: g["b"]))
    ends = F.concat(F.transform("cuts", lambda g: g["a"]), F.array(F.col("width")))
    spans = F.arrays_zip(starts.alias("start"), ends.alias("end"))
    spans = F.filter(spans, lambda s: (s["end"] > s["start"]) & (F.size(F.filter("centers", lambda c: (c >= s["start"]) & (c <= s["end"]))) >= least))
    one = F.array(F.struct(F.lit(0.0).alias("start"), F.col("width").alias("end")))
    p = p.withColumn("_s", spans)
    ok = (F.col("n") >= 2 * least) & (F.size("cuts") > 0) & (F.size("_s") > 1) & (F.size("_s") <= most)
    return p.select(*KEYS, F.when(ok, F.size("_s")).otherwise(1).alias("n_columns"), F.when(ok, F.col("_s")).otherwise(one).alias("bounds"))


def in_column_order(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds column and read_order: by column, then from top to bottom; the old order on pages of one column."""
    j = blocks.join(bounds, KEYS)
    far = F.transform("bounds", lambda s: F.abs(G.center_x(G.box()) - (s["start"] + s["end"]) / 2))
    j = j.withColumn("column", F.when(F.col("n_columns") > 1, F.array_position(far, F.array_min(far)) - 1).otherwise(0).cast("int"))
    many = F.col("n_columns") > 1
    w = Window.partitionBy(*KEYS).orderBy("column", F.when(many, F.col("y0")), F.when(many, F.col("x0")), "seq")
    return j.withColumn("read_order", F.row_number().over(w)).drop("bounds")


def _boxes_of_pages(boxes: DataFrame) -> DataFrame:
    """doc_id, page_num, boxes: a page's layout boxes in order."""
    return boxes.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ord", "x0", "y0", "x1", "y1"))).alias("boxes"))


def layout_orders(blocks: DataFrame, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """doc_id, page_num, has_boxes, seqs: a page's blocks in layout order, as in_layout_order gives them row by row.

    The choice depends on those before it: a page's boxes are folded one by one over the places taken so far; a page is small.
    """
    own = blocks.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1"))).alias("free"))
    at = lambda r: tuple(r[c] for c in ("x0", "y0", "x1", "y1"))

    def taken_by(taken, r):
        shares = F.transform("free", lambda t, i: F.struct(G.iou(at(r), at(t)).alias("share"), (-i).alias("k")))
        fit = F.filter(shares, lambda s: (s["share"] > 0) & (s["share"] >= cfg.layout_iou) & ~F.array_contains(taken, -s["k"]))
        return F.concat(taken, F.transform(F.array_compact(F.array(F.array_max(fit))), lambda s: -s["k"]))

    p = own.join(_boxes_of_pages(boxes), KEYS, "left").withColumn("_taken", F.aggregate("boxes", F.array().cast("array<int>"), taken_by))
    places = F.filter(F.transform("free", lambda t, i: F.struct(t["y0"].alias("y0"), t["x0"].alias("x0"), i.alias("i"))), lambda r: ~F.array_contains("_taken", r["i"]))
    order = F.concat("_taken", F.transform(F.array_sort(places), lambda r: r["i"]))
    seqs = F.when(F.col("boxes").isNull(), F.transform("free", lambda t: t["seq"])).otherwise(F.transform(order, lambda i: F.element_at("free", i + 1)["seq"]))
    return p.select(*KEYS, F.col("boxes").isNotNull().alias("has_boxes"), seqs.alias("seqs"))


def in_layout_order(blocks: DataFrame, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """doc_id, page_num, seq, read_order: each box in turn takes the free block it overlaps most; the others follow from top to bottom."""
    o = layout_orders(blocks, boxes, cfg).select(*KEYS, F.posexplode("seqs").alias("_at", "seq"))
    return o.select(*KEYS, F.col("seq").cast("int").alias("seq"), (F.col("_at") + 1).cast("int").alias("read_order"))


def normalized(boxes: DataFrame) -> DataFrame:
    """Layout boxes in the common form of blocks: an id from page and place, a type from the label."""
    bid = F.substring(F.md5(F.format_string("%d|%.1f|%.1f|%.1f|%.1f", "page_num", "x0", "y0", "x1", "y1")), 1, 12)
    return boxes.select(*KEYS, bid.alias("block_id"), F.coalesce(F.element_at(_map(BOX_TYPES), F.col("label")), F.lit("unknown")).alias("block_type"), "confidence", F.lit("layout").alias("source"), F.col("label").alias("original_label"), "x0", "y0", "x1", "y1")


def needs_detection(pages: DataFrame, every: bool = False) -> DataFrame:
    """Pages (page_type, layout_needed) that a layout model should see; the filter belongs before the model."""
    return pages if every else pages.where(F.col("page_type").isin("scanned", "mixed") | F.col("layout_needed"))
