"""Headers, footers, page numbers and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..plans.config import DEFAULT, Config

NOISE_LABELS = {"Footer": "footer", "Page-Footer": "footer", "Page-Number": "page_number", "Page-Header": "header", "Header": "header"}


def learned(blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """doc_id, kind, pattern, n: normalised lines that repeat in the header, footer or watermark zone of a document's pages."""
    y = G.center_y(G.box())
    n_pages = F.count_distinct("page_num").alias("n_pages")
    edge = F.when(y < F.col("height") * cfg.header_ratio, "header").when(y > F.col("height") * (1 - cfg.footer_ratio), "footer")
    mark = F.when((y > F.col("height") * cfg.watermark_low) & (y < F.col("height") * cfg.watermark_high) & (F.col("size") > cfg.watermark_size), "watermark")
    # only lines in a zone are normalised
    rows = blocks.where(edge.isNotNull() | mark.isNotNull()).select("doc_id", F.explode(F.array_compact(F.array(edge, mark))).alias("kind"), "text").select("doc_id", X.normalized(F.col("text")).alias("pattern"), "kind")
    limit = F.least(F.lit(cfg.min_noise_repeat), F.greatest(F.lit(2), F.floor(F.col("n_pages") / 3)))
    counts = rows.groupBy("doc_id", "kind", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(blocks.groupBy("doc_id").agg(n_pages), "doc_id").where(F.when(F.col("pattern") != "", F.col("n")) >= limit).select("doc_id", "kind", "pattern", "n")


def classified(blocks: DataFrame, patterns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds ``noise``: empty, page_number, header, footer, watermark, or null for content."""
    y = G.center_y(G.box())
    own = patterns.where("pattern <> ''").groupBy("doc_id").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("pattern"))).alias(f"_{k}") for k in ("header", "footer", "watermark")))
    b = blocks.join(own, "doc_id", "left")
    norm = X.normalized(F.col("text"))
    # a line is normalised only in a zone for which its document has patterns
    known = lambda zone, k: zone & F.when(zone & (F.size(f"_{k}") > 0), F.array_contains(f"_{k}", norm)).otherwise(F.lit(False))
    band = (y > F.col("height") * cfg.watermark_low) & (y < F.col("height") * cfg.watermark_high)
    noise = (
        F.when(X.strip(F.col("text")) == "", "empty").when(X.is_page_number(F.col("text")), "page_number")
        .when(known(y < F.col("height") * cfg.header_ratio, "header"), "header")
        .when(known(y > F.col("height") * (1 - cfg.footer_ratio), "footer"), "footer")
        .when(known(band, "watermark"), "watermark")
    )
    return b.withColumn("noise", noise).drop("_header", "_footer", "_watermark")


def with_layout(blocks: DataFrame, boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Replaces ``noise`` of classified blocks where the first overlapping box has a noise label."""
    b = boxes.where(F.col("label").isin(*NOISE_LABELS)).select("doc_id", "page_num", "ord", "label", *(F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")))
    kind = F.create_map(*[F.lit(v) for kv in NOISE_LABELS.items() for v in kv])
    hit = blocks.select("doc_id", "page_num", "seq", "x0", "y0", "x1", "y1").join(b, ["doc_id", "page_num"]).where(G.iou(G.box(), G.box("l_")) >= cfg.layout_iou)
    first = hit.groupBy("doc_id", "page_num", "seq").agg(F.min_by("label", "ord").alias("_label"))
    # by page, so that texts are dealt as the joins with pages deal them
    own = first.groupBy("doc_id", "page_num").agg(F.map_from_entries(F.collect_list(F.struct("seq", "_label"))).alias("_labels"))
    label = F.try_element_at("_labels", F.col("seq"))
    return blocks.join(own, ["doc_id", "page_num"], "left").withColumn("noise", F.coalesce(F.element_at(kind, label), F.col("noise"))).drop("_labels")


def stats(blocks: DataFrame) -> DataFrame:
    """Per document: lines removed of each kind, and lines kept."""
    kinds = ("header", "footer", "page_number", "watermark")
    return blocks.groupBy("doc_id").agg(*(F.count_if(F.col("noise") == k).alias(f"n_{k}") for k in kinds), F.count_if(F.col("noise").isNull()).alias("n_kept"))


def kept(blocks: DataFrame) -> DataFrame:
    return blocks.where("noise IS NULL").drop("noise")
