"""Boxes of the same page that cover each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

KEYS = ["doc_id", "page_num"]


def share_of_smaller(a: tuple, b: tuple):
    """The common area as a share of the smaller box; 0 where that is empty."""
    least = F.least(G.area(a), G.area(b))
    return F.when(least > 0, G.intersection(a, b) / least).otherwise(0.0)


def beside(found: DataFrame, known: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows of found (with seq) that no known box covers by more than a share of the smaller one."""
    k = known.select(*KEYS, *(F.col(c).alias(f"k_{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = found.select(*KEYS, "seq", "x0", "y0", "x1", "y1").join(k, KEYS).where(share_of_smaller(G.box(), G.box("k_")) > share).select(*KEYS, "seq").distinct()
    return found.join(hit, [*KEYS, "seq"], "left_anti")


def _overlap(a: Column, b: Column, smaller: bool) -> Column:
    """Of two boxes as structs: the common area over the smaller area or the union; 0 where that is empty."""
    a, b = (tuple(r[c] for c in ("x0", "y0", "x1", "y1")) for r in (a, b))
    return share_of_smaller(a, b) if smaller else G.iou(a, b)


def first_of_overlapping(boxes: DataFrame, order: str, limit: float, smaller: bool = False) -> DataFrame:
    """doc_id, page_num and order of the boxes kept: each, in order, unless it overlaps one kept before by more than the limit.

    Overlap is intersection over union, or the share of the smaller box. What is kept depends on what was kept: a page's boxes
    are folded one by one over those kept so far; a page holds some dozens of boxes.
    """
    box = F.struct(F.col(order).cast("long").alias("n"), "x0", "y0", "x1", "y1")
    pages = boxes.groupBy(*KEYS).agg(F.array_sort(F.collect_list(box)).alias("_boxes"))
    covered = lambda kept, r: F.exists(kept, lambda k: _overlap(r, k, smaller) > limit)
    kept = F.aggregate("_boxes", F.slice("_boxes", 1, 0), lambda kept, r: F.when(covered(kept, r), kept).otherwise(F.concat(kept, F.array(r))))
    return pages.select(*KEYS, F.explode(F.transform(kept, lambda r: r["n"])).alias(order))


def distinct_images(images: DataFrame) -> DataFrame:
    """Images without those that nearly coincide with an earlier one, with an id from place and number."""
    kept = first_of_overlapping(images, "img", 0.9)
    return images.join(kept, [*KEYS, "img"], "left_semi").withColumn("block_id", F.substring(F.md5(F.format_string("img|%d|%d|%.1f|%.1f", F.col("img"), F.col("page_num"), F.col("x0"), F.col("y0"))), 1, 12))


def distinct_tables(tables: DataFrame, hashes: DataFrame) -> DataFrame:
    """Tables of a page without those that overlap an earlier one or have its content (table_id, content_hash)."""
    kept = tables.join(first_of_overlapping(tables, "table_id", 0.8), [*KEYS, "table_id"], "left_semi").join(hashes, "table_id")
    first = kept.groupBy(*KEYS, "content_hash").agg(F.min("table_id").alias("table_id")).select("table_id")
    return tables.join(first, "table_id", "left_semi")
