"""From pages' results to a document's: sums, metadata, sections of tables and images, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOISE = ("header", "footer", "page_number", "watermark")


def aggregated(pages: DataFrame) -> DataFrame:
    """Per document, of rows (doc_id, page_num, is_toc, ocr_used, n_header, n_footer, n_page_number, n_watermark, blocks_retried, avg_block_quality).

    Pages marked is_toc count as such and for nothing else; the mean of qualities is over pages below 1.
    """
    own = ~F.col("is_toc")
    s = lambda c, to: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(to)
    return pages.groupBy("doc_id").agg(
        F.count_if(own).alias("parsed_pages"), F.count_if("is_toc").alias("toc_pages"), *(s(f"n_{k}", f"{k}s") for k in NOISE), F.coalesce(F.bool_or(own & F.col("ocr_used")), F.lit(False)).alias("ocr_used"),
        s("blocks_retried", "blocks_retried"), F.coalesce(F.round(F.round(F.avg(F.when(own & (F.col("avg_block_quality") < 1.0), F.col("avg_block_quality"))), 9), 4), F.lit(1.0)).alias("avg_block_quality"),
    )


def source_type(complexity: Column, ocr_allowed: Column) -> Column:
    return F.when(ocr_allowed & (complexity == "image_heavy"), "scanned_pdf").when(complexity == "mixed", "mixed_pdf").otherwise("digital_pdf")


def metadata(profile: DataFrame, sums: DataFrame, tables: DataFrame, source: Column, parsed_at: Column, ocr_allowed: bool = False, version: str = "1") -> DataFrame:
    """The rows that render.front_matter takes. ``tables``: doc_id, needs_review."""
    t = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables_extracted"), F.count_if("needs_review").alias("tables_need_review"))
    j = profile.select("doc_id", "total_pages", "complexity").join(sums, "doc_id").join(t, "doc_id", "left")
    return j.select(
        "doc_id", source.alias("source"), source_type(F.col("complexity"), F.lit(ocr_allowed)).alias("source_type"), F.col("total_pages").alias("pages"), parsed_at.alias("parsed_at"), F.lit(version).alias("engine_version"), "ocr_used",
        F.coalesce("tables_extracted", F.lit(0)).alias("tables_extracted"), F.coalesce("tables_need_review", F.lit(0)).alias("tables_need_review"), "headers", "footers", "page_numbers", "toc_pages",
    )


def in_sections(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_ord to items (doc_id, item, y0): the section (doc_id, ord, y0) that begins last at or above them, the first on ties; the last section where none does.

    Heights count without their pages, as in one long page.
    """
    nothing = F.lit(None)
    s = sections.select("doc_id", nothing.cast(items.schema["item"].dataType).alias("item"), F.col("y0").cast("double").alias("y0"), F.lit(0).alias("_kind"), F.col("ord").cast("int").alias("ord"))
    i = items.select("doc_id", "item", F.col("y0").cast("double").alias("y0"), F.lit(1).alias("_kind"), nothing.cast("int").alias("ord"))
    down = Window.partitionBy("doc_id").orderBy("y0", "_kind", F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(i).withColumn("section_ord", F.coalesce(F.last("ord", ignorenulls=True).over(down), F.max("ord").over(Window.partitionBy("doc_id"))))
    return items.join(both.where("_kind = 1").select("doc_id", "item", "section_ord").distinct(), ["doc_id", "item"], "left")


def image_markdown(caption: Column, page: Column, block_id: Column, folder: str | None = None, ext: Column | None = None) -> Column:
    alt = F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.format_string("image-%d-%s", page, block_id))
    target = F.format_string(f"{folder.rstrip('/')}/page-%d-img-%s.%s", page, block_id, ext) if folder and ext is not None else F.format_string("placeholder://image/%s?page=%d", block_id, page)
    return F.concat(F.lit("!["), alt, F.lit("]("), target, F.lit(")"))


def report_rows(pages: DataFrame, markdown: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_num, markdown, n_tables, note: pages beside their output, those without any marked as skipped; the input of an HTML report."""
    t = tables.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n_tables"))
    j = pages.select("doc_id", "page_num", "raw_text").join(markdown, ["doc_id", "page_num"], "left").join(t, ["doc_id", "page_num"], "left")
    return j.select("doc_id", "page_num", "raw_text", "markdown", F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.when(F.col("markdown").isNull(), "skipped").alias("note"))


def report_html(rows: DataFrame) -> DataFrame:
    """doc_id, html: source text and output of each page side by side."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.format_string('<section><h2>Page %d</h2><div class="pair"><pre>%s</pre><pre>%s</pre></div><p>%d tables %s</p></section>', F.col("page_num"), esc(F.col("raw_text")), esc(F.col("markdown")), F.col("n_tables"), F.coalesce("note", F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", part.alias("h")))), lambda x: x["h"]), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("<!doctype html><meta charset=utf-8><style>.pair{display:flex}</style>\n"), body).alias("html"))
