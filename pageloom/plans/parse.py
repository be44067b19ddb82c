"""The whole plan: documents in, blocks, pages, Markdown, tree, figures and chunks out, all lazy DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ports
from ..functions import text as X
from ..operators import chunks, classify, layout, metrics, noise, overlap, pages, render, results, structure
from ..operators import tables as T
from ..sources import adapters
from .config import DEFAULT, Config


KEYS = ["doc_id", "page_num"]


def as_it_is(df: DataFrame) -> DataFrame:
    return df


def in_few_files(cut: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The same cut for rows without texts, which are dealt anew by size: each file written costs an executor a process."""
    return cut if cut is as_it_is else lambda df: cut(df.hint("rebalance"))


class Parsed(NamedTuple):
    blocks: DataFrame  # paragraphs with type, level, ids and parents
    pages: DataFrame  # page types
    confidence: DataFrame
    noise: DataFrame  # counts of what was removed
    page_markdown: DataFrame
    markdown: DataFrame
    tree: DataFrame
    stats: DataFrame
    anomalies: DataFrame
    tables: DataFrame | None = None  # as they are shown: genuine, once each, continued ones joined
    cells: DataFrame | None = None
    images: DataFrame | None = None  # once each, with captions


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below spark.checkpoint.dir, which driver and executors share, and goes on from there; on one machine, if none is set, to a temporary folder."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pageloom-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    spark._jvm.System.gc()  # Spark then drops the shuffle files of jobs that are done
    return out


def discarded(df: DataFrame) -> None:
    """Deletes what ``checkpointed`` has written for df, whose last reader is done; does nothing to other rows."""
    if path := getattr(df, "_written_to", None):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_recognized(blocks: DataFrame, recognized: DataFrame, kinds: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Blocks of the text layer and of recognition (ports.recognized): the latter alone on scanned pages, on mixed pages with little text where nothing of the layer lies."""
    k = kinds.select(*KEYS, "page_type", "n_chars", "width", "height")
    r = recognized.where("text IS NOT NULL").drop("error").join(k, KEYS).withColumns({"seq": F.col("seq") + 1_000_000, "text": X.ocr_corrected(F.col("text"))})
    layer = blocks.join(k.where("page_type <> 'scanned'").select(*KEYS), KEYS, "left_semi")
    sparse = r.where((F.col("page_type") == "mixed") & (F.col("n_chars") < cfg.garble_text_trust_chars))
    found = r.where("page_type = 'scanned'").unionByName(overlap.beside(sparse, layer))
    return layer.unionByName(found.select(*layer.columns))


def in_reading_order(lines: DataFrame, boxes: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Lines numbered anew in reading order: by layout boxes on pages that have any, else by columns."""
    bounds = layout.columns(lines)
    if boxes is not None:
        bounds = bounds.join(layout.layout_orders(lines, boxes, cfg).where("has_boxes").select(*KEYS, "seqs"), KEYS, "left")
    cols = layout.in_column_order(lines, bounds).drop("column", "n_columns")
    order = F.col("read_order") if boxes is None else F.coalesce(F.nullif(F.array_position("seqs", F.col("seq")), F.lit(0)), F.col("read_order"))
    return cols.withColumn("seq", order.cast("int")).drop("read_order", "seqs")


def paragraphs_of(lines: DataFrame, fonts: DataFrame, boxes: DataFrame | None = None, recognized: bool = False, cfg: Config = DEFAULT, cut: Callable[[DataFrame], DataFrame] = as_it_is) -> DataFrame:
    """Paragraphs by page type: digital lines are classified, then merged; others merged, then classified; covers and tables of contents stay as they are."""

    def labelled(b: DataFrame) -> tuple[DataFrame, str | None]:
        if boxes is None:
            return b, None
        return b.join(layout.best_box(b, boxes, cfg).select(*KEYS, "seq", F.col("label").alias("_label")), [*KEYS, "seq"], "left"), "_label"

    plain = lambda b: b.withColumns({"block_type": F.lit("text"), "heading_level": F.lit(0)})
    b, label = labelled(lines.where("page_type = 'digital'"))
    digital = structure.merged_lines(classify.classified(b, fonts, label), fonts, cfg)
    cols = digital.columns
    b, label = labelled(cut(structure.merged_lines(plain(lines.where("page_type IN ('scanned', 'mixed')")), fonts, cfg).drop("block_type", "heading_level")))
    other = classify.classified(b, fonts, label)
    if recognized:
        titles = boxes if boxes is not None else lines.sparkSession.createDataFrame([], ports.BOXES)
        other = classify.ocr_headings(other, titles, cfg)
    marked = plain(lines.where("page_type IN ('cover', 'toc')")).withColumns({"n_lines": F.lit(1).cast("long"), "confidence": F.lit(1.0)})
    return digital.unionByName(other.select(*cols)).unionByName(marked.select(*cols))


def shown_tables(tables: DataFrame, cells: DataFrame, cfg: Config = DEFAULT, cut: Callable[[DataFrame], DataFrame] = as_it_is) -> tuple[DataFrame, DataFrame]:
    """Tables without frames of layout, rows of a table of contents and copies; one that goes on from the page before is part of that one."""
    few = in_few_files(cut)
    t, c = T.without_leader_rows(T.genuine(tables, cells), cells, few)
    every = few(t), cut(c)
    t = few(overlap.distinct_tables(every[0], T.content_hash(every[1])))
    c = every[1]
    c = c.join(t.select("table_id"), "table_id", "left_semi")
    joins = few(T.across_pages(t, c, cfg))
    c = T.joined_cells(c, joins)
    c = cut(c)
    size = c.groupBy("table_id").agg((F.max("row") + 1).cast("int").alias("_rows"))
    shown = few(t.join(joins.select("table_id"), "table_id", "left_anti").join(size, "table_id").withColumn("rows", F.col("_rows")).drop("_rows"))
    for df in (*every, t, joins):
        discarded(df)
    return shown, c


def shown_images(images: DataFrame, blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Images (doc_id, page_num, img, box, height, optionally alt_text) once each, with an id and a caption."""
    i = layout.captions(overlap.distinct_images(images), blocks, cfg)
    return i if "alt_text" in i.columns else i.withColumn("alt_text", F.lit(None).cast("string"))


def assembled(blocks: DataFrame, kinds: DataFrame | None = None, tables: DataFrame | None = None, cells: DataFrame | None = None, images: DataFrame | None = None, codecs: bool = True, shown: DataFrame | None = None) -> DataFrame:
    """doc_id, page_num, markdown: text outside tables, tables and images from top to bottom; covers and tables of contents below a mark. ``shown``: the tables' Markdown, if it is known."""
    md, rest = None, blocks
    if tables is not None:
        md = tables.select(*KEYS, "y0", "table_id").join((T.markdown(tables, cells) if shown is None else shown).select("table_id", "markdown"), "table_id")
        rest = layout.outside(rest, tables)
    if kinds is None:
        return render.page_markdown(rest, md, codecs, images)
    own = lambda df, *k: df if df is None else df.join(kinds.where(F.col("page_type").isin(*k)).select(*KEYS), KEYS, "left_semi")
    usual = ("digital", "mixed", "scanned")
    out = render.page_markdown(own(rest, *usual), own(md, *usual), codecs, own(images, *usual))
    return out.unionByName(render.marker_page(own(blocks, "cover"), render.COVER)).unionByName(render.marker_page(own(blocks, "toc"), render.TOC))


def with_tables_and_images(tree: DataFrame, sections: DataFrame, tables: DataFrame | None, cells: DataFrame | None, images: DataFrame | None, shown: DataFrame | None = None) -> DataFrame:
    """The tree with tables, forms and figures in the sections (doc_id, ord, y0) that begin last above them."""
    items = None
    if tables is not None:
        forms = T.form_like(tables, cells)
        md = tables.join((T.markdown(tables, cells) if shown is None else shown).select("table_id", "markdown"), "table_id").join(forms, "table_id")
        items = md.select("doc_id", F.col("table_id").cast("long").alias("item"), F.when(F.col("is_form"), "form").otherwise("table").alias("node_type"), F.col("markdown").alias("text"), "y0")
    if images is not None:
        text = F.coalesce(F.nullif(F.trim("alt_text"), F.lit("")), results.image_markdown(F.col("caption"), F.col("page_num"), F.col("block_id")))
        figures = images.select("doc_id", (-1 - F.col("page_num").cast("long") * 100_000 - F.col("img")).alias("item"), F.lit("figure").alias("node_type"), text.alias("text"), "y0")
        items = figures if items is None else items.unionByName(figures)
    return tree if items is None else render.with_items(tree, results.in_sections(items, sections))


def parse_blocks(
    blocks: DataFrame, page_rows: DataFrame, cfg: Config = DEFAULT, *, tables: DataFrame | None = None, cells: DataFrame | None = None,
    images: DataFrame | None = None, boxes: DataFrame | None = None, recognized: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = as_it_is,
) -> Parsed:
    """Parses positioned lines (see sources.adapters.lines for their columns) and pages (see sources.adapters.pages), with what else is known of the pages: tables and their cells, images, layout boxes, recognised blocks.

    All of it is lazy. ``cut`` is given what several outputs share (page types, lines, paragraphs, tables, images, pages' Markdown); with ``checkpointed`` each is worked out once.
    """
    chars = page_rows.withColumn("n_chars", F.length(X.strip(F.col("raw_text"))))
    few = in_few_files(cut)
    kinds = few(pages.typed(chars, blocks, cfg).select(*KEYS, "page_type", "n_chars", "width", "height"))
    source = blocks if recognized is None else with_recognized(blocks, recognized, kinds, cfg)
    marked = noise.classified(source, noise.learned(blocks, cfg), cfg)
    if boxes is not None:
        marked = noise.with_layout(marked, boxes, cfg)
    fonts = few(pages.font_stats(blocks))
    lines = cut(noise.kept(marked).join(kinds.where("page_type <> 'noise'").select(*KEYS, "page_type"), KEYS))
    ordered = cut(in_reading_order(lines, boxes, cfg))
    discarded(lines)
    used = [ordered]
    merged = paragraphs_of(ordered, fonts, boxes, recognized is not None, cfg, lambda df: used.append(cut(df)) or used[-1])
    paragraphs = cut(structure.hierarchy(structure.promoted(merged)))
    for df in used:
        discarded(df)
    table_md = None
    if tables is not None:
        tables, cells = shown_tables(tables, cells, cfg, cut)
        table_md = cut(T.markdown(tables, cells))
    if images is not None:
        images = cut(shown_images(images, paragraphs, cfg))
    page_md = cut(assembled(paragraphs, kinds, tables, cells, images, shown=table_md))
    markdown = render.post_processed(page_md)
    tree = render.tree(paragraphs)
    if tables is not None or images is not None:
        ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "seq"))
        # sections and their heights, numbered as render.tree numbers them
        shown = paragraphs.where(~F.col("block_type").isin(*render.SKIPPED, "footnote") & (X.strip(F.col("text")) != "")).withColumn("ord", ord_)
        sections = shown.select("doc_id", "ord", "y0").join(tree.where("node_type = 'section'").select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")
        tree = with_tables_and_images(tree, sections, tables, cells, images, table_md)
    stats = metrics.parse_stats(paragraphs, markdown)
    return Parsed(paragraphs, kinds.select(*KEYS, "page_type"), metrics.page_confidence(paragraphs, kinds), noise.stats(marked), page_md, markdown, tree, stats, metrics.anomalies(stats), tables, cells, images)


def parse_documents(documents: DataFrame, cfg: Config = DEFAULT) -> Parsed:
    """Parses flat documents (doc_id, text) by the adapter's layout."""
    lines = adapters.lines(documents)
    return parse_blocks(lines, adapters.pages(lines), cfg)


def chunk_document(parsed: Parsed, strategy: str = "by_title", source=None, **options) -> DataFrame:
    return chunks.chunked(parsed.blocks, source if source is not None else F.format_string("doc%d", F.col("doc_id")), strategy, **options)
