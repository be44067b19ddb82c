"""Markdown of pages and documents, front matter, and the tree of sections as an edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import text as X
from . import structure

SKIPPED = ("page_footer", "page_number", "page_header")
COVER, TOC = "## [표지]", "## [목차]"  # fixed values


def block_markdown(codecs: bool = True, repaired: Column | None = None) -> Column:
    """A block's lines; null if it shows nothing. ``repaired``: its repaired text, if that is worked out already."""
    t = codec.repair(X.strip(F.col("text")), codecs) if repaired is None else repaired
    kind = F.col("block_type")
    hashes = F.repeat(F.lit("#"), F.least(F.col("heading_level"), F.lit(6)))
    return (
        F.when((t == "") | kind.isin(*SKIPPED), None).when((kind == "heading") & (F.col("heading_level") > 0), F.concat(F.lit("\n"), hashes, F.lit(" "), t, F.lit("\n")))
        .when(kind == "clause", F.concat(F.lit("\n"), t)).when(kind.isin("subclause", "item"), F.concat(F.lit("  "), t)).when(kind == "list", F.concat(F.lit("- "), t)).otherwise(X.bullets(t))
    )


def image_text_kind(text: Column, y0: Column, height: Column) -> Column:
    """Whether a text read from an image is a heading: short, without stop or comma, in the page's top fifth."""
    high = F.coalesce(height, F.lit(0.0)) <= 0
    return F.when((F.length(text) <= 60) & ~text.rlike("[.,]") & (high | (y0 <= 0.2 * height)), "heading").otherwise("body")


def image_lines(folder: str | None = None, ext: Column | None = None, codecs: bool = True) -> Column:
    """An image's lines: the text that was read from it (alt_text), else a link; null if that text can't be repaired."""
    from .results import image_markdown

    read = X.strip(F.col("alt_text"))
    t = codec.repair(read, codecs)
    shown = F.when(t == "", None).when(image_text_kind(t, F.col("y0"), F.col("height")) == "heading", F.concat(F.lit("# "), t)).otherwise(t)
    return F.when(F.coalesce(read, F.lit("")) != "", shown).otherwise(image_markdown(F.col("caption"), F.col("page_num"), F.col("block_id"), folder, ext))


def page_markdown(blocks: DataFrame, tables: DataFrame | None = None, codecs: bool = True, images: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """doc_id, page_num, markdown: blocks, tables (doc_id, page_num, y0, table_id, markdown) and images (doc_id, page_num, y0, height, img, block_id, caption, alt_text) from top to bottom."""
    # a text is repaired once, in a projection of its own; a filter on the rows' Markdown would have it all done twice
    blocks = blocks.withColumn("_repaired", codec.repair(X.strip(F.col("text")), codecs))
    rows = blocks.select("doc_id", "page_num", "y0", F.lit(0).alias("kind"), F.col("seq").cast("long").alias("n"), block_markdown(codecs, F.col("_repaired")).alias("md"))
    if tables is not None:
        rows = rows.unionByName(tables.where("markdown <> ''").select("doc_id", "page_num", "y0", F.lit(1).alias("kind"), F.col("table_id").alias("n"), F.concat(F.lit("\n"), F.col("markdown"), F.lit("\n")).alias("md")))
    if images is not None:
        md = F.concat(F.lit("\n"), image_lines(folder, F.lit("png"), codecs), F.lit("\n"))
        rows = rows.unionByName(images.select("doc_id", "page_num", "y0", F.lit(2).alias("kind"), F.col("img").cast("long").alias("n"), md.alias("md")))
    shown = F.collect_list(F.when(F.col("md").isNotNull(), F.struct("y0", "kind", "n", "md")))
    text = F.array_join(F.transform(F.array_sort("_shown"), lambda x: x["md"]), "\n")
    return rows.groupBy("doc_id", "page_num").agg(shown.alias("_shown")).where(F.size("_shown") > 0).select("doc_id", "page_num", text.alias("markdown"))


def marker_page(blocks: DataFrame, header: str) -> DataFrame:
    """A cover's or table of contents' lines below a mark, from top to bottom."""
    t = X.strip(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", t.alias("t")))), lambda x: F.when(x["t"] != "", x["t"])), "\n")
    return blocks.groupBy("doc_id", "page_num").agg(F.concat(F.lit(header + "\n\n"), text).alias("markdown"))


def post_processed(pages: DataFrame) -> DataFrame:
    """doc_id, markdown: a document's pages (page_num, markdown) with rules between them, spaces and broken lines put right."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "markdown"))), lambda x: x["markdown"]), "\n\n---\n\n")
    d = pages.where(X.strip(F.col("markdown")) != "").groupBy("doc_id").agg(body.alias("t"))
    lines = d.select("doc_id", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    line = F.col("line")
    lines = lines.withColumn("line", F.when(X.has(line, "\xa0\u2002\u2003\u3000"), F.regexp_replace("line", r"[\x{a0}\x{2002}\x{2003}\x{3000}]", " ")).otherwise(line))
    lines = lines.withColumn("line", F.when(X.has(line, ("···",)), F.regexp_replace("line", r"\s*·{3,}\s*", " ")).otherwise(line))
    rest = F.ltrim(line, F.lit(X.WS_CHARS))
    put = F.concat(F.substring(line, F.lit(1), F.length(line) - F.length(rest)), F.regexp_replace(rest, " {2,}", " "))
    lines = structure.merged_broken_lines(lines.withColumn("line", F.when(X.has(line, ("  ",)), put).otherwise(line)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    d = lines.groupBy("doc_id").agg(text.alias("t"))
    t = F.col("t")
    d = d.withColumn("t", F.when(X.has(t, ("\n\n\n\n",)), F.regexp_replace(t, "\n{4,}", "\n\n\n")).otherwise(t))
    ruled = F.regexp_replace(F.regexp_replace(t, "\n*\n---\n\n*", "\n\n---\n\n"), f"(?:\n---\n[{X.WS}]*){{2,}}", "\n\n---\n\n")
    d = d.withColumn("t", F.when(X.has(t, ("\n---\n",)), ruled).otherwise(t))
    return d.select("doc_id", X.strip(F.array_join(F.transform(F.split("t", "\n"), X.rstrip), "\n")).alias("markdown"))


def front_matter(m: DataFrame) -> DataFrame:
    """doc_id, front_matter of metadata rows."""
    quote = lambda k: F.concat(F.lit(f'{k}: "'), F.col(k).cast("string"), F.lit('"'))
    plain = lambda k, name=None: F.concat(F.lit(f"{name or k}: "), F.col(k).cast("string"))
    lines = [F.lit("---"), quote("source"), quote("source_type"), plain("pages"), quote("parsed_at"), quote("engine_version"), plain("ocr_used"), plain("tables_extracted"), plain("tables_need_review"), F.lit("noise_removed:"), *(plain(k, f"  {k}") for k in ("headers", "footers", "page_numbers", "toc_pages")), F.lit("---")]
    return m.select("doc_id", F.concat_ws("\n", *lines).alias("front_matter"))


LEVELS = {"clause": 1, "subclause": 2, "item": 3}


def tree(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, node_id, parent_ord, node_type, level, text: the sections and paragraphs of a document, headings carried over pages.

    parent_ord is the place of the section above, null below the root.
    """
    b = blocks.where(~F.col("block_type").isin(*SKIPPED, "footnote") & (X.strip(F.col("text")) != ""))
    w = Window.partitionBy("doc_id").orderBy("page_num", "seq")
    level = F.when((F.col("block_type") == "heading") & (F.col("heading_level") > 0), F.col("heading_level"))
    for kind, v in LEVELS.items():
        level = F.when(F.col("block_type") == kind, v).otherwise(level)
    b = b.withColumns({"ord": F.row_number().over(w), "level": level})
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({f"_p{k}": F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(before) for k in range(1, 7)})
    parent = F.greatest(F.lit(None).cast("int"), *(F.when(F.col("level").isNull() | (F.col("level") > k), F.col(f"_p{k}")) for k in range(1, 7)))
    node = F.substring(F.md5(F.concat_ws("|", "text", F.lit("0"))), 1, 12)
    return b.select("doc_id", "ord", (F.col("block_id") if "block_id" in b.columns else node).alias("node_id"), parent.alias("parent_ord"), F.when(F.col("level").isNull(), "paragraph").otherwise("section").alias("node_type"), F.col("level").cast("int").alias("level"), X.strip(F.col("text")).alias("text"))


def with_items(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Adds tables, forms and figures to a tree: items (doc_id, item, node_type, section_ord, text), each after all else in its section.

    ``place`` orders the nodes from top to bottom; items without a section come last in the document.
    """
    after = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    ends = F.array(*(F.min(F.when(F.col("level") <= k, F.col("ord"))).over(after) for k in range(1, 7)))
    last = F.max("ord").over(Window.partitionBy("doc_id"))
    n = nodes.withColumns({"_last": last, "_end": F.coalesce(F.element_at(ends, F.least(F.greatest("level", F.lit(1)), F.lit(6))) - 1, last)})
    sections = n.where("node_type = 'section'").select("doc_id", F.col("ord").alias("section_ord"), F.col("_end").alias("_e"), F.col("level").alias("_lv"))
    docs = nodes.groupBy("doc_id").agg(F.max("ord").alias("_last"))
    i = items.join(sections, ["doc_id", "section_ord"], "left").join(docs, "doc_id", "left")
    place = lambda a, b, c, d: F.struct(a.cast("int").alias("at"), b.cast("int").alias("kind"), c.cast("int").alias("up"), d.cast("long").alias("n")).alias("place")
    zero = F.lit(0)
    own = n.select(*nodes.columns, place(F.col("ord"), zero, zero, zero))
    node_id = F.substring(F.md5(F.format_string("%s|%d", "node_type", "item")), 1, 12)
    more = i.select("doc_id", F.lit(None).cast("int").alias("ord"), node_id.alias("node_id"), F.col("section_ord").alias("parent_ord"), "node_type", F.lit(None).cast("int").alias("level"), "text", place(F.coalesce("_e", "_last", zero), F.lit(1), -F.coalesce("_lv", zero), F.col("item")))
    return own.unionByName(more)


def tree_markdown(nodes: DataFrame) -> DataFrame:
    """doc_id, markdown: the tree from top to bottom, which is the order of its blocks."""
    line = F.when(F.col("node_type") == "section", F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.least(F.greatest("level", F.lit(1)), F.lit(6))), F.lit(" "), F.col("text"), F.lit("\n"))).otherwise(F.col("text"))
    line = F.when(F.col("node_type").isin("table", "form", "figure"), F.concat(F.lit("\n"), F.col("text"), F.lit("\n"))).otherwise(line)
    by = "place" if "place" in nodes.columns else "ord"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, line.alias("l")))), lambda x: x["l"]), "\n")
    return nodes.groupBy("doc_id").agg(X.strip(F.regexp_replace(text, "\n{4,}", "\n\n\n")).alias("markdown"))
