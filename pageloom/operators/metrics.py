"""Confidence of pages, figures of documents, anomalies, error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

STRUCTURED = ("heading", "clause", "subclause", "item")


def page_confidence(blocks: DataFrame, types: DataFrame) -> DataFrame:
    """Per page: confidence of recognition, density of text, share of structured blocks, and their weighted sum. ``types``: doc_id, page_num, page_type."""
    digital = F.col("page_type") == "digital"
    b = blocks.join(types.select("doc_id", "page_num", "page_type"), ["doc_id", "page_num"])
    g = b.groupBy("doc_id", "page_num").agg(F.first("page_type").alias("page_type"), F.avg("confidence").alias("conf"), F.sum(F.length("text")).alias("chars"), F.avg(F.col("block_type").isin(*STRUCTURED).cast("double")).alias("share"), F.first("width").alias("width"), F.first("height").alias("height"))
    ocr = F.when(digital, 1.0).otherwise(F.col("conf"))
    density = F.least(F.lit(1.0), F.col("chars") / (F.col("width") * F.col("height")) / 0.006)
    shape = F.least(F.lit(1.0), F.col("share") / 0.2)
    overall = F.when(digital, ocr * 0.2 + density * 0.3 + shape * 0.5).otherwise(ocr * 0.5 + density * 0.2 + shape * 0.3)
    r = lambda c: F.round(F.round(c, 9), 3)  # noqa: E731  the order of addition can't decide a tie
    return g.select("doc_id", "page_num", r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall))).alias("overall"), r(ocr).alias("ocr_confidence"), r(density).alias("text_density"), r(shape).alias("structure_ratio"))


def parse_stats(blocks: DataFrame, markdown: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Per document: pages, blocks, tables, headings of the Markdown, share of empty lines, mean line length."""
    b = blocks.groupBy("doc_id").agg(F.count_distinct("page_num").alias("total_pages"), F.count(F.lit(1)).alias("text_blocks"))
    ls = F.split("markdown", "\n")
    full = F.filter(ls, lambda x: X.strip(x) != "")
    m = markdown.select("doc_id", F.size(F.filter(ls, lambda x: x.rlike(r"^#{1,6}\s"))).cast("long").alias("heading_count"), F.round((F.size(ls) - F.size(full)) / F.size(ls), 3).alias("empty_line_ratio"),
        F.round(F.coalesce(F.aggregate(full, F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(F.size(full), F.lit(0)), F.lit(0.0)), 1).alias("avg_line_length"))
    if tables is None:
        return b.join(m, "doc_id").withColumns({"tables_found": F.lit(0).cast("long"), "tables_need_review": F.lit(0).cast("long")})
    t = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables_found"), F.count_if("needs_review").alias("tables_need_review"))
    return b.join(m, "doc_id").join(t, "doc_id", "left").na.fill(0, ["tables_found", "tables_need_review"])


def anomalies(stats: DataFrame, parsed_pages: Column | None = None) -> DataFrame:
    """doc_id, code, severity."""
    w = lambda cond, code, how: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(how).alias("severity")))
    low = (parsed_pages if parsed_pages is not None else F.col("total_pages")) < F.col("total_pages") * 0.5
    found = F.array_compact(F.array(w(F.col("heading_count") == 0, "NO_HEADINGS", "warning"), w(F.col("empty_line_ratio") > 0.5, "HIGH_EMPTY_RATIO", "warning"), w(F.col("tables_need_review") > 0, "TABLES_NEED_REVIEW", "info"), w(low, "LOW_PARSE_RATE", "warning")))
    return stats.select("doc_id", F.explode(found).alias("a")).select("doc_id", "a.*")


def error_rate(hyp: Column, ref: Column) -> Column:
    """Edit distance of code points as a share of the reference's length, white space made one."""
    one = lambda c: X.strip(F.regexp_replace(c, f"[{X.WS}]+", " "))
    h, r = one(hyp), one(ref)
    return F.when((r == "") & (h == ""), 0.0).when(r == "", 1.0).otherwise(F.levenshtein(h, r) / F.length(r))


def table_f1(hyp: DataFrame, ref: DataFrame) -> DataFrame:
    """Per table_id: precision, recall and F1 of the sets of (row, col, text); 1 where both are empty."""
    norm = lambda d, n: d.select("table_id", "row", "col", F.lower(X.strip(F.regexp_replace("text", f"[{X.WS}]+", " "))).alias("t")).distinct().withColumn(n, F.lit(1))
    j = norm(hyp, "h").join(norm(ref, "r"), ["table_id", "row", "col", "t"], "full").groupBy("table_id").agg(F.count("h").alias("h"), F.count("r").alias("r"), F.count(F.col("h") + F.col("r")).alias("both"))
    p, r = F.coalesce(F.col("both") / F.nullif("h", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("both") / F.nullif("r", F.lit(0)), F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return j.select("table_id", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))
