"""Hierarchy of headings, merging of lines into paragraphs, broken lines, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.config import DEFAULT, Config
from . import classify

# Word lists of the merge rules.
POSTPOSITIONS = "은 는 이 가 을 를 에 의 로 와 과 도 만 까지 부터 에서".split()
CONJUNCTIONS = "그러나 다만 또한 및 또는 그리고 따라서 아울러".split()
SUFFIXES = "의 에 를 을 한 된 는 로".split()
STRUCTURE_START = r"^(#{1,6}\s|제\s*\d+\s*[편장절관조]|[①-⑩]\s*|\d+\.\d+(?:\.\d+)?\s+|\d+\.\s+|[가-하]\.\s+|-\s+|[●○•◦]\s*|\||>|---|$)"
STRUCTURE_MARKS = "#0-9제가-하①-⑩●○•◦|>-"  # what that begins with, if a line isn't empty
OPEN, CLOSE = r"(（\[「『【", r")）\]」』】"  # texts are compared stripped
SENTENCE_END = ".。?!」)）】"


def block_id(text: Column, page: Column, x0: Column, y0: Column) -> Column:
    return F.substring(F.md5(F.format_string("%s|%d|%.1f|%.1f", text, page, x0, y0)), 1, 12)


def hierarchy(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_num"), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Adds block_id and parent_id: the nearest heading before of a smaller level, for text the nearest heading.

    What a stack would give, as six running values: the last heading of each level.
    """
    level = F.when(F.col("block_type") == "heading", F.when(F.col("heading_level") > 0, F.col("heading_level")).otherwise(1))
    b = blocks.withColumns({"block_id": block_id(F.col("text"), F.col("page_num"), F.col("x0"), F.col("y0")), "_level": level, "_at": F.row_number().over(Window.partitionBy(*keys).orderBy(*order))})
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("_level") == k, F.struct("_at", "block_id")), ignorenulls=True).over(before) for k in range(1, 7)}
    b = b.withColumns({f"_p{k}": v for k, v in last.items()})
    # an earlier heading counts only if no heading of a smaller or equal level came between: the latest of the smaller levels is that one
    none = F.lit(None).cast("struct<_at:int,block_id:string>")
    parent = F.greatest(none, *(F.when(F.col("_level").isNull() | (F.col("_level") > k), F.col(f"_p{k}")) for k in range(1, 7)))
    return b.withColumn("parent_id", parent["block_id"]).drop("_level", "_at", *(f"_p{k}" for k in range(1, 7)))


def promoted(blocks: DataFrame) -> DataFrame:
    """Where a document has no heading, short numbered subclauses become headings of level 3."""
    none = ~F.coalesce(F.bool_or(F.col("block_type") == "heading").over(Window.partitionBy("doc_id")), F.lit(False))
    t = X.strip(F.col("text"))
    up = none & (F.col("block_type") == "subclause") & t.rlike(r"^\d{1,2}\.\s+\S") & (F.length(t) <= 80)
    b = blocks.withColumn("_up", up)
    return b.withColumns({"block_type": F.when(F.col("_up"), "heading").otherwise(F.col("block_type")), "heading_level": F.when(F.col("_up"), 3).otherwise(F.col("heading_level")).cast("int")}).drop("_up")


def _starts(c: Column, words: list[str]) -> Column:
    return F.when(X.first_in(c, "".join(w[0] for w in words)), c.rlike("^(?:" + "|".join(words) + ")")).otherwise(False)


def splits(avg_gap: Column, cfg: Config = DEFAULT) -> Column:
    """Whether a block starts a new paragraph after the one before it (columns with the prefix p_), by ordered rules.

    ``_mine`` and ``_its`` are the two blocks' types by the legal profile.
    """
    c = F.col
    cur, prev = X.strip(c("text")), X.strip(c("p_text"))
    height, gap = c("p_y1") - c("p_y0"), c("y0") - c("p_y1")
    mine, its = c("_mine"), c("_its")
    same_font = (F.abs(c("size") - c("p_size")) < 0.5) & (c("is_bold") == c("p_is_bold"))
    indent = F.abs(c("x0") - c("p_x0"))
    goes_on = same_font & ((avg_gap <= 0) | (gap <= avg_gap * cfg.line_gap_multiplier)) & (indent <= cfg.indent_tolerance) & ((mine == "text")) & (F.length(prev) <= 40)
    return (
        F.when((cur == "") | (prev == ""), True)
        .when((height > 0) & (gap >= height * cfg.line_height_split_factor), True)
        .when(X.last_in(prev, OPEN), False).when(X.first_in(cur, CLOSE), False)
        .when(X.last_in(prev, ",–—-"), False)
        .when(its == "heading", ~goes_on)
        .when(mine.isin("heading", "clause", "subclause", "item"), True)
        .when((avg_gap > 0) & (gap > avg_gap * cfg.line_gap_multiplier), True)
        .when(indent > cfg.indent_tolerance, True)
        .when((F.abs(c("size") - c("p_size")) > 1.0) | (c("is_bold") != c("p_is_bold")), True)
        .when(_starts(cur, POSTPOSITIONS) | _starts(cur, CONJUNCTIONS), False)
        .when(F.when(X.last_in(prev, "0-9원"), prev.rlike(r"(?:\d[\d,.]+\s*원|\d{4}[./-]\d{1,2}[./-]\d{1,2})\s*$")).otherwise(False), False)
        .when(~X.last_in(prev, ".。?!:;"), False)
        .when(X.last_in(prev, "".join(SUFFIXES)), False)
        .when(same_font, False).otherwise(True)
    )


def separator(prev: Column, cur: Column, crosses: Column | None = None) -> Column:
    """What stands between two joined lines."""
    open_ = X.last_in(prev, OPEN) | X.first_in(cur, CLOSE)
    korean = X.last_in(prev, "가-힣") & X.first_in(cur, "가-힣")
    out = F.when(open_, "")
    if crosses is not None:
        out = out.when(crosses, " ")
    return out.when(korean, "").otherwise(" ")


def merged_lines(blocks: DataFrame, font_stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Paragraphs: consecutive blocks of a page that no rule separates, as doc_id, page_num, seq (of the first), text, box, font, type."""
    w = Window.partitionBy("doc_id", "page_num").orderBy("seq")
    b = blocks.join(font_stats.select("doc_id", F.col("avg_font_size").alias("_avg"), F.col("avg_line_gap").alias("_gap")), "doc_id")
    b = b.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("text", "x0", "y0", "y1", "size", "is_bold")})
    # the type of a block is worked out once, and its successor takes it from there
    b = b.withColumn("_mine", classify.legal_type(F.col("text"), F.col("size"), F.col("is_bold"), F.col("_avg"), cfg))
    b = b.withColumn("_its", F.lag("_mine").over(w))
    b = b.withColumn("_split", F.col("p_text").isNull() | splits(F.col("_gap"), cfg))
    t = X.strip(F.col("text"))
    b = b.withColumns({"_island": F.sum(F.col("_split").cast("int")).over(w), "_piece": F.when(F.col("_split"), t).otherwise(F.concat(separator(X.strip(F.col("p_text")), t), t))})
    first = lambda c: F.min_by(c, "seq").alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_piece"))), lambda x: x["_piece"]), "")
    out = b.groupBy("doc_id", "page_num", "_island").agg(
        text.alias("text"), first("x0"), first("y0"), F.greatest(F.min_by("x1", "seq"), F.max_by("x1", "seq")).alias("x1"), F.max_by("y1", "seq").alias("y1"),
        first("size"), first("is_bold"), first("block_type"), first("heading_level"), first("width"), first("height"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_lines"),
    )
    return out.where("text <> ''").drop("_island").withColumn("confidence", F.lit(1.0))


def merged_broken_lines(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Joins a line that ends in mid-sentence with the next, pair by pair, in lines (keys, line_no, line).

    A line can take the next if neither begins a structure; in a run of such lines every other one does.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    s = X.strip(F.col("line"))
    last = F.substring(s, -1, 1)
    b = lines.withColumn("_s", s)
    # each line is looked at once, and the one before it takes from there whether it begins a structure
    b = b.withColumn("_starts", F.when(F.col("_s") == "", True).when(X.first_in(F.col("_s"), STRUCTURE_MARKS), F.col("_s").rlike(STRUCTURE_START)).otherwise(False))
    b = b.withColumns({"_next": F.lead("_s").over(w), "_next_starts": F.lead("_starts").over(w)})
    can = F.coalesce(~F.col("_starts") & ~last.isin(*SENTENCE_END) & ~F.col("_next_starts"), F.lit(False))
    b = b.withColumn("_can", can)
    b = b.withColumn("_at", F.row_number().over(w))
    before = F.max(F.when(~F.col("_can"), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("_takes", F.col("_can") & ((F.col("_at") - F.coalesce(before, F.lit(0))) % 2 == 1))
    b = b.withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    korean = X.last_in(F.col("_s"), "가-힣") & X.first_in(F.col("_next"), "가-힣")
    # the indent is measured against the stripped length
    indent = F.substring("line", F.lit(1), F.length("line") - F.length("_s"))
    text = F.when(F.col("_takes"), F.concat(indent, F.col("_s"), F.when(korean, "").otherwise(" "), F.col("_next"))).otherwise(F.col("line"))
    return b.where(~F.col("_taken")).withColumn("line", text).select(*keys, "line_no", "line")
