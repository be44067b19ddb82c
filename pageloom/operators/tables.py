"""Tables as rows (table_id, rows, cols, box, ...) and their cells (table_id, row, col, text[, rowspan, colspan])."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import WS
from ..plans.config import DEFAULT, Config

# Weights of the score by kind of document (filled cells, even rows, cells of some length), patterns.
PRESETS = {"legal": (0.40, 0.35, 0.25), "financial": (0.50, 0.40, 0.10), "academic": (0.30, 0.30, 0.40)}
LEADER = r"\.{3,}|…{2,}"
ENTRY = r"^.{2,50}\s*(?:\.{3,}|…{2,})\s*\d{1,4}\s*$"
DOTS_ONLY = rf"^[{WS}·…]+$"
REVIEW_FAILED, REVIEW = "\n> **Table extraction failed - manual review required**\n", "\n> **Table may have issues - manual review recommended**\n"


def scores(tables: DataFrame, cells: DataFrame, preset: str = "legal") -> DataFrame:
    """table_id, score: 0 for a table without rows or cells."""
    w = PRESETS[preset]
    t = X.strip(F.col("text"))
    by_row = cells.groupBy("table_id", "row").agg(F.count(F.lit(1)).alias("n"), F.count_if(t != "").alias("full"), F.count_if(F.length(t) > 1).alias("long"))
    j = by_row.join(tables.select("table_id", "rows", "cols"), "table_id")
    agg = j.groupBy("table_id").agg(F.sum("n").alias("n"), F.sum("full").alias("full"), F.sum("long").alias("long"), F.count_if(F.col("n") == F.col("cols")).alias("even"), F.first("rows").alias("rows"))
    out = tables.select("table_id").join(agg, "table_id", "left")
    score = F.col("full") / F.col("n") * w[0] + F.col("even") / F.col("rows") * w[1] + F.col("long") / F.col("n") * w[2]
    return out.select("table_id", F.round(F.when((F.col("rows") > 0) & (F.col("n") > 0), score).otherwise(0.0), 6).alias("score"))


def without_leader_rows(tables: DataFrame, cells: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Drops rows that look like entries of a table of contents, numbers the others anew, drops tables with under two rows left.

    A row is an entry if leader dots stand in one of its cells. ``cut`` is given the tables' lists of rows that stay.
    """
    rows = cells.groupBy("table_id", "row").agg(F.bool_or(F.coalesce(F.col("text").rlike(LEADER), F.lit(True))).alias("leader"))
    keep = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.when(~F.col("leader"), F.col("row")))).alias("kept")).where("size(kept) >= 2")
    keep = cut(keep)
    # rows are mostly numbered without gaps, so that a row's place is tried before it is looked for
    place = F.when(F.try_element_at("kept", F.col("row").cast("int") + 1) == F.col("row"), F.col("row").cast("int")).otherwise((F.array_position("kept", F.col("row")) - 1).cast("int"))
    out = cells.join(keep, "table_id").withColumn("_new", place).where("_new >= 0").withColumn("row", F.col("_new")).drop("_new", "kept")
    return tables.join(keep, "table_id").withColumn("rows", F.size("kept")).drop("kept"), out


def figures(cells: DataFrame) -> DataFrame:
    """Per table: numbers of cells and lengths of texts that the rules below look at."""
    n = F.length(X.strip(F.col("text")))
    full = F.when(n > 0, n)
    return cells.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.count(full).alias("full"), F.count_if(n > 80).alias("long"), F.sum(n).alias("chars"), F.avg(full).alias("mean"), F.stddev_pop(full).alias("spread"))


def genuine(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables that aren't frames of a page's layout; those rebuilt from words (source word_grid) always stay."""
    f = tables.join(figures(cells), "table_id", "left")
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))
    n, full, long_ = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "full", "long"))
    dense = (n > 0) & (full / n >= 0.5) & (F.coalesce(F.col("chars"), F.lit(0)) / F.greatest(full, F.lit(1)) < 40)
    bad = (
        (share >= 0.8) | (F.col("cols") >= 10) | ((n > 0) & (F.col("chars") / n < 3) & (F.col("rows") > 2))
        | ((share >= 0.4) & ((long_ >= 2) | ((full > 0) & (long_ / full >= 0.3)))) | ((F.col("cols") == 1) & (F.col("rows") >= 2))
        | ((F.col("cols") >= 6) & (F.col("rows") <= 3) & (share >= 0.25) & ~dense)
    )
    exempt = F.col("source") == "word_grid" if "source" in tables.columns else F.lit(False)
    return f.where(exempt | (F.col("width") * F.col("height") <= 0) | ~F.coalesce(bad, F.lit(False))).select(*tables.columns)


def _is_label(sides: Column) -> Column:
    """Whether a row's cells, stripped, are a short label and a value."""
    a, b = F.try_element_at(sides, F.lit(1)), F.try_element_at(sides, F.lit(2))
    n = F.length(a)
    return F.coalesce((F.size(sides) == 2) & (n >= 2) & (n <= 30) & (F.length(b) > 0) & (a.rlike("[:：]$") | ((n <= 15) & (F.length(b) > n))), F.lit(False))


def _is_form(hits: Column) -> Column:
    return (F.col("cols") == 2) & (F.col("rows") >= 2) & (F.coalesce(hits, F.lit(0)) >= F.col("rows") * 0.6)


def _is_frame(full: Column, long_: Column, spread: Column) -> Column:
    """By the numbers of filled and of long cells, and the spread of their lengths over the mean."""
    total = F.col("rows") * F.col("cols")
    wide = (F.col("cols") >= 5) & (F.col("rows") <= 3)
    return (
        F.when(full == 0, False).when(wide & (full / F.greatest(total, F.lit(1)) >= 0.5) & (long_ == 0), False).when(wide & ((full < total * 0.5) | (long_ >= 1)), True)
        .when((F.col("cols") > 4) | (long_ == 0), False).when((F.col("cols") <= 2) & (long_ >= full * 0.3), True)
        .when((F.col("rows") >= 5) & (spread > 1.0) & (long_ >= 2), True).otherwise(False)
    )


def form_like(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, is_form: two columns, of whose rows most are a short label and a value."""
    sides = F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: X.strip(x["text"]))
    rows = cells.groupBy("table_id", "row").agg(sides.alias("s"))
    got = rows.groupBy("table_id").agg(F.count_if(_is_label(F.col("s"))).alias("hits"))
    return tables.join(got, "table_id", "left").select("table_id", _is_form(F.col("hits")).alias("is_form"))


def layout_like(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, is_layout: a frame around text rather than a table."""
    f = tables.join(figures(cells), "table_id", "left")
    return f.select("table_id", _is_frame(F.coalesce("full", F.lit(0)), F.coalesce("long", F.lit(0)), F.col("spread") / F.col("mean")).alias("is_layout"))


def grid(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, row, texts: each row's cleaned cell texts in full width; merged cells fill their span, later cells win."""
    one = cells.withColumn("text", F.replace(X.clean_cell(F.col("text")), F.lit("|"), F.lit("\\|"))).where("text <> ''")
    if "rowspan" in cells.columns:
        t = one.withColumn("_at", F.struct("row", "col")).withColumn("row", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1))).withColumn("col", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)))
        one = t.groupBy("table_id", "row", "col").agg(F.max_by("text", "_at").alias("text"))
    by_row = one.groupBy("table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    every = tables.where("rows > 0 AND cols > 0").select("table_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    j = every.join(by_row, ["table_id", "row"], "left")
    return j.select("table_id", "row", F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))).alias("texts"))


def _joined(rows: Column, sep: str) -> Column:
    return F.array_join(F.filter(rows, lambda x: x != ""), sep)


def markdown(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, is_junk, markdown: as key and value lines, as paragraphs, as plain text if there is next to nothing in it, or as a table.

    A table's cells are collected once, by row and then by table; every rule is an expression over these lists.
    """
    cells, tables = cells.repartition("table_id"), tables.repartition("table_id")  # both groupings and the join are by table
    c = cells.select("table_id", "row", "col", X.clean_cell(F.col("text")).alias("c"), X.strip(F.col("text")).alias("t"))
    by_row = c.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "c", "t"))).alias("cells"))
    held = by_row.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("r"))
    j = tables.join(held, "table_id", "left")
    if "rowspan" in cells.columns:
        rows = grid(tables, cells).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "texts"))), lambda x: x["texts"]).alias("g"))
        j = j.join(rows, "table_id", "left")
    else:
        whole = (F.size("r") == F.col("rows")) & (F.element_at("r", -1)["row"] == F.col("rows") - 1) & (F.element_at("r", 1)["row"] == 0)
        at = lambda i: F.when(whole, F.try_element_at("r", (i + 1).cast("int"))["cells"]).otherwise(F.try_element_at(F.filter("r", lambda x: x["row"] == i), F.lit(1))["cells"])
        cell = lambda own, k: F.coalesce(F.replace(F.try_element_at(F.filter(own, lambda x: (x["col"] == k) & (x["c"] != "")), F.lit(1))["c"], F.lit("|"), F.lit("\\|")), F.lit(""))
        line_of = lambda own: F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda k: cell(own, k))
        lines = F.transform(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), at), line_of)
        j = j.withColumn("g", F.when((F.col("rows") > 0) & (F.col("cols") > 0), lines))
    junk_cell = lambda x: (x == "") | x.rlike(DOTS_ONLY)
    flat = F.flatten("g")
    content = F.aggregate(F.filter(flat, lambda x: ~junk_cell(x)), F.lit(0), lambda a, x: a + F.length(x))
    junk = (F.size(flat) == 0) | ((content <= 50) & (F.size(F.filter(flat, junk_cell)) / F.size(flat) > 0.75))
    j = j.withColumn("s", F.transform("r", lambda x: F.transform(x["cells"], lambda y: y["c"])))

    def pair(s: Column) -> Column:
        key = X.strip(F.regexp_replace(F.regexp_replace(s[0], ":+$", ""), "：+$", ""))
        return F.when(F.size(s) != 2, _joined(s, " ")).when((key != "") & (s[1] != ""), F.concat(F.lit("**"), key, F.lit("**: "), s[1])).when(key != "", F.concat(F.lit("**"), key, F.lit("**"))).otherwise(s[1])

    j = j.withColumn("lens", F.filter(F.transform(F.flatten(F.transform("r", lambda x: F.transform(x["cells"], lambda y: y["t"]))), F.length), lambda n: n > 0))
    full, long_ = F.greatest(F.size("lens"), F.lit(0)), F.greatest(F.size(F.filter("lens", lambda n: n > 80)), F.lit(0))
    mean = F.aggregate("lens", F.lit(0.0), lambda a, n: a + n) / F.size("lens")
    j = j.withColumns({"mean": mean, "hits": F.size(F.filter("r", lambda x: _is_label(F.transform(x["cells"], lambda y: y["t"]))))})
    spread = F.sqrt(F.aggregate("lens", F.lit(0.0), lambda a, n: a + (n - F.col("mean")) * (n - F.col("mean"))) / F.size("lens")) / F.col("mean")
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    table = F.concat(
        F.array_join(F.concat(F.array(line(F.col("g")[0])), F.array(line(F.array_repeat(F.lit("---"), F.col("cols")))), F.transform(F.slice("g", F.lit(2), F.greatest(F.size("g") - 1, F.lit(0))), line)), "\n"),
        F.when(F.coalesce(F.col("needs_review"), F.lit(False)), REVIEW).otherwise(""),
    )
    plain = _joined(F.transform("g", lambda r: F.array_join(F.filter(r, lambda x: ~junk_cell(x)), " ")), "\n")
    none = F.col("s").isNull() | F.col("g").isNull()
    spared = F.col("source") == "vlm" if "source" in tables.columns else F.lit(False)
    j = j.withColumns({"is_junk": ~none & junk & ~spared, "_form": _is_form(F.col("hits")), "_frame": _is_frame(full, long_, spread)})
    text = (
        F.when(none, F.when(F.col("needs_review"), REVIEW_FAILED).otherwise("")).when(F.col("_form"), _joined(F.transform("s", pair), "\n\n"))
        .when(F.col("_frame"), _joined(F.flatten("s"), "\n\n")).when(F.col("is_junk"), plain).otherwise(table)
    )
    # a filter on the text can't pass an aggregation, which keeps it from being worked out again below; no shuffle is added
    return j.select("table_id", "is_junk", text.alias("markdown")).groupBy("table_id").agg(F.first("is_junk").alias("is_junk"), F.first("markdown").alias("markdown"))


def content_hash(cells: DataFrame) -> DataFrame:
    """table_id, content_hash: equal for tables with the same cell texts, wherever they stand."""
    t = X.strip(F.col("text"))
    return cells.groupBy("table_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.when(t != "", t))), "|")).alias("content_hash"))


def first_of_content(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables without those whose content an earlier one of the same page has."""
    h = tables.join(content_hash(cells), "table_id")
    return h.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page_num", "content_hash").orderBy("table_id"))).where("_n = 1").drop("_n")


def across_pages(tables: DataFrame, cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """table_id, into, row_offset, start_row: the tables that go on one from the page before, and where their rows come to stand.

    A table that was joined to the one before can't take the next one itself, if it is alone on its page:
    in a run of pages with one table each, every other pair is joined.
    """
    page = Window.partitionBy("doc_id", "page_num").orderBy("y0", "table_id")
    t = tables.withColumns({"_i": F.row_number().over(page), "_n": F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page_num"))})
    last = t.where("_i = _n").select("doc_id", "page_num", "_n", *(F.col(c).alias(f"a_{c}") for c in ("table_id", "rows", "cols", "y1", "height")))
    first = t.where("_i = 1").select("doc_id", (F.col("page_num") - 1).alias("page_num"), *(F.col(c).alias(f"b_{c}") for c in ("table_id", "cols", "y0", "height")))
    j = last.join(first, ["doc_id", "page_num"], "left")
    fits = F.coalesce((F.col("a_cols") == F.col("b_cols")) & (F.col("a_y1") >= F.col("a_height") * (1 - cfg.table_bottom_ratio)) & (F.col("b_y0") <= F.col("b_height") * cfg.table_top_ratio), F.lit(False))
    w = Window.partitionBy("doc_id").orderBy("page_num")
    j = j.withColumn("_fits", fits)
    # a run goes on through pages of one table; a page with more starts a new one
    j = j.withColumn("_new", (~F.coalesce(F.lag("_fits").over(w), F.lit(False)) | (F.col("_n") > 1) | (F.lag("page_num").over(w) != F.col("page_num") - 1)).cast("int"))
    j = j.withColumn("_run", F.sum("_new").over(w))
    j = j.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("page_num")))
    m = j.where(F.col("_fits") & (F.col("_k") % 2 == 1)).select(F.col("a_table_id").alias("into"), F.col("b_table_id").alias("table_id"), F.col("a_rows").alias("a_rows"))
    head = cells.where("row = 0").groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: F.lower(X.strip(x["text"]))).alias("h"))
    m = m.join(head.withColumnRenamed("h", "h1"), "table_id", "left").join(head.select(F.col("table_id").alias("into"), F.col("h").alias("h2")), "into", "left")
    start = F.when(F.col("h1") == F.col("h2"), 1).otherwise(0)
    return m.select("table_id", "into", (F.col("a_rows") - start).cast("int").alias("row_offset"), start.alias("start_row"))


def joined_cells(cells: DataFrame, joins: DataFrame) -> DataFrame:
    """Cells with the rows of continued tables moved to the tables they belong to."""
    j = cells.join(joins, "table_id", "left").where(F.col("start_row").isNull() | (F.col("row") >= F.col("start_row")))
    return j.select(F.coalesce("into", "table_id").alias("table_id"), (F.col("row") + F.coalesce("row_offset", F.lit(0))).alias("row"), "col", "text")


def from_markdown(texts: DataFrame) -> DataFrame:
    """id, row, col, text of the Markdown table in each text (id, text): a fenced block of two lines with pipes or else the lines that begin with one."""
    fence = F.regexp_extract("text", r"(?s)```[^\n]*\n(.*?)```", 1)
    piped = lambda c: F.filter(F.transform(F.split(c, "\n"), X.strip), lambda x: x.startswith("|"))
    inside = F.filter(F.transform(F.split(fence, "\n"), X.strip), lambda x: x.contains("|"))
    rows = F.filter(F.when(F.size(inside) >= 2, inside).otherwise(piped(F.col("text"))), lambda x: ~x.rlike(r"^\|?[\s:|-]+\|?$"))
    cells_ = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|"), X.strip))
    t = texts.select("id", cells_.alias("g")).where((F.size("g") >= 2) & (F.size(F.col("g")[0]) >= 2))
    return t.select("id", F.posexplode("g").alias("row", "r")).select("id", "row", F.posexplode("r").alias("col", "text"))


def first_strategy(found: DataFrame, order: tuple[str, ...] = ("lines", "text", "hints", "words")) -> DataFrame:
    """Of tables that several strategies found on a page, those of the first strategy that found any."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    f = found.withColumn("_r", F.when(rank > 0, rank)).where(F.col("_r").isNotNull())
    return f.withColumn("_m", F.min("_r").over(Window.partitionBy("doc_id", "page_num"))).where("_r = _m").drop("_r", "_m")


def usable(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables of at least two rows and columns of which a tenth is filled; under three tenths they need review."""
    f = tables.drop("needs_review").join(figures(cells).select("table_id", (F.col("full") / F.col("n")).alias("_f")), "table_id")
    return f.where((F.col("rows") >= 2) & (F.col("cols") >= 2) & (F.col("_f") >= 0.1)).withColumn("needs_review", F.col("_f") < 0.3).drop("_f")


def tolerance(value: int, dpi: Column, base: int = 72) -> Column:
    """A tolerance for a page's resolution, between 3 and 25."""
    return F.when(dpi.isNull(), value).otherwise(F.greatest(F.lit(3), F.least(F.lit(25), F.bround(value * F.greatest(dpi, F.lit(72)) / base, 0).cast("int"))))


def spans(boxes: DataFrame, near: float = 3.0) -> DataFrame:
    """table_id, row, col, rowspan, colspan of cell boxes (table_id, x0, y0, x1, y1): how many of the table's edges a box passes."""
    edges = boxes.groupBy("table_id").agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("x0"), F.collect_set("x1")))).alias("xs"), F.array_sort(F.array_distinct(F.concat(F.collect_set("y0"), F.collect_set("y1")))).alias("ys"))
    at = lambda e, v: F.array_position(F.transform(e, lambda x: F.abs(x - F.col(v)) <= near), True)
    j = boxes.join(edges, "table_id")
    one = lambda c: F.greatest(F.lit(1), c).cast("int")
    return j.select("table_id", (at("ys", "y0") - 1).cast("int").alias("row"), (at("xs", "x0") - 1).cast("int").alias("col"), one(at("ys", "y1") - at("ys", "y0")).alias("rowspan"), one(at("xs", "x1") - at("xs", "x0")).alias("colspan"))


def from_lines(words: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, page_num, box, rows, cols, strategy) and cells (doc_id, page_num, row, col, text) of pages' ruling lines.

    ``rules``: doc_id, page_num, x0, y0, x1, y1 of straight lines. The upright ones are a page's column edges, the level ones
    its row edges; a word (doc_id, page_num, text, x0, x1, top, bottom) goes to the cell around its centre.
    """
    upright = F.col("x1") - F.col("x0") < F.col("y1") - F.col("y0")
    edge = lambda c, on: F.array_sort(F.collect_set(F.when(on, F.round(c, 0))))
    e = rules.groupBy("doc_id", "page_num").agg(edge("x0", upright).alias("xs"), edge("y0", ~upright).alias("ys")).where("size(xs) >= 3 AND size(ys) >= 3")
    before = lambda es, v: F.size(F.filter(es, lambda x: x <= v)) - 1
    w = words.join(e, ["doc_id", "page_num"]).withColumns({"col": before("xs", (F.col("x0") + F.col("x1")) / 2), "row": before("ys", (F.col("top") + F.col("bottom")) / 2)})
    w = w.where((F.col("col") >= 0) & (F.col("col") < F.size("xs") - 1) & (F.col("row") >= 0) & (F.col("row") < F.size("ys") - 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda x: x["text"]), " ")
    cells = w.groupBy("doc_id", "page_num", "row", "col").agg(text.alias("text"))
    least, most = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, -1))
    found = e.join(cells.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_semi")
    tables = found.select("doc_id", "page_num", least("xs").alias("x0"), least("ys").alias("y0"), most("xs").alias("x1"), most("ys").alias("y1"), (F.size("ys") - 1).alias("rows"), (F.size("xs") - 1).alias("cols"), F.lit("lines").alias("strategy"))
    return tables, cells


def in_hints(words: DataFrame, hints: DataFrame) -> DataFrame:
    """Words whose centre lies in a hinted box (doc_id, page_num, ord, box), with its ord: what is read again box by box."""
    h = hints.select("doc_id", "page_num", "ord", *(F.col(c).alias(f"h_{c}") for c in ("x0", "y0", "x1", "y1")))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return words.join(h, ["doc_id", "page_num"]).where(x.between(F.col("h_x0"), F.col("h_x1")) & y.between(F.col("h_y0"), F.col("h_y1"))).drop("h_x0", "h_y0", "h_x1", "h_y1")


def low_scored(tables: DataFrame, score: DataFrame, below: float = DEFAULT.table_quality) -> DataFrame:
    """Tables with their score and whether it calls for another reading; the tables themselves stay as they are."""
    return tables.join(score, "table_id", "left").withColumn("low", F.coalesce(F.col("score") < below, F.lit(False)))


def estimated(spans: DataFrame) -> DataFrame:
    """doc_id, page_num, n_tables: text blocks (doc_id, page_num, block, line, span) with two lines or more of three spans or more."""
    lines = spans.groupBy("doc_id", "page_num", "block", "line").agg(F.count(F.lit(1)).alias("n"))
    blocks = lines.groupBy("doc_id", "page_num", "block").agg(F.count_if(F.col("n") >= 3).alias("wide"))
    return blocks.groupBy("doc_id", "page_num").agg(F.count_if(F.col("wide") >= 2).alias("n_tables"))
