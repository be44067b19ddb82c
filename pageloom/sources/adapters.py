"""Positioned blocks, pages, layout boxes, tables and events made from the flat test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT, SLOTS = 595.0, 880.0, 10


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table with fewer splits than there are cores anew; tables of many files stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(documents: DataFrame) -> DataFrame:
    """Blocks: one row for each line of a document that isn't blank, ten slots a page; every fifth document has two columns."""
    d = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).where(F.col("text").rlike(r"\S"))
    slot, short, left = F.col("seq") % SLOTS, F.length("text") <= 30, F.col("seq") % 2 == 0
    two = F.col("doc_id") % 5 == 0
    y0 = (20 + 85 * slot).cast("double")
    return d.select(
        "doc_id", (F.floor(F.col("seq") / SLOTS) + 1).cast("int").alias("page_num"), "seq", "text",
        F.when(two & ~left, 320.0).otherwise(50.0).alias("x0"), y0.alias("y0"),
        F.when(two & left, 280.0).otherwise(545.0).alias("x1"), (y0 + F.when(short, 96.0).otherwise(80.0)).alias("y1"),
        F.when(short, 14.0).otherwise(10.0).alias("size"), short.alias("is_bold"),
        F.when(F.col("doc_id") % 3 == 0, (40 + F.col("seq") % 60) / 100.0).otherwise(1.0).alias("confidence"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
    )


def pages(blocks: DataFrame) -> DataFrame:
    """One row a page: its text, and made-up image figures that depend on doc_id."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return blocks.groupBy("doc_id", "page_num").agg(text.alias("raw_text"), F.count(F.lit(1)).alias("n_blocks")).withColumns(
        {"width": F.lit(WIDTH), "height": F.lit(HEIGHT), "image_ratio": (F.col("doc_id") % 10) / 20.0, "has_images": F.col("doc_id") % 10 > 0, "image_count": (F.col("doc_id") % 6).cast("int")}
    )


def layout_boxes(blocks: DataFrame) -> DataFrame:
    """A labelled box around every fourth line of a page."""
    slot = F.col("seq") % SLOTS
    labels = F.array(*map(F.lit, ("Title", "Text", "Caption", "Page-Footer", "List")))
    return blocks.where(slot % 4 == 0).select(
        "doc_id", "page_num", slot.cast("int").alias("ord"), F.element_at(labels, (F.floor(F.col("seq") / 4) % 5 + 1).cast("int")).alias("label"), ((50 + 2 * (F.col("seq") % 20)) / 100.0).alias("confidence"),
        (F.col("x0") - 2).alias("x0"), (F.col("y0") - 1).alias("y0"), (F.col("x1") + 3).alias("x1"), (F.col("y1") + 2).alias("y1"),
    )


def images(blocks: DataFrame) -> DataFrame:
    """A flat image below the sixth line of a page."""
    y = 20 + 85 * (F.col("seq") % SLOTS)
    return blocks.where(F.col("seq") % SLOTS == 5).select("doc_id", "page_num", F.lit(100.0).alias("x0"), (y + 82).cast("double").alias("y0"), F.lit(300.0).alias("x1"), (y + 84).cast("double").alias("y1"))


def cells(lineitem: DataFrame) -> DataFrame:
    """Table cells: an order is a table with a header row and a row for each line item."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = lineitem.withColumn("row", F.row_number().over(w)).select(
        F.col("l_orderkey").alias("table_id"), "row",
        F.array(F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.col("l_partkey").cast("string")), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"), F.floor("l_extendedprice").cast("long").cast("string")).alias("c"),
    )
    # the header comes with an order's first row, so that all stays dealt by order
    head, own = F.struct(F.lit(0).alias("row"), F.array(*map(F.lit, ("part", "qty", "flag", "price"))).alias("c")), F.struct("row", "c")
    rows = rows.select("table_id", F.explode(F.when(F.col("row") == 1, F.array(head, own)).otherwise(F.array(own))).alias("r"))
    return rows.select("table_id", "r.row", F.posexplode("r.c").alias("col", "text"))


def tables(grid: DataFrame, orders: DataFrame) -> DataFrame:
    """The tables of cells: size, and a place on a page of the customer's document that depends on the order's number."""
    size = grid.groupBy("table_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = orders.select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").cast("long").alias("doc_id"), F.dense_rank().over(w).alias("page_num"), (F.col("o_orderkey") % 3).alias("k"))
    y0 = F.when(F.col("k") == 0, 600.0).when(F.col("k") == 1, 20.0).otherwise(300.0)
    return size.join(o, "table_id").select("table_id", "doc_id", "page_num", "rows", "cols", F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(545.0).alias("x1"), (y0 + 200).alias("y1"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), (F.col("k") == 2).alias("needs_review"))


def task_events(events: DataFrame) -> DataFrame:
    """Progress events: a user is a task, the kind of event its progress, the number in its properties the page."""
    kind = F.create_map(*[F.lit(x) for x in ("click", "page_progress", "view", "page_result", "signup", "stage", "purchase", "done", "error", "error")])
    return events.select(
        F.col("user_id").alias("task_id"), "event_id", "ts", F.element_at(kind, F.col("event_type")).alias("event"), F.get_json_object("props", "$.k").cast("int").alias("page"), "value",
    )


def conversation_blocks(conversations: DataFrame) -> DataFrame:
    """A conversation is a document, a turn a page with one block; what the user says is a heading."""
    user = F.col("role") == "user"
    return conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_num"), F.col("turn").cast("int").alias("seq"), "text", F.when(user, "heading").otherwise("text").alias("block_type"), F.when(user, 1).otherwise(0).alias("heading_level"))
