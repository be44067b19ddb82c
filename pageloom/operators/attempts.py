"""Choosing among several readings of the same page, block or image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of acceptance.
REPROCESS_BELOW, LLM_BELOW, LLM_MARGIN, CHAR_LOSS = 0.5, 0.7, 0.05, 0.8
GATE_MARGIN, GATE_LOSS, GATE_GAIN = 0.02, 0.8, 1.2


def best(attempts: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_num")) -> DataFrame:
    """The attempt of highest overall confidence, the earliest on ties; null counts as worst."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("overall", F.lit(-1.0))), "attempt")
    return attempts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def to_reprocess(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce(F.col("overall") < REPROCESS_BELOW, F.lit(False)))


def to_correct(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce(F.col("overall") < LLM_BELOW, F.lit(False)))


def correction_verdict(old_chars: Column, new_chars: Column, old_conf: Column, new_conf: Column, error: Column) -> Column:
    """Why a correction is taken or not."""
    return F.when(error.isNotNull(), "error").when(new_chars < old_chars * CHAR_LOSS, "char_loss").when(new_conf <= old_conf + LLM_MARGIN, "no_gain").otherwise("accepted")


def preprocessing_verdict(old_chars: Column, new_chars: Column, old_conf: Column, new_conf: Column) -> Column:
    """struct(use_preprocessed, reason) of a comparison of the image as it was and after preprocessing."""
    out = lambda use, why: F.struct(F.lit(use).alias("use_preprocessed"), F.lit(why).alias("reason"))
    return (
        F.when((old_chars == 0) & (new_chars > 0), out(True, "rescued_empty")).when(new_chars < old_chars * GATE_LOSS, out(False, "char_loss"))
        .when(new_conf > old_conf + GATE_MARGIN, out(True, "confidence")).when((new_chars > old_chars * GATE_GAIN) & (new_conf >= old_conf), out(True, "char_gain")).otherwise(out(False, "original"))
    )


def replaced(blocks: DataFrame, retries: DataFrame) -> DataFrame:
    """Blocks with the first retry (doc_id, page_num, seq, attempt, text, score) that scores strictly better."""
    keys = ["doc_id", "page_num", "seq"]
    j = retries.select(*keys, "attempt", F.col("text").alias("_text"), F.col("score").alias("_score")).join(blocks.select(*keys, "block_score"), keys).where(F.col("_score") > F.col("block_score"))
    first = j.groupBy(*keys).agg(F.min_by(F.struct("_text", "_score"), "attempt").alias("_r"))
    b = blocks.join(first, keys, "left")
    return b.withColumns({"text": F.coalesce("_r._text", "text"), "block_score": F.coalesce("_r._score", "block_score")}).drop("_r")


LOW_CONFIDENCE, REREAD_CONFIDENCE = 0.6, 0.85


def reread(blocks: DataFrame, crops: DataFrame, build, below: float = LOW_CONFIDENCE) -> DataFrame:
    """Recognised blocks with those of low confidence read again by a describer from their crops (doc_id, page_num, seq, data).

    A text that comes back replaces the old one at a fixed confidence; ``part`` puts the others first, then these.
    """
    from ..ports import described

    keys = ["doc_id", "page_num", "seq"]
    low = F.coalesce(F.col("confidence") < below, F.lit(True))
    images = blocks.where(low).select(*keys, F.col("text").alias("caption")).join(crops, keys).withColumn("img", F.xxhash64(*keys))
    got = described(images, build).select(*keys, F.trim("alt_text").alias("_new"))
    b = blocks.withColumn("part", low.cast("int")).join(got, keys, "left")
    new = F.coalesce(F.col("_new"), F.lit("")) != ""
    return b.withColumns({"text": F.when(new, F.col("_new")).otherwise(F.col("text")), "confidence": F.when(new, REREAD_CONFIDENCE).otherwise(F.col("confidence"))}).drop("_new")


def reread_tables(tables: DataFrame, cells: DataFrame, score: DataFrame, crops: DataFrame, build, below: float = 0.45) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, cells and a record of what was tried: tables of low score (table_id, score) read again from their crops (table_id, data).

    What the describer writes is taken if it holds a Markdown table; else the table stays.
    """
    from ..ports import described
    from .tables import from_markdown, low_scored

    low = low_scored(tables, score, below).where("low").select("table_id", "score")
    images = low.join(crops, "table_id").select(F.col("table_id").alias("img"), "data", F.lit("table").alias("caption"))
    read = described(images, build).select(F.col("img").alias("id"), F.coalesce("alt_text", F.lit("")).alias("text"))
    new = from_markdown(read).select(F.col("id").alias("table_id"), "row", "col", "text")
    size = new.groupBy("table_id").agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    out = tables.join(size, "table_id", "left").withColumns({"rows": F.coalesce("_rows", "rows").cast("int"), "cols": F.coalesce("_cols", "cols").cast("int")}).select(*tables.columns)
    if "source" in tables.columns:
        out = out.join(size.select("table_id", F.lit("vlm").alias("_s")), "table_id", "left").withColumn("source", F.coalesce("_s", "source")).drop("_s").select(*tables.columns)
    kept = cells.join(size.select("table_id"), "table_id", "left_anti").select("table_id", "row", "col", "text")
    record = low.join(read.withColumnRenamed("id", "table_id"), "table_id", "left").join(size.select("table_id", F.lit(True).alias("replaced")), "table_id", "left")
    return out, kept.unionByName(new), record.select("table_id", "score", F.length("text").alias("n_chars"), F.coalesce("replaced", F.lit(False)).alias("replaced"))


def retried(pages: DataFrame, hints: tuple[dict, ...], run) -> DataFrame:
    """Pages (doc_id, page_num, overall, ...) with those of low confidence done again, once for each of ``hints`` while they stay low.

    ``run(keys, hint)`` gives the pages of keys (doc_id, page_num) anew, with the same columns. A fixed number of rounds over
    ever fewer pages; the best attempt stays.
    """
    keys, every, rest = ["doc_id", "page_num"], pages.withColumn("attempt", F.lit(0)), to_reprocess(pages)
    for i, hint in enumerate(hints, 1):
        again = run(rest.select(*keys), hint).select(*pages.columns)
        every = every.unionByName(again.withColumn("attempt", F.lit(i)))
        rest = to_reprocess(again)
    return best(every).drop("attempt")
