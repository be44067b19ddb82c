"""Versions of results, and Markdown with its images for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_version(markdown: DataFrame, path: str, label: str) -> None:
    """Appends rows (task_id, markdown) as a version; versions are told apart by a hash of task, text and label."""
    v = markdown.select("task_id", "markdown", F.lit(label).alias("label"), F.current_timestamp().alias("saved_at")).withColumn("version", F.concat(F.lit("v_"), F.substring(F.md5(F.concat_ws("|", "task_id", "markdown", "label")), 1, 8)))
    v.write.mode("append").partitionBy("label").parquet(path)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a task, the newest first."""
    w = Window.partitionBy("task_id").orderBy(F.desc("saved_at"), "version")
    return spark.read.parquet(path).withColumn("n", F.row_number().over(w))


LINK = r"!\[([^\]]*)\]\(/uploads/[^/)]+/images/([^)]+)\)"


def with_relative_images(markdown: Column) -> Column:
    return F.regexp_replace(markdown, LINK, "![$1](./images/$2)")


def with_inline_images(texts: DataFrame, images: DataFrame) -> DataFrame:
    """texts (task_id, markdown) with the links to known images (task_id, file, data, mime) as data; others stay."""
    found = texts.select("task_id", F.explode(F.array_distinct(F.regexp_extract_all("markdown", F.lit(LINK), F.lit(2)))).alias("file"))
    uri = F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.base64("data"))
    known = found.join(images, ["task_id", "file"]).groupBy("task_id").agg(F.collect_list(F.struct(F.concat(F.lit("/uploads/"), F.col("task_id").cast("string"), F.lit("/images/"), F.col("file")).alias("a"), uri.alias("b"))).alias("m"))
    j = texts.join(known, "task_id", "left")
    done = F.aggregate(F.coalesce("m", F.array().cast("array<struct<a:string,b:string>>")), F.col("markdown"), lambda t, x: F.replace(t, x["a"], x["b"]))
    return j.select("task_id", done.alias("markdown"))
