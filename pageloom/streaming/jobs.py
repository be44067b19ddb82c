"""A job table: job_id, status, mime, content_hash, attempts, created_at, updated_at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "processing", "done", "failed")
ACTIVE = ("queued", "processing")


def counts(jobs: DataFrame) -> DataFrame:
    """Jobs of each status, those without any included."""
    spark: SparkSession = jobs.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(jobs.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def active_by_content(jobs: DataFrame) -> DataFrame:
    """The newest job under way for each content and type."""
    w = Window.partitionBy("content_hash", "mime").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.where(F.col("status").isin(*ACTIVE)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def admitted(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs without those whose content is under way already or comes twice among them; finished jobs don't count."""
    w = Window.partitionBy("content_hash", "mime").orderBy("created_at", "job_id")
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(jobs.where(F.col("status").isin(*ACTIVE)).select("content_hash", "mime").distinct(), ["content_hash", "mime"], "left_anti")


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart: what was being processed waits again."""
    return jobs.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def finished(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Applies outcomes (job_id, ok, at): done, or failed with one attempt more."""
    j = jobs.join(outcomes.select("job_id", "ok", "at"), "job_id", "left")
    return j.withColumns({"status": F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "done").otherwise("failed"), "attempts": F.col("attempts") + F.when(F.coalesce(~F.col("ok"), F.lit(False)), 1).otherwise(0), "updated_at": F.coalesce("at", "updated_at")}).select(*jobs.columns)


def expired(jobs: DataFrame, now, ttl_seconds: int = 3600) -> DataFrame:
    """Finished jobs older than a time to live."""
    return jobs.where(F.col("status").isin("done", "failed") & (F.col("updated_at") < now - F.expr(f"INTERVAL {ttl_seconds} SECONDS")))


def listed(jobs: DataFrame, active: bool = False) -> DataFrame:
    """Jobs from the newest to the oldest; with ``active`` only those under way."""
    out = jobs.where(F.col("status").isin(*ACTIVE)) if active else jobs
    return out.orderBy(F.desc("created_at"), F.desc("job_id"))


def claimed(jobs: DataFrame, at, n: int = 1) -> DataFrame:
    """Jobs with the ``n`` oldest queued ones taken to be processed, each one attempt more."""
    first = jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(n).select("job_id", F.lit(True).alias("_mine"))
    j = jobs.join(F.broadcast(first), "job_id", "left").withColumn("_mine", F.coalesce("_mine", F.lit(False)))
    return j.withColumns({"status": F.when(F.col("_mine"), "processing").otherwise(F.col("status")), "updated_at": F.when(F.col("_mine"), at).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def inserted(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs and the rows whose ids are new; what was pending elsewhere is queued here."""
    new = rows.join(jobs.select("job_id"), "job_id", "left_anti").select(*jobs.columns)
    return jobs.unionByName(new.withColumn("status", F.when(F.col("status") == "pending", "queued").otherwise(F.col("status"))))


UPDATABLE = ("status", "attempts", "updated_at")


def updated(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs with the columns of changes (job_id and some of ``UPDATABLE``) where these aren't null."""
    cols = [c for c in UPDATABLE if c in changes.columns]
    j = jobs.join(changes.select("job_id", *(F.col(c).alias(f"_{c}") for c in cols)), "job_id", "left")
    return j.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*jobs.columns)


def deleted(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("job_id"), "job_id", "left_anti")


def accepts(jobs: DataFrame, workers: int) -> DataFrame:
    """Whether another job may be queued: one row (depth, limit, accepted, retry_after)."""
    limit = max(8, 2 * workers)
    depth = F.count_if(F.col("status").isin(*ACTIVE))
    return jobs.agg(depth.alias("depth")).select("depth", F.lit(limit).alias("limit"), (F.col("depth") < limit).alias("accepted"), F.when(F.col("depth") >= limit, 5).alias("retry_after"))
