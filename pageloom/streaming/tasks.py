"""Progress events of tasks folded into their state, as a batch and as a stream with the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGE_PERCENT = {"init": 3, "profile": 8, "learn": 15, "assemble": 85, "verify": 95, "done": 100}
PAGES_FROM, PAGES_TO = 15, 85


def percent(page: Column, total: Column) -> Column:
    """Progress while pages are read; 50 where their number isn't known."""
    return F.when(total > 0, PAGES_FROM + F.floor(page / total * (PAGES_TO - PAGES_FROM))).otherwise(50).cast("int")


def parsed_line(c: Column) -> Column:
    """struct(event, page, total) of a log line: "[k/7] stage" or "[page] i/n"."""
    page = F.regexp_extract(c, r"\[page\]\s*(\d+)\s*/\s*(\d+)", 1)
    return F.struct(F.when(page != "", "page_progress").when(c.rlike(r"\[\d/7\]"), "stage").alias("event"), page.try_cast("int").alias("page"), F.regexp_extract(c, r"\[page\]\s*(\d+)\s*/\s*(\d+)", 2).try_cast("int").alias("total"))


def _state(events: DataFrame, total: int) -> list[Column]:
    """Order doesn't matter: counts go up only, and the latest terminal event decides."""
    at = F.struct("ts", "event_id")
    final = F.max_by("event", F.when(F.col("event").isin("done", "error"), at))
    return [
        F.max(F.when(F.col("event") == "page_progress", F.col("page"))).alias("completed_pages"), F.count_if(F.col("event") == "page_result").alias("n_results"),
        F.max(F.when(F.col("event").isin("done", "error"), F.col("ts"))).alias("finished_at"), final.alias("_final"), F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"), F.max_by("event", at).alias("last_event"),
    ]


def _finish(agg: DataFrame, total: int) -> DataFrame:
    done = F.coalesce(F.col("completed_pages"), F.lit(0))
    status = F.when(F.col("finished_at").isNull(), "running").otherwise(F.col("_final"))
    return agg.select("task_id", status.alias("status"), done.alias("completed_pages"), F.when(status == "done", 100).otherwise(percent(done, F.lit(total))).alias("pct"), "n_results", "n_events", "last_event", "last_ts")


def state(events: DataFrame, total: int = 100) -> DataFrame:
    """Per task: status, pages, percent, results, last event. ``events`` may be a stream; then this is an aggregation with state."""
    return _finish(events.groupBy("task_id").agg(*_state(events, total)), total)


def streamed_state(events: DataFrame, path: str, checkpoint: str, total: int = 100) -> DataFrame:
    """Runs the fold over a stream of events to its present end.

    A batch writes the tasks it changes, and only those, to a folder with its number, so that writing it again after a
    failure changes nothing; a task's state is the one of its latest batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = state(events, total).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_state(events.sparkSession.read.parquet(path))


def latest_state(parts: DataFrame) -> DataFrame:
    """One row a task, of rows with the number of their batch."""
    cols = [c for c in parts.columns if c not in ("task_id", "batch")]
    return parts.groupBy("task_id").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("task_id", "s.*")


def snapshot(parts: DataFrame, task_id) -> DataFrame:
    """The latest state of one task: what a client that comes back is sent first."""
    return latest_state(parts.where(F.col("task_id") == task_id))


def sessions(events: DataFrame, idle: str = "10 minutes", beat_seconds: int = 30) -> DataFrame:
    """task_id, start, end, n_events, n_beats: a task's events up to a pause of ``idle``, and how many heartbeats fill its silence. Batch or stream (with a watermark)."""
    s = events.groupBy("task_id", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last"))
    beats = F.floor((F.unix_timestamp("w.end") - F.unix_timestamp("last")) / beat_seconds)
    return s.select("task_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", beats.cast("long").alias("n_beats"))


def history(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a list of finished and running tasks shows: job, status, percent, results, times; the newest first."""
    j = jobs.select(F.col("job_id").alias("task_id"), "mime", "created_at", "updated_at").join(states.select("task_id", "status", "pct", "n_results", "last_event"), "task_id", "left")
    return j.withColumn("status", F.coalesce("status", F.lit("queued"))).orderBy(F.desc("created_at"), F.desc("task_id"))


def transitions(states: DataFrame) -> DataFrame:
    """Rows (name, ts, up) where the state of a service changes, the first row included."""
    from pyspark.sql import Window

    before = F.lag("up").over(Window.partitionBy("name").orderBy("ts"))
    return states.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("up"))).drop("_b")


def queue_status(jobs: DataFrame, workers: int) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "processing").alias("running"), F.count_if(F.col("status") == "queued").alias("queued"), F.lit(workers).alias("workers"))
