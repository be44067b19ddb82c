"""Long-running work: an inbox that is parsed as files come, job groups that can be cancelled, a breaker for failing services."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def intake(spark: SparkSession, inbox: str, results: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], per_batch: int = 16, every: str | None = None) -> StreamingQuery:
    """Parses the files of an inbox once each, ``per_batch`` at a time, into folders of results by batch number.

    The source's progress takes the place of claiming a job: a batch that fails is done again, over the same files and into
    the same folder. ``every`` (as "500 milliseconds") keeps the query waiting for files; without it the query ends with them.
    ``parse`` gets path and content and has to turn failures into rows. Files without a byte are passed over.
    """

    def put(batch: DataFrame, number: int) -> None:
        parse(batch.select("path", "content")).write.mode("overwrite").parquet(f"{results}/batch={number}")

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(inbox)
    w = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def collected(spark: SparkSession, results: str, schema: str) -> DataFrame:
    """The results of an inbox so far, each file's from its latest batch."""
    rows = spark.read.schema(schema + ", batch int").parquet(results)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"], "left_semi").drop("batch")


def progress(query: StreamingQuery) -> dict:
    """Depth and speed of an inbox's query, for a status page."""
    last = query.lastProgress
    rows = last["numInputRows"] if last else 0
    return {"active": query.isActive, "batch": last["batchId"] if last else -1, "files": rows, "error": str(query.exception()) if query.exception() else None}


def in_group(spark: SparkSession, group: str, work: Callable[[], DataFrame]) -> DataFrame:
    """Runs work whose Spark jobs carry a group's name, so that ``cancel`` can end them."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


class Breaker:
    """Whether a service may be called: its last probe counts for a while; after some failures in a row it rests before the next probe."""

    def __init__(self, probe: Callable[[], bool], ttl: float = 5.0, failures: int = 3, rest: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.probe, self.ttl, self.failures, self.rest, self.clock = probe, ttl, failures, rest, clock
        self.known: bool | None = None
        self.at = self.failed = 0.0
        self.count = 0

    def available(self) -> bool:
        now = self.clock()
        if self.count >= self.failures and now - self.failed < self.rest:
            return False
        if self.known is not None and now - self.at < self.ttl and self.count < self.failures:
            return self.known
        try:
            self.known = bool(self.probe())
        except Exception:  # noqa: BLE001  a probe that fails is a service that is down
            self.known = False
        self.at = self.clock()
        if self.known:
            self.count = 0
        else:
            self.count, self.failed = self.count + 1, self.at
        return self.known
