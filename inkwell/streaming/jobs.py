"""Extraction jobs as event tables and streams."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed

THROTTLE_MS = 150


def stage_table(spark) -> DataFrame:
    """The stages of a job, in order, with their progress; a last one ends it at 100."""
    rows = [(i, name, progress) for i, (name, progress) in enumerate(fixed.JOB_STAGES)]
    return spark.createDataFrame([*rows, (len(rows), "done", 100)], "stage int, node string, progress int")


def progress_events(jobs: DataFrame, spark) -> DataFrame:
    """An event for each job (job_id, needs_review) and stage; review only where it's needed."""
    # Seven rows, whatever the input.
    all_stages = F.broadcast(stage_table(spark))
    return jobs.join(all_stages, F.col("needs_review") | (F.col("node") != "flag_review")).select("job_id", "stage", "node", "progress")


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """R2: the latest row of each key, by a maximum summed before the shuffle; also for a streaming frame in complete mode."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(key).agg(newest.alias("x"), F.count("*").alias("n_events")).select(key, "x.*", "n_events")


def throttled(times: Column, gap_ms: int = THROTTLE_MS) -> Column:
    """Of a sorted array of times in milliseconds, those that are reported: the first, and each more than gap_ms after the one before it."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(times, start, lambda out, t: F.when((F.size(out) == 0) | (t - F.coalesce(F.try_element_at(out, F.lit(-1)), t) > gap_ms), F.concat(out, F.array(t))).otherwise(out))


def timed_out(started: Column, now: Column, terminal: Column, limit_s: int = 30) -> Column:
    """Whether a job that hasn't ended has run beyond its limit."""
    return ~terminal & (F.unix_millis(now) - F.unix_millis(started) > 1000 * limit_s)


def windowed_progress(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by window and type, for batch and stream; late rows are waited for up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def reported(events: DataFrame, key: str, time_ms: str, gap_ms: int = THROTTLE_MS) -> DataFrame:
    """R6 for keys of any number of events: (key, n), the events that are reported.

    Each key's times pass by in order, and a task holds no more than the last that was reported.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, n = None, 0, 0
        for b in batches:
            keys, counts = [], []
            for k, t in zip(b["key"].to_pylist(), b["t"].to_pylist(), strict=True):
                if (k,) != now:
                    if now is not None:
                        keys.append(now[0])
                        counts.append(n)
                    now, last, n = (k,), t, 1
                elif t - last > gap_ms:
                    last, n = t, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("key").type), pa.array(counts, pa.int64())], ["key", "n"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], b.schema.field("key").type), pa.array([n], pa.int64())], ["key", "n"])

    given = events.select(F.col(key).alias("key"), F.col(time_ms).alias("t")).where("t is not null")
    kind = given.schema["key"].dataType.simpleString()
    return given.repartition("key").sortWithinPartitions("key", "t").mapInArrow(run, f"key {kind}, n bigint").withColumnRenamed("key", key)


def status_of(wanted: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Wanted with ``status`` and ``code``; a job that isn't there is JOB_NOT_FOUND, one that hasn't ended PROCESSING."""
    found = wanted.join(jobs.select(key, F.col("status").alias("_status")), key, "left")
    ended = F.col("_status").isin("completed", "needs_review")
    code = F.when(F.col("_status").isNull(), "JOB_NOT_FOUND").when(ended, "SUCCESS").when(F.col("_status") == "failed", "SCAN_FAILED").otherwise("PROCESSING")
    return found.withColumns({"status": F.coalesce("_status", F.lit("failed")), "code": code}).drop("_status")


def cancelled(status: Column) -> Column:
    """The status after a request to cancel; only a job that is being processed can be."""
    return F.when(status == "processing", F.lit("cancelled")).otherwise(status)


def job_id(*columns: str) -> Column:
    """An id that depends on what identifies a job, so that a task that runs again gives the same one."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def quota(spark) -> DataFrame:
    """One row, without a limit."""
    return spark.createDataFrame([(999_999, True)], "remaining int, unlimited boolean")


def listen(stream: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str, **options):
    """A running query that hands each batch to every handler; one that fails is logged and doesn't stop the others."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for handler in handlers:
            try:
                handler(batch, number)
            except Exception:  # noqa: BLE001  a listener must not end the stream
                logging.getLogger(__name__).exception("a listener failed on batch %s", number)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    for name, value in options.items():
        writer = writer.trigger(**{name: value})
    return writer.start()


def poll(status: Callable[[], str], every_s: float = 1.5, limit_s: float = 30.0, pause: Callable[[float], None] = time.sleep) -> str:
    """The status that ends a job; a failed one raises RuntimeError, and none within the limit TimeoutError."""
    began = time.monotonic()
    while True:
        now = status()
        if now == "failed":
            raise RuntimeError("the job failed")
        if now in ("completed", "needs_review", "cancelled"):
            return now
        if time.monotonic() - began >= limit_s:
            raise TimeoutError(f"no end within {limit_s} s")
        pause(every_s)
