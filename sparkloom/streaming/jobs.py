"""Structured Streaming forms of the continuous operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from . import stateful


def usage_totals(stream: DataFrame) -> DataFrame:
    """Running counters by tenant, day and model, for update mode."""
    return stream.groupBy("tenant_id", "day", "model").agg(F.sum("tokens").alias("tokens"))


def flush_usage(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's increments under its own batch id: a batch that runs twice overwrites itself, so the
    sum over batches counts every event once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        totals = batch.groupBy("tenant_id", "day", "model").agg(F.sum("tokens").alias("tokens"))
        totals.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Good and all events by event-time window; rows later than the watermark are dropped."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good")).select("window.start", "event_type", "n", "good")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def _timed(stream: DataFrame, late: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return stream.withColumns({"at": at, "us": F.unix_micros(at)}).withWatermark("at", late)


def token_bucket(stream: DataFrame, rate: float, burst: float, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, allowed): each event takes a token; tokens come back at ``rate`` a second up to ``burst``.

    A row later than the watermark is dropped; one that is late within it takes
    a token, but no token comes back for the time that it is late.
    """
    return stateful.run(_timed(stream, late), "user_id", stateful.TokenBucket(rate, burst), "user_id bigint, event_id bigint, allowed boolean")


def circuit_breaker(stream: DataFrame, failures: int = 3, open_seconds: float = 60.0, late: str = "1 hour") -> DataFrame:
    """(event_type, event_id, state): CLOSED, OPEN after failures in a row, HALF_OPEN once the wait is over."""
    return stateful.run(_timed(stream, late), "event_type", stateful.CircuitBreaker(failures, open_seconds), "event_type string, event_id bigint, state string")


def token_buffer(stream: DataFrame, least: int, wait_ms: int, late: str = "1 hour") -> DataFrame:
    """(user_id, event_ids): events leave in groups of ``least``, or ``wait_ms`` after the first: when the next one comes, or
    when the watermark has passed that time."""
    return stateful.run(_timed(stream, late), "user_id", stateful.TokenBuffer(least, wait_ms), "user_id bigint, event_ids array<bigint>")


def invalidate(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """Cached answers without those whose document, or whole tenant, a batch of events names."""
    left = cache.join(batch.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti")
    return left.join(batch.filter("doc_id IS NULL").select("tenant_id").distinct(), "tenant_id", "left_anti")


Handler = Callable[[DataFrame], DataFrame]


def run_handlers(stream: DataFrame, kind: str, handlers: dict[str, Handler], path: str, checkpoint: str) -> StreamingQuery:
    """The extension point for jobs: each kind's rows of a micro-batch go to its handler; kinds without one are dead letters.

    Results and dead letters are written under the batch's id, so a batch that
    runs twice overwrites itself.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        for name, handle in handlers.items():
            handle(batch.filter(batch[kind] == name)).write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        left = batch.filter(F.coalesce(~batch[kind].isin(*handlers), F.lit(True)))
        left.write.mode("overwrite").parquet(f"{path}/dead/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
