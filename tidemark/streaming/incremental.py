"""Structured Streaming variants: dedup with a watermark, and micro-batches against a state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import content_key
from tidemark.operators import frontier
from tidemark.sources.writers import load_state, save_state

HISTORY = "url string, hash string, ts timestamp, title string"


def dedup_url(stream: DataFrame, ts: str, url: str = "url", delay: str = "30 days") -> DataFrame:
    """The first of each URL within the watermark; the state of older ones is let go, as expired entries are."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([url])


def dedup_content(stream: DataFrame, ts: str, text: str = "text", delay: str = "30 days") -> DataFrame:
    keyed = stream.withColumn("_key", content_key(F.col(text)))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, ts: str, by: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows by window and value; late rows within the delay count."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"))


def incremental(stream: DataFrame, state_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], days: int = 30, most: int = 10_000, **trigger) -> StreamingQuery:
    """Each micro-batch of ``url, content, ts, title`` gives the sink what is new or changed, then goes into the history.

    The history is a table: entries expire after ``days`` and the oldest go beyond ``most``. A batch that is run again
    gives the sink the same id.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        history = load_state(spark, state_path, HISTORY)
        batch = batch.persist()
        fresh = frontier.content_changed(batch, history).where("changed").select("url").distinct()
        sink(batch.join(fresh, "url", "left_semi"), number)
        visits = batch.select("url", F.md5(F.col("content").cast("binary")).alias("hash"), F.col("ts").cast("timestamp").alias("ts"), "title")
        merged = frontier.mark_visited(history, visits)
        last = merged.agg(F.max("ts").alias("t")).first()["t"]
        kept = frontier.evict_oldest(frontier.expire(merged, last, days) if last else merged, most)
        save_state(kept.select("url", "hash", "ts", "title"), state_path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
