"""Structured Streaming: upkeep of text postings, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brindle.operators.text import TextIndex


def maintain_postings(docs: DataFrame, key: str, text: str, folder: str, tokens: Callable[[Column], Column] | None = None) -> DataStreamWriter:
    """Write each batch of new documents as postings and lengths of its own (batch=<n>).

    A batch that is repeated after a failure overwrites its own folder, so a document is
    counted once. ``open_postings`` reads what is there.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        index = TextIndex.build(batch, key, text, tokens)
        index.postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        index.lengths.write.mode("overwrite").parquet(f"{folder}/lengths/batch={number}")

    return docs.writeStream.foreachBatch(upsert)


def open_postings(spark, folder: str, key: str, tokens: Callable[[Column], Column] | None = None) -> TextIndex:
    from brindle.functions.analyzer import native_analyzer

    postings, lengths = (spark.read.parquet(f"{folder}/{t}").drop("batch") for t in ("postings", "lengths"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return TextIndex(postings, lengths, terms, key, tokens or native_analyzer())


def windowed_events(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and event type; rows later than the watermark are passed over."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time zone
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    out = kept.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
