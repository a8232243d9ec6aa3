"""Incremental forms of exact deduplication for arriving documents (an extension; the batch form decides which row is first)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodewright.functions.hashing import normalized_hash


def stream_dedup(docs: DataFrame, *, time_col: str = "ingested_at", delay: str = "7 days", hash_mode: str = "sha2") -> DataFrame:
    """Drop texts seen within ``delay`` of event time; the state holds one hash per text and is bounded by the watermark.

    Rows of a null text count as one text; rows later than the watermark are dropped.
    """
    keyed = docs.withColumn("normalized_hash", F.coalesce(normalized_hash(F.col("text"), hash_mode), F.lit("")))
    return keyed.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["normalized_hash"])


def start(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **kw: str) -> StreamingQuery:
    """Run the deduplication over all data there is, in micro-batches handed to ``sink``."""
    return stream_dedup(docs, **kw).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(docs: DataFrame, *, time_col: str = "ingested_at", width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Documents and characters per source and window of arrival."""
    return docs.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), "source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))
