"""Incremental ingestion: a folder watched by Structured Streaming, each new file replacing its source in the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.api import ingest
from corpusloom.functions.text import plain_lines, source_name
from corpusloom.schema import BOUNDARY
from corpusloom.sources.files import file_type
from corpusloom.sources.store import Store


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of new text and Markdown files, one row each."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    rows = raw.select(path.alias("path"), plain_lines(F.col("value")).alias("content"), F.col("_metadata.file_size").alias("file_size"))
    typed = rows.withColumn("file_type", file_type(F.col("path"))).where(F.col("file_type").isin("text", "markdown"))
    return typed.withColumn("source", source_name(F.col("path"))).withColumn("loader", F.lit(None).cast(f"array<{BOUNDARY}>"))


def start_ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index every new file; a batch that is repeated after a failure replaces the same sources."""

    def save(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest(store, batch)

    writer = stream_documents(spark, folder).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Watermarked tumbling-window counts per kind; works on a stream and on a table alike."""
    counted = events.withWatermark(at, late) if events.isStreaming else events
    out = counted.groupBy(F.window(at, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n")
