"""Structured Streaming: windows over events, ingest and embedding as files arrive. An extension of ours; the batch plans are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodespark.operators import chunks, models
from lodespark.operators.store import content_hash

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, collection string, path string, title string, modified_at timestamp"


def windowed_counts(events: DataFrame, every: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type, of a stream or a table; in a stream, events later than ``late`` are dropped."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, which end after a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", "w.start", "w.end", "n", "total")


def distinct_content(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """Each text once by its hash, as it arrives; the state keeps hashes within the watermark."""
    rows = documents.filter("text is not null").withColumn("hash", content_hash(F.col("text")))
    if rows.isStreaming:
        return rows.withWatermark("modified_at", late).dropDuplicatesWithinWatermark(["hash"])
    return rows.dropDuplicates(["hash"])


def embed_stream(spark: SparkSession, source: str, target: str, checkpoint: str, encoder: models.Encoder, files_per_trigger: int = 16) -> StreamingQuery:
    """Embeds documents as parquet files arrive in ``source``; ``target`` gets chunks with vectors, and those that failed with their error.

    The checkpoint makes a restart go on with the next file; each micro-batch is committed as a whole by the file sink.
    """
    rows = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    texts = rows.filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    parts = chunks.chunk_documents(texts, "id", "text").withColumn("title", F.lit(""))
    done = models.encode_chunks(parts, encoder).withColumn("space_id", F.lit(encoder.descriptor.space_id))
    return done.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
