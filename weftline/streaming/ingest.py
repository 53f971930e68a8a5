"""Documents that arrive as files, chunked and appended as they come."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.chunking import explode_chunks, sentence_windows
from weftline.operators.store import ChunkStore


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id string, source string, text string") -> DataFrame:
    """A stream of the Parquet files that appear under a path."""
    return spark.readStream.schema(schema).parquet(path)


def stream_chunks(docs: DataFrame, size: int = 12, overlap: int = 2) -> DataFrame:
    """Chunks of a stream (or table) of documents; stateless, so no watermark is needed."""
    return explode_chunks(docs, sentence_windows(F.col("text"), size, overlap, clean=True), "doc_id", "source").withColumnRenamed("chunk_text", "text")


def ingest_stream(docs: DataFrame, store: ChunkStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the chunks of a stream to a store, one numbered batch at a time; a batch that is replayed replaces itself.

    Batches are known by the checkpoint's path and their number, so each stream needs a checkpoint path of its own.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    writer = stream_chunks(docs).writeStream.foreachBatch(lambda batch, number: store.append(batch, f"{stream}-{number}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
