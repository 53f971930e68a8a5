"""Documents of a stream that have not been seen before, and the document frequencies of their chunks.

What has been seen is state of the stream: digests of texts, in RocksDB, so that it lies on the executors' disks and not in their
memory. A text is compared in two steps, first by digest and one of ``SALTS`` parts, then by digest alone: a text that a third of
the rows have goes to many tasks, and the task of its digest sees at most ``SALTS`` copies of it, ever. Copies under one id
and source are in one part.

Each batch counts the tokens of its new chunks into a segment of its own. A batch that is replayed replaces its segment, and the
frequencies are the sums over segments; no document is read again. Null and empty texts are one text without chunks.
Which of several copies stays is whichever came first. Columns other than doc_id, source and text go.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions.text import text_key
from weftline.operators.keyword import add_frequencies, document_frequencies
from weftline.operators.sizing import stored
from weftline.operators.store import ChunkStore
from weftline.streaming.ingest import stream_chunks

SALTS = 32
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unique_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text): one of each text, over the life of the stream; also of a table."""
    keyed = docs.select("doc_id", "source", "text", text_key(F.coalesce("text", F.lit(""))).alias("digest"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("doc_id", "source"), F.lit(SALTS)))
    return keyed.dropDuplicates(["digest", "part"]).dropDuplicates(["digest"]).select("doc_id", "source", "text")


def ingest_unique(docs: DataFrame, segments: str, checkpoint: str, store: ChunkStore | None = None, available_now: bool = True) -> StreamingQuery:
    """Counts the chunks of a stream's new documents into a folder of segments, and appends them to a store if there is one.

    Each stream needs a checkpoint path of its own.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def take(batch: DataFrame, number: int) -> None:
        chunks = stream_chunks(batch)
        if store is not None:
            chunks = stored(chunks, "new-chunks")  # counted and appended, taken from the state once
            store.append(chunks, f"{stream}-{number}")
        document_frequencies(chunks).write.mode("overwrite").parquet(f"{segments}/batch={stream}-{number}")

    spark = docs.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)  # a query keeps the settings with which it starts
    try:
        writer = unique_documents(docs).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def frequencies(spark: SparkSession, segments: str) -> DataFrame:
    """(token, df) over all segments; without any, no rows."""
    try:
        held = spark.read.schema("token string, df long").parquet(segments)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        held = spark.createDataFrame([], "token string, df long")
    return add_frequencies(held.select("token", "df"))
