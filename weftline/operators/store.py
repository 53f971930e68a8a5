"""The chunk store: one Parquet table with one fixed schema."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.sizing import stored

SCHEMA = (
    "chunk_id long, doc_id string, source string, chunk_index int, total_chunks int, text string, embedding array<float>, "
    "file_path string, language string, type string, name string, class string, line_start int, line_end int, "
    "image_width int, image_height int, image_format string, has_ocr_text boolean"
)


class ChunkStore:
    """Chunks under a path, one folder per append. Loading, statistics and search read the table.

    One writer at a time: an append reads the last id before it writes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        """All chunks; an absent table is empty."""
        return self._batches().drop("batch")

    def _batches(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{SCHEMA}, batch string").parquet(self.path)
        except AnalysisException as absent:
            if "PATH_NOT_FOUND" not in str(absent):
                raise
            return self.spark.createDataFrame([], f"{SCHEMA}, batch string")

    def append(self, chunks: DataFrame, batch: str | None = None) -> None:
        """Adds chunks in the order of doc_id and chunk_index; ids go on from the last one.

        A ``batch`` (letters, digits, - and _) that is appended again replaces what it added before.
        """
        batch = batch or uuid.uuid4().hex
        last = self._batches().where(F.col("batch") != batch).agg(F.coalesce(F.max("chunk_id"), F.lit(-1))).first()[0]
        conform(numbered(chunks, last + 1)).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def clear(self) -> None:
        """Empties the table."""
        self.spark.createDataFrame([], f"{SCHEMA}, batch string").write.mode("overwrite").partitionBy("batch").parquet(self.path)

    def stats(self) -> DataFrame:
        """One row: total_chunks, embedding_dim."""
        return store_stats(self.load())


def numbered(chunks: DataFrame, first: int, order: Sequence[str] = ("doc_id", "chunk_index"), name: str = "chunk_id", again: bool = False) -> DataFrame:
    """``chunks`` with gapless numbers from ``first`` in a column ``name``, in the order of doc_id, chunk_index or other columns.

    Rows are ranged and sorted, numbered inside each range, and moved by the counts of the ranges before, so that no
    task sees all rows. The chunks are written before they are ranged, so that the sampling of the ranges reads two columns
    and makes no chunk again; with ``again``, for chunks that are cheaper to make twice than to write, they are not. The
    ranges are written too, so that both passes see the same ones. Columns named
    __part, __i or __before are refused.
    """
    if taken := {"__part", "__i", "__before"} & set(chunks.columns):
        raise ValueError(f"columns are named {sorted(taken)}")
    ranged = (chunks if again else stored(chunks, "chunks")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)), "ranges")
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__i") + F.col("__before") + first).drop("__part", "__i", "__before")


def conform(chunks: DataFrame) -> DataFrame:
    """``chunks`` in the fixed schema; columns that they lack are null, other columns go."""
    wanted = chunks.sparkSession.createDataFrame([], SCHEMA).schema
    return chunks.select(*((F.col(f.name) if f.name in chunks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def store_stats(chunks: DataFrame) -> DataFrame:
    """One row: total_chunks, embedding_dim (0 without embeddings)."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("embedding_dim"))


def operation_stats(events: DataFrame, op: str, duration: str, memory: str | None = None) -> DataFrame:
    """Per operation: count, average, total, least and greatest duration, average change of memory."""
    measures = [
        F.count("*").alias("count"),
        F.round(F.avg(duration), 6).alias("avg_duration"),
        F.round(F.sum(duration), 6).alias("total_duration"),
        F.min(duration).alias("min_duration"),
        F.max(duration).alias("max_duration"),
    ]
    return events.groupBy(op).agg(*measures, *([F.round(F.avg(memory), 6).alias("avg_memory_delta")] if memory else []))
