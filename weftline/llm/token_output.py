"""Token ids as ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are ranged and sorted by id, encoded in the task that holds the range, and written as one file per range. The
stripes of a file are read in parallel; a read of one document or of a range of ids skips files and stripes by their
minima and maxima and row groups by their Bloom filters. Global offsets are derived from the files alone: a running sum
inside each file, and the sum of the files before it (one row per file).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.encode import encoder, vocabulary
from weftline.llm.shared import documents, fresh_path, written

END_ID = 0
ROW_INDEX_STRIDE = 1000


def write_ids(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes doc_id, ordinal (place in the file) and ids (with ``end_id`` appended) in ascending order of doc_id.

    Null and empty texts are their end id alone; rows without an id come first; repeated ids are repeated rows. An empty
    table writes no rows. Other columns are not read.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ordinal long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ordinal = encoder(vocabulary_path), 0
        for batch in batches:
            at = 0
            for ids, ends in encode.arrays(batch.column(1)):
                n = len(ends)
                values = np.insert(ids, ends, end_id).view("<i4")
                offsets = np.append(0, ends + np.arange(1, n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.arange(ordinal, ordinal + n)), lists], names=["doc_id", "ordinal", "ids"])
                at, ordinal = at + n, ordinal + n

    ranged = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        ranged.mapInArrow(run, schema)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents: doc_id, ordinal, ids. Filters on doc_id are pushed to stripes and row groups."""
    return spark.read.orc(path)


def document_table(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    stored = read_ids(spark, path).select("doc_id", "ordinal", "ids", F.col("_metadata.file_path").alias("file"))
    schema = f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, ordinal long, file string, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            bounds = ids.offsets.to_numpy()
            values = ids.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ordinal", "file", "n_tokens", "ids_crc32"])

    rows = written(stored.mapInArrow(run, schema), "token-rows")
    files = rows.groupBy("file").agg(F.min("doc_id").alias("__first"), F.sum("n_tokens").alias("__n"))  # one row per file
    earlier = Window.orderBy(F.col("__first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("__inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return running.join(base, "file").select("doc_id", (F.col("__base") + F.col("__inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir):
    """op6: all ``documents``, written and read back."""
    path = fresh_path(spark, "token-ids")
    write_ids(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return document_table(spark, path)
