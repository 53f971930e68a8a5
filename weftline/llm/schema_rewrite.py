"""Rewriting a table's files to an evolved schema, by field id.

``numbered`` sorts a table by ranges and gives every row its rank: rows are dealt to ranges, sorted within them, and the
counts of the ranges (one number each, ``MOST_RANGES`` at most) are summed up to where each range starts. ``write_files``
cuts the ranked rows into files, one task for each. ``rewrite`` takes a folder of Parquet files whose schemas have drifted
and gives each the evolved schema: one task owns one file, matches its columns by field id, casts them, fills those that
are missing, and writes the replacement as a stream of batches. A file that has the schema already is not touched.

Tasks may run twice or be lost at any time. So replacements go to a staging folder first, under names that only one attempt
has, and are then renamed; what the starting files looked like is written down before the first of them is replaced; and
``publish`` renames what is staged over the starting file and reads the final file, which does the same however often it runs.

Files are opened through pyarrow's file systems: local or mounted folders, HDFS, S3 and Google Cloud Storage.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.shared import fresh_path, written

#: Ranges of the sort, at most: so many counts are summed up by one task and sent to all.
MOST_RANGES = 4096
#: Rows of a batch while files are read and written.
BATCH_ROWS = 8192
#: Files of the query, about.
FILES = 1000

Fields = dict[int, tuple[str, pa.DataType]]

#: The evolved schema of ``clients`` by field id, and what takes the place of missing columns.
CLIENTS: Fields = {
    1: ("client_id", pa.int64()),
    2: ("master_id", pa.int64()),
    3: ("source", pa.string()),
    4: ("updated_at", pa.timestamp("us")),
    5: ("name", pa.string()),
    6: ("email", pa.string()),
    7: ("city", pa.string()),
    8: ("nation_id", pa.int64()),
    9: ("segment", pa.string()),
    10: ("balance", pa.float64()),
}
MISSING = {7: "none", 8: -1}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path on it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def plain(uri: str) -> str:
    """A local folder as a plain path; others as they are."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def arrow_schema(fields: Fields) -> pa.Schema:
    """The fields, all nullable, with their ids."""
    return pa.schema([pa.field(name, kind, metadata={"PARQUET:field_id": str(k)}) for k, (name, kind) in fields.items()])


def ids_of(schema: pa.Schema) -> dict[int, int]:
    """Where the column of each field id is."""
    return {int(f.metadata[b"PARQUET:field_id"]): i for i, f in enumerate(schema) if f.metadata and b"PARQUET:field_id" in f.metadata}


def same_schema(a: pa.Schema, b: pa.Schema) -> bool:
    """Whether names, types, order and field ids agree."""
    return a.names == b.names and a.types == b.types and ids_of(a) == ids_of(b)


def rebuilt(batch: pa.RecordBatch, found: dict[int, int], fields: Fields, missing: dict[int, object]) -> pa.RecordBatch:
    """A batch of a drifted file in the evolved schema; columns without a default are null where they are missing."""
    columns = []
    for k, (_, kind) in fields.items():
        if k in found:
            columns.append(batch.column(found[k]).cast(kind))
        else:
            columns.append(pa.repeat(pa.scalar(missing.get(k), kind), batch.num_rows))
    return pa.RecordBatch.from_arrays(columns, schema=arrow_schema(fields))


class Output:
    """A Parquet file under a name of this attempt's own until it is whole; then it is renamed."""

    def __init__(self, store: fs.FileSystem, path: str, staging: str, schema: pa.Schema):
        self.store, self.path = store, path
        self.own = f"{staging}/{uuid.uuid4().hex}.tmp"
        self.stream = store.open_output_stream(self.own)
        self.writer = pq.ParquetWriter(self.stream, schema)

    def close(self) -> None:
        """Ends the file and gives it its name."""
        self.writer.close()
        self.stream.close()
        self.store.move(self.own, self.path)


def numbered(rows: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``rank``, from 0 in the given order; a written table. ``order`` should leave no ties between unequal rows."""
    spark = rows.sparkSession
    ranges = min(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number within its partition
    dealt = written(dealt.select("*", F.spark_partition_id().alias("__range"), place.alias("__place")), "rewrite-sorted")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("__range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__start"))
    return dealt.join(F.broadcast(starts), "__range").withColumn("rank", F.col("__start") + F.col("__place")).drop("__range", "__place", "__start")


def file_name(file_no: int) -> str:
    """The name of a file."""
    return f"part-{file_no:05d}.parquet"


def write_files(ranked: DataFrame, rows_per_file: int, n_files: int, folder: str, staging: str, schema_of: Callable[[int], pa.Schema], drifted: Callable[[int, pa.RecordBatch], pa.RecordBatch]) -> None:
    """Writes the ranked rows as ``n_files`` files of ``rows_per_file`` rows each, in order, one task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number = None, -1
        store, at = opened(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:  # a task holds one file's rows
                number = batch.column(0)[0].as_py()
                out = Output(store, f"{at}/{file_name(number)}", opened(staging)[1], schema_of(number))
            out.writer.write_batch(drifted(number, batch.select(batch.schema.names[2:])))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int64())})

    names = [c for c in ranked.columns if c != "rank"]
    file_no = F.expr(f"CAST(rank DIV {rows_per_file} AS INT)")
    dealt = ranked.select(file_no.alias("file_no"), "rank", *names).repartitionById(n_files, "file_no").sortWithinPartitions("rank")
    done = written(dealt.mapInArrow(run, "file_no long"), "rewrite-started").count()
    if done != n_files:
        raise RuntimeError(f"{done} of {n_files} files were written")


def rewrite(spark: SparkSession, folder: str, staging: str, names: Callable[[int], str], n_files: int, fields: Fields, missing: dict[int, object]) -> DataFrame:
    """(file_no, start_columns, rewritten) for each file of the folder; drifted ones have a replacement in ``staging`` then.

    The starting files are still in their place; ``publish`` replaces them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, at), (_, to) = opened(folder), opened(staging)
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            with store.open_input_file(f"{at}/{names(number)}") as stream:
                source = pq.ParquetFile(stream)
                start, evolved = source.schema_arrow, arrow_schema(fields)
                drifted = not same_schema(start, evolved)
                if drifted:
                    out = Output(store, f"{to}/{names(number)}", to, evolved)
                    for batch in source.iter_batches(BATCH_ROWS):
                        out.writer.write_batch(rebuilt(batch, ids_of(start), fields, missing))
                    out.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int64()), "start_columns": [",".join(start.names)], "rewritten": [drifted]})

    files = spark.range(0, n_files, 1, max(n_files, 1))
    return written(files.mapInArrow(run, "file_no long, start_columns string, rewritten boolean"), "rewrite-staged")


def publish(staged: DataFrame, n_files: int, folder: str, staging: str, names: Callable[[int], str], digest: Callable[[pq.ParquetFile], dict[str, object]], kinds: str) -> DataFrame:
    """``staged`` with ``path`` and what ``digest`` finds in each final file (columns ``kinds``), once the replacements are in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, at), (_, to) = opened(folder), opened(staging)
        for batch in batches:
            rows = []
            for number, replaced in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                name = names(number)
                if replaced and store.get_file_info(f"{to}/{name}").type == fs.FileType.File:  # else an attempt before has moved it
                    store.move(f"{to}/{name}", f"{at}/{name}")
                with store.open_input_file(f"{at}/{name}") as stream:
                    rows.append({"path": f"{plain(folder)}/{name}"} | digest(pq.ParquetFile(stream)))
            made = pa.RecordBatch.from_pylist(rows) if rows else None
            if made is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *made.schema.names])

    one_each = staged.withColumn("file", F.col("file_no").cast("int")).repartitionById(max(n_files, 1), "file").drop("file")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in staged.schema)
    return written(one_each.mapInArrow(run, f"{schema}, path string, {kinds}"), "rewrite-published")


# the query ------------------------------------------------------------------------------------------------------------


def version_of(file_no: int) -> int:
    """The drift of a starting file, in bits."""
    version = zlib.crc32(f"7:{file_no}".encode()) % 24
    return version if version <= 15 else 0


def start_schema(file_no: int) -> pa.Schema:
    """The drifted schema of a starting file."""
    version, fields = version_of(file_no), dict(CLIENTS)
    if version & 1:
        fields[5], fields[6] = (fields[6][0], fields[5][1]), (fields[5][0], fields[6][1])
    if version & 4:
        del fields[7], fields[8]
    if version & 8:
        fields[10] = (fields[10][0], pa.float32())
        if 8 in fields:
            fields[8] = (fields[8][0], pa.int32())
    if version & 2:
        fields = {1: fields[1]} | dict([x for x in fields.items() if x[0] != 1][::-1])
    return arrow_schema(fields)


def drifted(file_no: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of ``clients`` in the schema of its starting file."""
    schema = start_schema(file_no)
    at = {k: i for i, k in enumerate(CLIENTS)}
    columns = [batch.column(at[k]).cast(schema.field(i).type, safe=False) for k, i in sorted(ids_of(schema).items(), key=lambda x: x[1])]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _scaled(values: pa.Array) -> pa.Array:
    """floor(2^20 x) as text; what is not finite by its name."""
    x = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(x * 1048576.0)
        short = np.abs(scaled) < 2.0**62
    if short.all():
        text = pa.array(scaled.astype(np.int64)).cast(pa.string())
    else:
        text = pa.array([str(int(v)) if math.isfinite(v) else str(v) for v in scaled.tolist()])
    return pc.if_else(values.is_null(), pa.scalar(None, pa.string()), text)


def digests(file: pq.ParquetFile) -> dict[str, object]:
    """What the query returns of a final file, read in batches."""
    ids, rows, n_rows, n_nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
    for batch in file.iter_batches(BATCH_ROWS):
        shown = []
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            n_nulls += column.null_count
            if pa.types.is_timestamp(column.type):
                column = column.cast(pa.timestamp("us")).cast(pa.int64())
            shown.append(_scaled(column) if pa.types.is_floating(column.type) else column.cast(pa.string()))
        filled = [c.fill_null("?") for c in shown]
        lines = pc.binary_join_element_wise(*filled, "|")
        between = b"\n" if n_rows else b""
        rows.update(between + "\n".join(lines.to_pylist()).encode())
        ids.update((b"," if n_rows else b"") + ",".join(filled[batch.schema.names.index("client_id")].to_pylist()).encode())
        n_rows += batch.num_rows
    return {"columns": ",".join(file.schema_arrow.names), "n_rows": n_rows, "n_nulls": n_nulls, "ids_sha256": ids.hexdigest(), "rows_sha256": rows.hexdigest()}


def rewrite_clients(clients: DataFrame, ranges: int | None = None, files: int = FILES) -> DataFrame:
    """One row for each final file of ``clients``, sorted, drifted and rewritten in a new folder of the shared one.

    Rows come by the unsigned CRC-32 of the decimal client_id, then by client_id, then by a hash of all columns, so that
    rows that repeat an id have one order; a null id counts as the empty string and comes first. Null values stay. Text
    columns are taken whole. Columns beyond those of the evolved schema are not read, so no name can clash. An empty table
    gives no files and no rows.
    """
    spark = clients.sparkSession
    names = [name for name, _ in CLIENTS.values()]
    taken = clients.select(*(F.col(f"`{c}`") for c in names)).withColumn("nation_id", F.col("nation_id").cast("long")).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    key = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")).cast("binary"))
    order = [F.col("__crc"), F.col("client_id").asc_nulls_first(), F.col("__tie")]
    ranked = numbered(taken.withColumns({"__crc": key, "__tie": F.xxhash64(*names)}), order, ranges).drop("__crc", "__tie")
    n = ranked.count()
    per_file = 1 + n // files
    n_files = -(-n // per_file)

    base = fresh_path(spark, "rewritten")
    folder, staging = f"{base}/files", f"{base}/staging"
    for uri in (folder, staging):
        store, at = opened(uri)
        store.create_dir(at, recursive=True)
    if n:
        write_files(ranked, per_file, n_files, folder, staging, start_schema, drifted)
    staged = rewrite(spark, folder, staging, file_name, n_files, CLIENTS, MISSING)
    return publish(staged, n_files, folder, staging, file_name, digests, "columns string, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")


def query(spark, sf_dir):
    """op13: all of ``clients``, a row for each file."""
    made = rewrite_clients(spark.read.parquet(f"{sf_dir}/clients.parquet"))
    version = F.crc32(F.concat(F.lit("7:"), F.col("file_no").cast("string")).cast("binary")) % 24
    version = F.when(version > 15, F.lit(0)).otherwise(version).cast("long")
    return made.select("file_no", version.alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
