"""Code, images and request texts on their way into the store, whole tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.code import language
from weftline.functions.text import stripped
from weftline.operators.chunking import code_structures, explode_chunks, line_blocks, ocr_chunks

MAX_MESSAGE = 10_000
MAX_TEXT = 10 * 1024 * 1024


def accepted(text: Column, most: int = MAX_MESSAGE) -> Column:
    """The stripped text of a request; null where it is null, blank, or longer than ``most`` characters as it came."""
    return F.when((F.length(text) <= most) & (stripped(text) != ""), stripped(text))


def file_id(path: Column) -> Column:
    """The document id of a file: the same at each ingestion."""
    return F.substring(F.sha2(path, 256), 1, 32)


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def ingest_code(files: DataFrame, structures: bool = False) -> DataFrame:
    """Chunks of code files (path, code): blocks of lines, with doc_id, source, chunk_index, total_chunks and type.

    With ``structures``, files in which functions are found give one chunk per function instead, with its name and class;
    all others give their blocks. Null and blank files have no chunks; paths are expected once each.
    """
    blocks = line_blocks(files).withColumns({"type": F.lit("code_block"), "name": F.lit(None).cast("string"), "class": F.lit(None).cast("string")})
    blocks = blocks.drop("chunk_index", "language")
    if structures:
        found = code_structures(files).alias("s").join(files.alias("f"), F.col("s.file_path") == F.col("f.path"))
        text = F.array_join(F.slice(F.split("f.code", "\n", -1), F.col("s.line_start"), F.col("s.line_end") - F.col("s.line_start") + 1), "\n")
        functions = found.select("s.*", F.rtrim(text, F.lit("\n")).alias("text"), F.lit("function").alias("type"))
        blocks = blocks.join(functions.select("file_path"), "file_path", "left_anti").unionByName(functions)
    chunk = F.struct("line_start", "line_end", "text", "type", "name", "class")
    per_file = blocks.groupBy("file_path").agg(F.sort_array(F.collect_list(chunk)).alias("c"))  # no larger than the file itself
    placed = per_file.select("file_path", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "x"))
    path = F.col("file_path")
    return placed.select(file_id(path).alias("doc_id"), file_name(path).alias("source"), "file_path", language(path).alias("language"), "chunk_index", "total_chunks", "x.*")


def ingest_images(images: DataFrame) -> DataFrame:
    """Chunks of standalone images (path, width, height, format, ocr_text, has_text): their recognised text, or a placeholder."""
    path = F.col("path")
    keys = {"doc_id": file_id(path), "source": file_name(path), "file_path": path, "type": F.lit("image"), "image_width": F.col("width"), "image_height": F.col("height"), "image_format": F.col("format"), "has_ocr_text": F.col("has_text")}
    named = images.select(*(c.alias(n) for n, c in keys.items()), F.col("ocr_text").alias("__ocr"))
    return explode_chunks(named, ocr_chunks(F.col("source"), F.col("__ocr")), *keys).withColumnRenamed("chunk_text", "text")
