"""Files as DataFrames. What a format needs beyond Spark is a pluggable extractor that runs on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_BYTES = 50 * 1024 * 1024
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp")
PDF_MAGIC = "25504446"
#: The metadata that a PDF may carry.
PDF_METADATA = ("title", "author", "subject", "creator", "producer", "creation_date", "modification_date")

#: Bytes of a PDF to (texts of its pages, metadata); raises on files it cannot read.
PdfExtractor = Callable[[bytes], tuple[list[str], dict[str, str]]]
#: Bytes of a file to images: dicts with page_number, image_index, width, height, format, ocr_text.
ImageExtractor = Callable[[bytes], list[dict]]


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def valid_pdf(path: Column, content: Column) -> Column:
    """Whether a file has the suffix and magic of a PDF and between 1 byte and 50 MB."""
    return F.lower(path).endswith(".pdf") & F.octet_length(content).between(1, MAX_FILE_BYTES) & (F.hex(F.substring(content, 1, 4)) == PDF_MAGIC)


def valid_image(path: Column, content: Column) -> Column:
    """Whether a file has the suffix of an image and between 1 byte and 50 MB."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1).isin(*IMAGE_SUFFIXES) & F.octet_length(content).between(1, MAX_FILE_BYTES)


def pdf_documents(files: DataFrame, extract: PdfExtractor) -> DataFrame:
    """path, raw_text, text (with page markers), pages, page_texts, metadata, error; unreadable files have an error and no text."""
    fields = ", ".join(f"{m}: string" for m in PDF_METADATA)
    schema = f"path string, page_texts array<string>, metadata struct<{fields}>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages, metadata = extract(bytes(content))
                    rows.append((path, list(pages), {m: str(metadata.get(m, "")) for m in PDF_METADATA}, None))
                except Exception as failed:  # noqa: BLE001 - any extractor, any damage
                    rows.append((path, None, None, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["path", "page_texts", "metadata", "error"])

    found = files.select("path", "content").mapInPandas(run, schema)
    marked = F.transform("page_texts", lambda t, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]\n"), t))
    return found.select("path", F.array_join("page_texts", "\n\n").alias("raw_text"), F.array_join(marked, "\n\n").alias("text"), F.size("page_texts").alias("pages"), "page_texts", "metadata", "error")


def images(files: DataFrame, extract: ImageExtractor) -> DataFrame:
    """One row per image: path, page_number, image_index, width, height, format, ocr_text, has_text; damaged files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_number", "image_index", "width", "height", "format", "ocr_text"]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = extract(bytes(content))
                except Exception:  # noqa: BLE001 - any extractor, any damage
                    continue
                rows += [(path, *(x.get(n) for n in names)) for x in found]
            yield pd.DataFrame(rows, columns=["path", *names])

    out = files.select("path", "content").mapInPandas(run, "path string, page_number int, image_index int, width int, height int, format string, ocr_text string")
    text = F.trim(F.coalesce("ocr_text", F.lit("")))
    return out.withColumn("ocr_text", text).withColumn("has_text", F.length("ocr_text") > 0)


def code_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, code): whole UTF-8 files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))
