"""Chunks: sliding windows of sentences, line blocks of code, recognised text of images, code structures."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.code import language
from weftline.functions.text import MIN_SENTENCE, SENTENCE, SPACES, cleaned, per_text, stripped

SENTENCES, OVERLAP, MIN_CHARS, BLOCK_LINES, OCR_CHARS = 12, 2, 50, 50, 100
_SENTENCE = re.compile(SENTENCE)


def windows_of(text: str, size: int, overlap: int, min_chars: int) -> list[str]:
    """The chunks of one text."""
    whole, step = text.strip(SPACES), size - overlap if size > overlap else size
    if len(whole) < min_chars:
        return [text] if whole else []
    found = [s for s in (m.strip(SPACES) for m in _SENTENCE.findall(text)) if len(s) > MIN_SENTENCE]
    if not found:
        return []
    windows = (" ".join(found[k : k + size]) for k in range(0, max(len(found) - size + step, 1), step))
    return [w for w in windows if len(w) >= min_chars] or [whole]


def sentence_windows(text: Column, size: int = SENTENCES, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, clean: bool = False) -> Column:
    """The chunks of a text as an array; of the cleaned text if so asked.

    Windows of ``size`` sentences step by ``size - overlap`` (by ``size`` where the overlap is no smaller); those under
    ``min_chars`` go. A text under ``min_chars`` is its only chunk, unstripped, unless blank; a text whose windows all go
    is its only chunk, stripped; a text without sentences, and null, has none.
    """

    def chunks(t: str | None) -> list[str]:
        return [] if t is None else windows_of(cleaned(t) if clean else t, size, overlap, min_chars)

    return per_text(chunks, "array<string>", pa.list_(pa.string()))(text)


def explode_chunks(df: DataFrame, chunks: Column, *carry: str) -> DataFrame:
    """One row per chunk: the carried columns, chunk_index from 0, total_chunks, chunk_text."""
    held = df.select(*carry, chunks.alias("__chunks"))
    each = held.select(*carry, F.posexplode_outer("__chunks").alias("chunk_index", "chunk_text"), F.size("__chunks").alias("total_chunks"))
    return each.where("chunk_index IS NOT NULL")  # without "outer" Spark adds a filter on the array, and makes it twice


def ocr_chunks(name: Column, recognised: Column) -> Column:
    """Chunks of an image's recognised text: windows if it is long, itself if short, a placeholder if there is none."""
    windows = sentence_windows(recognised)
    by_length = F.when(F.length(recognised) > OCR_CHARS, F.when(F.size(windows) > 0, windows).otherwise(F.array(recognised))).otherwise(F.array(recognised))
    return F.when(F.coalesce(recognised, F.lit("")) == "", F.array(F.concat(F.lit("[Image: "), name, F.lit("]")))).otherwise(by_length)


def line_blocks(df: DataFrame, path: str = "path", code: str = "code", lines: int = BLOCK_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Blocks of ``lines`` lines: file_path, language, chunk_index, line_start, line_end, text; blocks that are nearly blank go."""
    cut = df.select(F.col(path).alias("file_path"), F.split(F.col(code), "\n", -1).alias("__lines")).where("__lines IS NOT NULL")
    n = F.size("__lines")
    block = lambda k: F.struct(
        (k + 1).alias("line_start"), F.least(k + lines, n).alias("line_end"), F.array_join(F.slice("__lines", k + 1, F.lit(lines)), "\n").alias("text")
    )
    blocks = F.filter(F.transform(F.sequence(F.lit(0), n - 1, F.lit(lines)), block), lambda b: F.length(stripped(b["text"])) >= min_chars)
    return cut.select("file_path", language(F.col("file_path")).alias("language"), F.posexplode(blocks).alias("chunk_index", "b")).select("file_path", "language", "chunk_index", "b.*")


def code_structures(df: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """Functions of Python files: file_path, name, class, line_start, line_end.

    A function starts at its ``def`` line and ends before the next line that is not blank, no decorator, and indented no
    deeper; its class is the last one begun above it. Annotated results and ``async`` are understood.
    """
    lines = df.where(language(F.col(path)) == "python").select(F.col(path).alias("file_path"), F.posexplode(F.split(F.col(code), "\n", -1)).alias("i", "line"))
    lines = lines.withColumn("text", F.ltrim("line")).withColumn("indent", F.length("line") - F.length("text"))
    definition = r"^(?:async\s+)?def\s+(\w+)\s*\("
    in_file = Window.partitionBy("file_path").orderBy("i")
    lines = lines.withColumns(
        {
            "name": F.nullif(F.regexp_extract("text", definition, 1), F.lit("")),
            "class": F.last(F.nullif(F.regexp_extract("text", r"^class\s+(\w+)", 1), F.lit("")), True).over(in_file),
            "last": F.max("i").over(Window.partitionBy("file_path")),
        }
    )
    ends = lines.where((F.col("text") != "") & ~F.col("text").startswith("@")).select("file_path", F.col("i").alias("end_i"), F.col("indent").alias("end_indent"))
    starts = lines.where("name IS NOT NULL").alias("s")
    closed = starts.join(ends.alias("e"), (F.col("s.file_path") == F.col("e.file_path")) & (F.col("e.end_i") > F.col("s.i")) & (F.col("e.end_indent") <= F.col("s.indent")), "left")
    keys = [F.col(f"s.{c}").alias(c) for c in ("file_path", "name", "class")]
    return closed.groupBy(*keys, (F.col("s.i") + 1).alias("line_start"), F.col("s.last").alias("last")).agg(F.min("e.end_i").alias("end_i")).select(
        "file_path", "name", "class", "line_start", F.coalesce(F.col("end_i"), F.col("last") + 1).alias("line_end")
    )
