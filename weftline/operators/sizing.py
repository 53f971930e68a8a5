"""Broadcasts behind a check of their size, and cuts of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be sent to every executor.
BROADCAST_ROWS = 200_000
#: The same for rows of one number.
FOUND_IDS = 1_000_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows; else as it is, for an ordinary join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of this application in the folder of ``spark.checkpoint.dir``.

    Where that setting is absent, a session in one process gets a temporary folder; a cluster is refused.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/weftline/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in ``fresh_path``: made once, lineage cut."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` (chunk_id, ...) with source and text: only the chunks that were found are shuffled. ``found`` is written, since it is used twice."""
    found = stored(found, "found")
    ids = small_side(stored(found.select("chunk_id").distinct(), "found-ids"), FOUND_IDS)
    return found.join(chunks.select("chunk_id", "source", "text").join(ids, "chunk_id", "left_semi"), "chunk_id")
