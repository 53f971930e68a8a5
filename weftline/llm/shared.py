"""What the corpus operators share: where intermediate tables go, and text columns without nulls."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of ASCII white space; the same characters as Python's bytes.split().
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent, a session in one process gets a temporary folder; a cluster is refused.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers, or elements of arrays in rows, that may be sent to every executor.
BROADCAST_ROWS = 1_000_000


def bounded(table: DataFrame, weight: Column | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its rows (or their sum of ``weight``) are at most ``most``; else for an ordinary join."""
    size = table.agg(F.count("*") if weight is None else F.sum(weight)).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def text_or_empty(name: str) -> Column:
    """The text column, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
