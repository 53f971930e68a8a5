"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A Misra-Gries pass (Spark's ``approx_top_k``, whose frequent-items sketch is the mergeable form of that
algorithm) names the digests that may be frequent. They are counted exactly, and the verified winners - at most
``heavy_capacity`` rows - are broadcast, so that rows of a frequent text are decided on the map side and never meet
in one task. All other digests are rare, by the sketch's guarantee at most a ``4 / sketch_capacity`` share of the
rows each, and go through an ordinary shuffle of narrow rows. Texts are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.shared import SPACE_RUN, documents, text_or_empty, written

HEAVY_CAPACITY = 1024
SKETCH_CAPACITY = 8192


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with each ASCII white-space run as one space; written once."""
    normal = F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " ")
    return written(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest")), "digests")


def heavy_winners(digests: DataFrame, heavy_capacity: int, sketch_capacity: int) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests, counted exactly; at most about ``heavy_capacity`` rows."""
    key = F.xxhash64("digest")
    sketch = digests.agg(F.expr(f"approx_top_k(xxhash64(digest), {heavy_capacity}, {sketch_capacity})").alias("top"))
    likely = sketch.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("likely_key"))
    return (
        digests.join(F.broadcast(likely), key == F.col("likely_key"), "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    heavy_capacity: int = HEAVY_CAPACITY,
    sketch_capacity: int = SKETCH_CAPACITY,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. A null id is larger than any other: it stays only where its whole group has null ids.
    Rows that repeat the winning id are all kept: they are the same document. An empty table gives no rows. Other
    columns of ``docs`` are neither read nor returned, so that no name can clash.
    """
    digests = digest_table(docs, id_col, text_col)
    winners = F.broadcast(heavy_winners(digests, heavy_capacity, sketch_capacity))
    same = Window.partitionBy("digest")
    heavy = digests.join(winners, "digest").select("doc_id", "keep_id", "group_size", "digest")
    rare = digests.join(winners, "digest", "left_anti").select(
        "doc_id", F.min("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"), "digest"
    )
    return heavy.unionByName(rare).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark, sf_dir):
    """op10: every row of ``documents``."""
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
