"""Hybrid ranking: keyword and semantic candidates, each scaled to 0 to 1 per query, weighted and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.scores import min_max

KEYWORD_WEIGHT, SEMANTIC_WEIGHT, MIN_SCORE, OVERFETCH = 0.3, 0.7, 0.3, 3
DECIMALS = 6


def weights(keyword: float, semantic: float) -> tuple[float, float]:
    """Weights that add up to one; halves where they add up to nothing."""
    total = keyword + semantic
    return (keyword / total, semantic / total) if total > 0 else (0.5, 0.5)


def fuse(keyword: DataFrame, semantic: DataFrame, k: int, min_score: float = MIN_SCORE, keyword_weight: float = KEYWORD_WEIGHT, semantic_weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """(query_id, chunk_id, score, rank) from two candidate lists (query_id, chunk_id, score).

    A candidate that one side lacks has score 0 there, before scaling. A side whose scores are all equal scales to 1.
    """
    kw, sw = weights(keyword_weight, semantic_weight)
    both = keyword.select("query_id", "chunk_id", F.col("score").alias("kw")).join(
        semantic.select("query_id", "chunk_id", F.col("score").alias("sem")), ["query_id", "chunk_id"], "full_outer"
    )
    both = both.select("query_id", "chunk_id", F.coalesce("kw", F.lit(0.0)).alias("kw"), F.coalesce("sem", F.lit(0.0)).alias("sem"))
    query = Window.partitionBy("query_id")
    score = F.round(kw * min_max(F.col("kw"), query) + sw * min_max(F.col("sem"), query), DECIMALS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    kept = both.withColumn("score", score).where(F.col("score") >= min_score)
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
