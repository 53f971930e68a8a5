"""Reranking by a pluggable scorer of (question, text) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import tokens

CANDIDATES = 20
Scorer = Callable[[Column, Column], Column]


def lexical_overlap(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a model: the share of the question's distinct words that the text has."""
    asked = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1)), 6)


def rerank(candidates: DataFrame, k: int, scorer: Scorer = lexical_overlap) -> DataFrame:
    """The best ``k`` of candidates (query_id, question, chunk_id, text, score): score becomes fused_score, the scorer's is score."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = candidates.withColumnRenamed("score", "fused_score").withColumn("score", scorer(F.col("question"), F.col("text")))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
