"""Ingestion and question answering as whole plans: many documents or many questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.prompts import prompt
from weftline.functions.text import stripped
from weftline.operators.chunking import explode_chunks, sentence_windows
from weftline.operators.citations import cite, sources
from weftline.operators.embedding import Embedder, HashingEmbedder, embed
from weftline.operators.fusion import OVERFETCH, fuse
from weftline.operators.keyword import keyword_topk
from weftline.operators.related import expand
from weftline.operators.rerank import CANDIDATES, Scorer, lexical_overlap, rerank
from weftline.operators.similarity import cosine_topk
from weftline.operators.sizing import texts_of

#: The answers without contexts.
NO_DOCUMENTS = "No documents have been ingested yet. Please upload a PDF first."
NOTHING_FOUND = "I couldn't find any relevant information in the documents to answer your question. Please try rephrasing your query or lowering the similarity threshold."


@dataclass(frozen=True)
class Options:
    """How questions are answered."""

    top_k: int = 5
    min_score: float = 0.3
    hybrid: bool = True
    reranking: bool = True
    keyword_weight: float = 0.3
    semantic_weight: float = 0.7
    model: str = "generic"

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k must be between 1 and 20")
        if not 0 <= self.min_score <= 1:
            raise ValueError("min_score must be between 0 and 1")


def ingest(docs: DataFrame, size: int = 12, overlap: int = 2) -> DataFrame:
    """Chunks of documents (doc_id, source, text): doc_id, source, chunk_index, total_chunks, text."""
    if not 1 <= size <= 100 or not 0 <= overlap <= 50 or overlap >= size:
        raise ValueError("1 to 100 sentences a chunk, an overlap of 0 to 50 and less than that")
    return explode_chunks(docs, sentence_windows(F.col("text"), size, overlap, clean=True), "doc_id", "source").withColumnRenamed("chunk_text", "text")


def retrieve(chunks: DataFrame, queries: DataFrame, options: Options = Options(), embedder: Embedder | None = None, scorer: Scorer = lexical_overlap) -> DataFrame:
    """Hits of questions (query_id, question): query_id, question, chunk_id, source, text, score, fused_score, rank.

    Blank questions find nothing. With reranking, the best candidates are scored anew; either way at most ``top_k`` stay.
    """
    asked = queries.where(stripped(F.col("question")) != "")
    vectors = embed(asked, embedder or HashingEmbedder(), "question", "vector").select("query_id", "vector")
    wanted = CANDIDATES if options.reranking else options.top_k
    if options.hybrid:
        keyword = keyword_topk(chunks, asked, OVERFETCH * wanted)
        semantic = cosine_topk(chunks, vectors, OVERFETCH * wanted)
        found = fuse(keyword, semantic, wanted, options.min_score, options.keyword_weight, options.semantic_weight)
    else:
        found = cosine_topk(chunks, vectors, wanted, options.min_score)
    placed = texts_of(found, chunks).join(asked.select("query_id", "question"), "query_id")
    if options.reranking:
        return rerank(placed, options.top_k, scorer)
    return placed.withColumn("fused_score", F.col("score"))


def answer(chunks: DataFrame, queries: DataFrame, options: Options = Options(), embedder: Embedder | None = None, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per question: query_id, contexts (cited, by rank, related ones last), sources, prompt, answer.

    ``generate`` turns rows with a prompt into rows with an answer; without it the answer is null where there are
    contexts. Questions without contexts, and an empty store, have their fixed answers.
    """
    empty = chunks.isEmpty()
    hits = retrieve(chunks, queries, options, embedder)
    carried = hits.select("query_id", "question", "chunk_id", "source", "text", "score", "rank", F.lit(False).alias("is_related"))
    if "file_path" in chunks.columns:
        more = expand(hits, chunks).where("is_related").drop("rank")
        more = more.join(chunks.select("chunk_id", "source", "text"), "chunk_id").join(queries.select("query_id", "question"), "query_id")
        carried = carried.unionByName(more.withColumns({"score": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")}))
    cited = cite(carried)
    order = F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("o"), "chunk_id", "source", "text", "score", "rank", "is_related", "line_start", "line_end", "highlights", "highlight_count")
    per_query = cited.groupBy("query_id").agg(F.sort_array(F.collect_list(order)).alias("contexts"))
    rows = queries.select("query_id", "question").join(per_query, "query_id", "left").join(sources(cited), "query_id", "left")
    rows = rows.withColumn("prompt", F.when(F.col("contexts").isNotNull(), prompt(F.lit(options.model), F.col("question"), F.transform("contexts", lambda c: c["text"]))))
    rows = generate(rows) if generate else rows.withColumn("answer", F.lit(None).cast("string"))
    without = F.lit(NO_DOCUMENTS if empty else NOTHING_FOUND)
    return rows.withColumn("answer", F.when(F.col("contexts").isNull(), without).otherwise(F.col("answer")))
