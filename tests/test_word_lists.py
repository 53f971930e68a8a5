"""Words cut in Arrow are those of the column function; a search cuts each text twice, whatever the questions."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import keyword, similarity


@pytest.mark.parametrize("few", [1, 16])
def test_words_are_those_of_the_column(spark, monkeypatch, few):
    monkeypatch.setattr(text, "FEW", few)
    rng = random.Random(1)
    texts = [None, "", "a", "É b", "a", "_x 1²", "𝒳y z", "...", "a\n", " x", "İx", "漢字 かな", "ΑΣ ΑΣΑ", "x"]
    texts += [None if rng.random() < 0.1 else "".join(rng.choice("aB é_ 1𝒳.漢\ń") for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([*enumerate(texts)], "i long, text string").select("i", F.lower("text").alias("text"), text.tokens(F.col("text")).alias("words")).orderBy("i").collect()
    lowered = pa.array([r.text for r in rows], pa.string())
    assert text.word_lists(lowered).to_pylist() == [r.words or [] for r in rows]
    assert text.word_lists(lowered.slice(3, 40)).to_pylist() == [r.words or [] for r in rows[3:43]]
    assert text.word_lists(lowered.slice(0, 0)).to_pylist() == []


def test_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(keyword, "COUNTED", 10)
    monkeypatch.setattr(keyword, "HELD", 3)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randrange(9)))) for i in range(200)] + [(200, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    wanted = {}
    for _, t in rows:
        for w in set((t or "").split()):
            wanted[w] = wanted.get(w, 0) + 1
    assert {r.token: r.df for r in keyword.document_frequencies(chunks).collect()} == wanted
    stats = keyword.corpus_stats(chunks).first()
    assert (stats.n_chunks, stats.avg_len) == (201, sum(len((t or "").split()) for _, t in rows) / 201)
    assert keyword.corpus_stats(chunks.limit(0)).first() == (0, None)


def test_searches_cut_no_words_in_the_plan_and_join_no_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"w{i % 7} w{i}", [float(i % 5), 1.0]) for i in range(50)], "chunk_id long, text string, embedding array<double>")
    asked = spark.createDataFrame([(i, f"w{i}") for i in range(9)], "query_id long, question string")
    assert "regexp_extract_all" not in keyword.keyword_topk(chunks, asked, 3)._jdf.queryExecution().executedPlan().toString()
    vectors = asked.select("query_id", F.array(F.col("query_id").cast("double"), F.lit(1.0)).alias("vector"))
    wanted = {tuple(r) for r in similarity.cosine_topk(chunks, vectors, 4).collect()}
    monkeypatch.setattr(similarity, "DIRECT", 3)
    monkeypatch.setattr(similarity, "CELLS", 40)
    found = similarity.cosine_topk(chunks, vectors, 4)
    assert {tuple(r) for r in found.collect()} == wanted
    assert not re.search("FlatMapCoGroups|Join", found._jdf.queryExecution().executedPlan().toString())
