"""How often chunks are made, written and shuffled on their way to numbers and texts; cleaning and cutting in one step."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import clean_text
from weftline.operators import chunking, keyword, sizing, store


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaned_windows_take_one_step(spark):
    odd = [None, "", " \t \n", "a   b. " * 30, "One\tsentence   here\x07 　\n\n\n\nand on. " * 40, "x" * 60, "\x85 lead\r\n" + "Long enough, this one! " * 14 + " "]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, text string")
    both = rows.select("text", clean_text(F.col("text")).alias("c")).select(chunking.sentence_windows(F.col("text"), clean=True).alias("a"), chunking.sentence_windows(F.col("c")).alias("b"))
    assert all(r.a == r.b for r in both.collect())
    one = chunking.explode_chunks(rows, chunking.sentence_windows(F.col("text"), clean=True), "i")
    assert _plan(one).count("ArrowEvalPython") == 1 and "regexp" not in _plan(one)


def test_numbers_without_a_first_copy(spark, monkeypatch):
    names = []
    monkeypatch.setattr(store, "stored", lambda df, name: names.append(name) or sizing.stored(df, name))
    rows = spark.range(500).select(F.expr("id * 7 % 500").alias("doc_id"), F.lit(0).alias("chunk_index")).repartition(5)
    for again in (False, True):
        got = store.numbered(rows, 10, again=again).collect()
        assert sorted((r.chunk_id, r.doc_id) for r in got) == [(i + 10, i) for i in range(500)]
    assert names == ["chunks", "ranges", "ranges"]


def test_only_found_chunks_meet_their_texts(spark):
    chunks = spark.createDataFrame([(i, "s", f"text {i}") for i in range(50)], "chunk_id long, source string, text string")
    found = sizing.texts_of(spark.createDataFrame([(0, 3), (1, 3), (1, 49)], "query_id long, chunk_id long"), chunks)
    assert sorted((r.query_id, r.chunk_id, r.text) for r in found.collect()) == [(0, 3, "text 3"), (1, 3, "text 3"), (1, 49, "text 49")]


def test_frequencies_are_counted_once(spark):
    chunks = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}") for i in range(50)], "chunk_id long, text string")
    assert "regexp_extract_all" not in _plan(keyword.token_idf(chunks))
