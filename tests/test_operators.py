"""Behaviour beyond SQL: fixtures, files, store, streams, plans and their limits."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions import vector
from weftline.operators import chunking, embedding, fusion, keyword, similarity
from weftline.operators.sizing import small_side
from weftline.operators.store import ChunkStore
from weftline.plans import answer
from weftline.sources import files
from weftline.streaming import ingest as streaming


def windows(spark, text, *options):
    return spark.createDataFrame([(text,)], "t string").select(chunking.sentence_windows(F.col("t"), *options)).first()[0]


def test_overlapping_sentences(spark):
    text = "This is sentence one. This is sentence two. This is sentence three. This is sentence four."
    got = windows(spark, text, 2, 1, 10)
    assert len(got) == 3 and "sentence one" in got[0] and "sentence two" in got[0] and "sentence two" in got[1]


def test_empty_and_short_texts(spark):
    assert windows(spark, "", 12, 2, 10) == []
    assert windows(spark, None) == []
    assert windows(spark, "Short but meaningful sentence.", 12, 2, 5) == ["Short but meaningful sentence."]


@pytest.mark.parametrize("size,overlap", [(1, 0), (3, 1), (3, 3), (2, 5), (5, 4)])
def test_windows_equal_a_loop(spark, size, overlap):
    for n in range(1, 14):
        said = [f"sentence number {i} here." for i in range(n)]
        want, begin = [], 0
        while True:
            end = min(begin + size, n)
            want.append(" ".join(said[begin:end]))
            if end >= n:
                break
            begin = end - overlap if end - overlap > begin else end
        assert windows(spark, " ".join(said), size, overlap, 1) == want


def test_cleaning_equals_python(spark):
    rng = np.random.default_rng(1)
    letters = list("ab .\n\n \t\r") + [" ", " ", " ", "\u0085", "\x07", "\x1f"]
    texts = ["".join(rng.choice(letters, size=rng.integers(0, 25))) for _ in range(300)]

    def plain(t):
        for c in "     ":
            t = t.replace(c, " ")
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub(" {3,}", "  ", re.sub("\n{3,}", "\n\n", t)))
        return "\n".join(x.rstrip() for x in t.replace("\t", " ").split("\n")).strip()

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.clean_text(F.col("t"))).collect()
    assert [r[1] for r in sorted(rows)] == [plain(t) for t in texts]


def test_bm25_equals_the_formula(spark):
    texts = ["the cat sat", "the dog", "a cat and a cat", "birds fly high", "the the the end"]
    question = "cat cat the nothing"
    docs = [re.findall(r"\w+", t.lower()) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = {i: sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in question.split() if w in d) for i, d in enumerate(docs)}
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    got = keyword.keyword_topk(chunks, spark.createDataFrame([(0, question)], "query_id long, question string"), 10).collect()
    assert {r.chunk_id: r.score for r in got} == {i: pytest.approx(x, abs=1e-6) for i, x in want.items() if x > 0}
    assert keyword.keyword_topk(chunks, spark.createDataFrame([(0, "?!")], "query_id long, question string"), 10).count() == 0
    assert keyword.keyword_topk(chunks.limit(0), spark.createDataFrame([(0, "cat")], "query_id long, question string"), 10).count() == 0


def test_vectors_at_the_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-2.0, 0.0]), (3, [3.0, 3.0]), (4, None), (5, [5.0, 0.0])]
    held = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "query_id long, vector array<double>")
    got = [(r.query_id, r.chunk_id, r.rank) for r in similarity.cosine_topk(held, asked, 10).orderBy("rank").collect()]
    assert got == [(7, 0, 1), (7, 5, 2), (7, 3, 3)]
    assert [r.chunk_id for r in similarity.cosine_topk(held, asked, 10, -1.0).orderBy("rank").collect()] == [0, 5, 3, 2]
    assert [r.chunk_id for r in similarity.cosine_topk_one(held, [2.0, 0.0], 2).collect()] == [0, 5]
    assert similarity.cosine_topk(held, asked.limit(0), 5).count() == 0
    units = held.where("chunk_id IN (1, 3)").select(vector.unit(F.col("embedding"))).collect()
    assert units[0][0] is None and units[1][0] == pytest.approx([2**-0.5] * 2)


def test_weights_and_sizes(spark):
    assert fusion.weights(0, 0) == (0.5, 0.5) and fusion.weights(1, 3) == (0.25, 0.75)
    rows = spark.range(10)
    assert "broadcast" in small_side(rows, 10)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in small_side(rows, 9)._jdf.queryExecution().toString().lower()
    for wrong in ({"top_k": 0}, {"top_k": 21}, {"min_score": 1.5}):
        with pytest.raises(ValueError):
            answer.Options(**wrong)
    with pytest.raises(ValueError):
        answer.ingest(spark.createDataFrame([], "doc_id string, source string, text string"), 2, 2)


def test_cached_embeddings(spark):
    model = embedding.HashingEmbedder(8)
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id int, text string")
    first, fresh = embedding.embed_cached(docs.where("id < 3"), model)
    assert fresh.count() == 1 and first.where("embedding IS NULL").count() == 0
    out, more = embedding.embed_cached(docs, model, fresh)
    assert more.count() == 1
    assert {r.id: r.embedding is None for r in out.collect()} == {1: False, 2: False, 3: False, 4: True}


def test_store_appends_and_clears(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    assert store.load().count() == 0 and store.stats().first().total_chunks == 0
    part = lambda ids: spark.createDataFrame([(d, k, f"{d} {k}") for d in ids for k in range(3)], "doc_id string, chunk_index int, text string")
    store.append(part("ba"))
    store.append(part("c").withColumn("other", F.lit(1)))
    got = [(r.chunk_id, r.doc_id, r.chunk_index) for r in store.load().orderBy("chunk_id").collect()]
    assert got == [(i, "abc"[i // 3], i % 3) for i in range(9)]
    store.clear()
    assert store.load().count() == 0


def test_streamed_chunks_reach_the_store(spark, tmp_path):
    text = " ".join(f"Sentence number {i} of the stream." for i in range(30))
    docs = spark.createDataFrame([("d1", "s", text), ("d2", "s", "short one")], "doc_id string, source string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    store = ChunkStore(spark, str(tmp_path / "store"))
    streaming.ingest_stream(streaming.stream_documents(spark, str(tmp_path / "in")), store, str(tmp_path / "checkpoint")).awaitTermination()
    want = sorted((r.doc_id, r.chunk_index, r.text) for r in answer.ingest(docs).collect())
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in store.load().collect()) == want


def test_files_and_extractors(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.7 page one|page two")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF broken")
    (tmp_path / "x.py").write_text("print('é')\n")

    def pdf(content):
        if b"broken" in content:
            raise ValueError("damaged")
        return content.decode()[9:].split("|"), {"title": "T"}

    found = files.binary_files(spark, str(tmp_path))
    pdfs = found.where(files.valid_pdf(F.col("path"), F.col("content")))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.pdf_documents(pdfs, pdf).collect()}
    assert got["good.pdf"].text == "[Page 1]\npage one\n\n[Page 2]\npage two" and got["good.pdf"].raw_text == "page one\n\npage two"
    assert got["good.pdf"].pages == 2 and got["good.pdf"].metadata.title == "T"
    assert got["bad.pdf"].error == "ValueError: damaged" and got["bad.pdf"].text is None
    image = lambda _: [{"page_number": 1, "image_index": 0, "width": 2, "height": 3, "format": "png", "ocr_text": " sign "}]
    assert [(r.ocr_text, r.has_text) for r in files.images(pdfs, image).collect()] == [("sign", True)] * 2
    assert [r.code for r in files.code_files(spark, str(tmp_path / "x.py")).collect()] == ["print('é')\n"]


def test_answers(spark):
    text = "Apples are red and sweet fruit. Bananas are yellow and soft fruit. Cherries are small and dark fruit."
    docs = spark.createDataFrame([("d1", "fruit.txt", text), ("d2", "cars.txt", "Cars have wheels and engines to move. Trucks carry heavy loads over roads.")], "doc_id string, source string, text string")
    model = embedding.HashingEmbedder()
    chunks = embedding.embed(answer.ingest(docs).withColumn("chunk_id", F.monotonically_increasing_id()), model)
    asked = spark.createDataFrame([(1, "Which bananas are yellow?"), (2, "  ")], "query_id long, question string")
    write = lambda rows: rows.withColumn("answer", F.concat(F.lit("from "), F.size("contexts").cast("string")))
    got = {r.query_id: r for r in answer.answer(chunks, asked, answer.Options(top_k=1), generate=write).collect()}
    assert got[1].sources == ["fruit.txt"] and got[1].answer == "from 1" and "Context 1:\nApples" in got[1].prompt
    assert got[1].contexts[0].highlight_count >= 3
    assert got[2].answer == answer.NOTHING_FOUND and got[2].contexts is None
    none = answer.answer(chunks.limit(0), asked).collect()
    assert {r.answer for r in none} == {answer.NO_DOCUMENTS} and {r.contexts for r in none} == {None}
    semantic = answer.retrieve(chunks, asked, answer.Options(hybrid=False, reranking=False, min_score=0.0, top_k=1))
    assert [r.source for r in semantic.collect()] == ["fruit.txt"]


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    part = lambda d, n: spark.createDataFrame([(d, k, "t") for k in range(n)], "doc_id string, chunk_index int, text string")
    store.append(part("a", 2), "s-0")
    store.append(part("b", 3), "s-1")
    store.append(part("b", 3), "s-1")
    assert [(r.chunk_id, r.doc_id) for r in store.load().orderBy("chunk_id").collect()] == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "b")]
    store.clear()
    store.append(part("c", 1))
    assert [(r.chunk_id, r.doc_id) for r in store.load().collect()] == [(0, "c")]
