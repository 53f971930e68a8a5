"""The factorisation machine: its identity, held-out accuracy and odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import quality

SF = "/root/testdata/sf0.01"


def test_identity_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    texts = ["a b c a", "D e", "", "x " * 50]
    m = quality.fit([quality.features(t) for t in texts], np.array([1.0, 0, 1, 0]), updates=5)
    m.factors = rng.normal(size=m.factors.shape)
    first, index, value = m.inputs([quality.features(t) for t in texts])
    z, _ = m.raw(first, index, value)
    for row, (a, b) in enumerate(zip(first, [*first[1:], len(index)], strict=True)):
        want = m.bias + sum(m.linear[i] * x for i, x in zip(index[a:b], value[a:b], strict=True))
        for p in range(a, b):
            for q in range(p + 1, b):
                want += m.factors[index[p]] @ m.factors[index[q]] * value[p] * value[q]
        assert np.isclose(z[row], want)


def test_training_copies_no_numbers_on_the_driver(spark, monkeypatch):
    """The sample stays in Arrow's buffers, in its own types; the fit is the one of 64-bit copies."""
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.append((rows, labels)) or fit(rows, labels, 20))
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), sample_rows=60)
    (rows, labels), = seen
    assert rows and not any(x.flags.owndata for row in rows for x in row)
    assert {tuple(x.dtype for x in row) for row in rows} == {(np.dtype("f8"), np.dtype("i4"), np.dtype("f4"))}
    wide = fit([(s, b.astype(np.int64), w.astype(np.float64)) for s, b, w in rows], labels, 20)
    assert np.array_equal(model.linear, wide.linear) and np.array_equal(model.factors, wide.factors) and model.bias == wide.bias


def test_held_out_accuracy_and_whole_table(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    tested = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert np.mean([p == y for p, y in tested]) > 0.93
    assert np.mean([p for p, y in tested if y]) > 0.98


def test_query_scores_equal_the_sum_over_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    m = quality.train(docs, flipped)  # labels of the held-out fold change nothing
    got = {r.doc_id: r.score for r in quality.query(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[::5]:
        _, index, value = m.inputs([quality.features(texts[i])])
        weighted = m.factors[index].astype(float) * value[:, None]
        pairs = np.triu(weighted @ weighted.T, 1).sum()
        z = m.bias + m.linear[index].astype(float) @ value + pairs
        assert np.isclose(got[i], 1 / (1 + np.exp(-np.clip(z, -35, 35))), atol=1e-5)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "good words here"), (1, "x " * 40_000), (3, "!!")], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label", "3 AS __x")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 1), (6, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    assert quality.keep_good(docs, model, threshold=0.0).count() == 5
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
