"""Each stage of the pipeline on its predecessor's rows, against the brute force of its operator."""

from __future__ import annotations

import re

import sentencepiece
from test_lines import plain as plain_lines
from test_near_copies import plain_kept

import corpus_pipeline
from weftline.llm import quality
from weftline.llm.encode import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows.append({r.doc_id: r for r in docs.collect()})
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    rows.append({r.doc_id: r for r in docs.collect()})
    start, good, lined, single, clean, coded = rows

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scores = {r.doc_id: r.score for r in quality.query(spark, SF).collect()}
    assert set(good) == {i for i in start if scores[i] >= quality.THRESHOLD}
    assert all(i in good for i, q in labels.items() if q == 1)

    want = plain_lines({i: r.text for i, r in good.items()})
    assert {i: r.text for i, r in lined.items()} == want
    assert all(r.n_chars == len(r.text) for r in lined.values())

    assert set(single) == plain_kept({i: r.text for i, r in lined.items()})

    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert set(clean) == {i for i, r in single.items() if not hit(words(r.text))}

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    assert {i: r.ids for i, r in coded.items()} == {i: library.encode(r.text) for i, r in clean.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == {i: r.ids for i, r in coded.items()}


def test_odd_tables(spark, tmp_path):
    """Null and empty texts, null and repeated ids, and an empty table go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(6).collect()]
    odd = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None), (2, None), (3, ""), (3, ""), (4, "\n\n"), (5, texts[3]), (6, texts[3])]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars int")
    for name, table in (("odd", rows), ("none", rows.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            table = stage(spark, table, SF)
            table.write.parquet(str(tmp_path / f"{name}{k}"))
            table = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        got = [(r.doc_id, r.n_tokens) for r in table.collect()]
        if name == "none":
            assert got == []
        else:
            assert not {i for i, _ in got} - {i for i, _ in odd}
            assert len([i for i, _ in got if i in (5, 6)]) <= 1
