"""Words of many questions in one scan, and merging across rows, against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.operators import citations
from weftline.operators import question_scan as qs

TEXTS = [
    (1, "aaaa aa The theatre\nthe end"), (2, None), (3, ""), (4, "ananan banana anan"), (5, "ÜBER über"), (5, "über"), (None, "the end"), (6, "nothing"),
    (7, "the " * 200_000), (8, "aaaa aa The theatre\nthe end"),
]
QUESTIONS = [(0, "aa the"), (1, "anan an, über?"), (2, None), (3, ""), (4, "end the zzz")]


def places(word, text):
    """Leftmost places of a word that do not overlap."""
    out, at = [], text.find(word)
    while at >= 0:
        out.append((at, at + len(word)))
        at = text.find(word, at + len(word))
    return out


def merged(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def frames(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"word": F.lit("x"), "key": F.lit(1), "start": F.lit(2)})
    return texts, qs.question_words(spark.createDataFrame(QUESTIONS, "query_id long, question string"))


WORDS = {"aa", "the", "anan", "an", "über", "end", "zzz"}


def test_places_of_every_word(spark):
    texts, words = frames(spark)
    lowered = [t.lower() for _, t in TEXTS if t]
    each = {w: [len(places(w, t)) for t in lowered] for w in WORDS}
    wanted = {(w, sum(n > 0 for n in ns), sum(ns)) for w, ns in each.items() if sum(ns)}
    for block in (qs.BLOCK_WORDS, 2):
        assert {tuple(r) for r in qs.word_places(texts, words, block_words=block).collect()} == wanted
    assert qs.word_places(texts.limit(0), words).count() == 0
    assert qs.word_places(texts, words.limit(0)).count() == 0


def test_spans_of_all_questions_as_rows(spark):
    texts, words = frames(spark)
    wanted = {}
    for key, text in TEXTS:
        for w in WORDS:
            wanted.setdefault(key, []).extend(places(w, (text or "").lower()))
    wanted = sorted((str(k), s, e) for k, spans in wanted.items() for s, e in merged(spans))
    for block in (qs.BLOCK_WORDS, 2):
        found = qs.merge_rows(qs.word_spans(texts, words, block_words=block))
        assert sorted((str(r[0]), r[1], r[2]) for r in found.collect()) == wanted
    assert qs.merge_rows(qs.word_spans(texts, words.limit(0))).count() == 0


def test_covered_positions_of_all_questions(spark):
    texts, words = frames(spark)
    texts = texts.union(spark.createDataFrame([(9, "x" * 50 + "the" * 40 + "x" * 60 + "aa", "x", 1, 2), (10, "-" * 63 + "aa", "x", 1, 2), (11, "-" * 62 + "an" + "the", "x", 1, 2)], texts.schema))
    spans = {}
    for row in texts.collect():
        for w in WORDS:
            spans.setdefault(row.doc_id, []).extend(places(w, (row.text or "").lower()))
    each = {k: merged(v) for k, v in spans.items() if v}
    wanted = {(k, len(v), sum(e - s for s, e in v), v[0][0], v[-1][1]) for k, v in each.items()}
    for block in (qs.BLOCK_WORDS, 2):
        assert {tuple(r) for r in qs.covered_summary(qs.covered_cells(texts, words, block_words=block)).collect()} == wanted
    assert qs.covered_summary(qs.covered_cells(texts, words.limit(0))).count() == 0


def test_one_question_as_its_highlights(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    question = "the and of tionnd anea anan notaword"
    words = qs.question_words(spark.createDataFrame([(question,)], "question string"))
    one = citations.merge_spans(citations.keyword_spans(F.col("text"), F.lit(question)))
    wanted = texts.select("doc_id", F.explode(one).alias("s")).select("doc_id", "s.*").collect()
    assert sorted(map(tuple, qs.merge_rows(qs.word_spans(texts, words)).collect())) == sorted(map(tuple, wanted))


def test_rows_of_hot_keys_in_small_tiles(spark):
    random.seed(5)
    rows = [(random.choice([1, 1, 1, 1, 2, None]), s, s + random.choice([0, 1, 2, 3, 60])) for s in (random.randrange(3_000) for _ in range(900))] + [(3, None, 4), (3, 4, None)]
    wanted = []
    for key in (1, 2, None):
        wanted += [(str(key), s, e) for s, e in merged((s, e) for k, s, e in rows if k == key)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int").withColumns({"k": F.lit(0), "tile": F.lit(9)})
    for tile in (16, 100, qs.TILE):
        assert sorted((str(r[0]), r[1], r[2]) for r in qs.merge_rows(df, tile=tile).collect()) == sorted(wanted)
