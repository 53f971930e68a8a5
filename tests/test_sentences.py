"""Sentences by statistics: abbreviations, numbers, initials, starters."""

from __future__ import annotations

from weftline.operators import sentences as s

TEXT = "We met Dr. Brown at 3.5 miles. He said hello! Then J. Smith came, e.g. with tea. the rest was quiet? yes. Nothing more"


def corpus(spark):
    rows = [(0, TEXT), (1, None), (2, ""), (3, "  \n "), (4, "...")]
    rows += [(10 + i, f"Today Dr. Brown saw house{i}. He met some people e.g. the mayor. He left the town. The calm mayor saw the town was calm.") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS i").repartition(3)


def test_abbreviations_do_not_end_sentences(spark):
    docs = corpus(spark)
    learnt = s.learn(docs, "doc_id", "text")
    short = {r.word for r in learnt.abbreviations.collect()}
    assert {"dr", "e.g"} <= short and not short & {"town", "mayor", "calm", "miles"}
    assert "he" in {r.word for r in learnt.starters.collect()}
    found = {}
    for r in sorted(s.sentences(docs, learnt).collect(), key=lambda r: (r.id, r.sentence_no)):
        found.setdefault(r.id, []).append(r.sentence)
    assert found[0] == ["We met Dr. Brown at 3.5 miles.", "He said hello!", "Then J. Smith came, e.g. with tea. the rest was quiet?", "yes.", "Nothing more"]
    assert found[12] == ["Today Dr. Brown saw house2.", "He met some people e.g. the mayor.", "He left the town.", "The calm mayor saw the town was calm."]
    assert found[4] == ["..."] and not {1, 2, 3} & set(found)


def test_an_empty_corpus(spark):
    none = corpus(spark).limit(0)
    learnt = s.learn(none, "doc_id", "text")
    assert s.sentences(none, learnt).count() == 0
    assert {r.sentence for r in s.sentences(corpus(spark).where("doc_id = 4"), learnt).collect()} == {"..."}


def test_no_text_is_shuffled_and_large_tables_are_joined(spark, monkeypatch):
    docs = corpus(spark)
    learnt = s.learn(docs, "doc_id", "text")
    made = s.sentences(docs.repartition(3).cache(), learnt)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Window" not in s.fragments(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, made.collect()))
    monkeypatch.setattr(s, "KNOWN", 1)
    assert sorted(map(tuple, s.sentences(docs, learnt).collect())) == rows
