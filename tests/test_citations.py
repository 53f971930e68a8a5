"""Places and lines of spans: against brute force, and in linear time."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import citations

TEXTS = ["", "\n", "a\nb\n\nc", "one line", "ü😀\n😀ü\nend", "\n\n\n", "x" * 30 + "\n" + "y" * 30]


def test_lines_of_positions(spark):
    positions = list(range(-2, 70)) + [5, 0, 3, 3]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", citations.line_numbers(F.col("text"), F.lit(positions)).alias("lines"))
    for text, lines in rows.collect():
        assert lines == [text[:p].count("\n") + 1 if 0 <= p < len(text) else 1 for p in positions]
    assert spark.createDataFrame([(None,)], "text string").select(citations.line_numbers(F.col("text"), F.lit([1]))).first()[0] == [1]


def test_marks_end_where_the_text_is_cut(spark):
    text = "ab " * 400
    spans = [(i, i + 2) for i in range(0, 1200, 3)]
    marked, at = "", 0
    for start, end in spans:
        marked, at = marked + text[at:start] + "**" + text[start:end] + "**", end
    marked += text[at:]
    rows = spark.createDataFrame([(text, spans), ("short ab", [(6, 8)]), ("x" * 499, [(0, 1)]), ("x" * 500, []), ("x" * 501, [])], "text string, spans array<struct<char_start:int,char_end:int>>")
    found = [r[0] for r in rows.select(citations.marked(F.col("text"), F.col("spans"))).collect()]
    assert found == [marked[:500] + "...", "short **ab**", ("**x**" + "x" * 498)[:500] + "...", "x" * 500, "x" * 500 + "..."]


@pytest.mark.parametrize("what", ["highlights", "lines", "marked"])
def test_eighty_thousand_spans_take_linear_time(spark, what):
    """480 kB with a span at every sixth character, and as many lines."""
    rows = spark.createDataFrame([("a\nb c\n" * 80_000, "a")], "text string, question string").repartition(1).cache()
    rows.count()
    text, question = F.col("text"), F.col("question")
    if what == "highlights":
        made = F.size(citations.highlights(text, question))
    else:
        lines = citations.citation_lines(text, citations.merge_spans(citations.keyword_spans(text, question)))
        made = F.get(lines, F.lit(79_999))["line_end"] if what == "lines" else F.length(citations.marked(text, lines))
    rows.limit(1).select(F.size(citations.keyword_spans(text, question))).collect()  # code is compiled
    began = time.perf_counter()
    assert rows.select(made).first()[0] == {"highlights": 80_000, "lines": 159_999, "marked": 503}[what]
    assert time.perf_counter() - began < 6
