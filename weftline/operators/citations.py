"""Highlights, their merging, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import bound, running
from weftline.functions.text import line_number, tokens

CONTEXT, MAX_LENGTH = 50, 500
_SPANS = "CAST(array() AS array<struct<start:int,end:int>>)"


def keyword_spans(text: Column, question: Column) -> Column:
    """All places of the question's words in the text, also inside longer words: sorted array of (start, end)."""
    lowered = F.lower(text)

    def places(word: Column) -> Column:
        def spans(pieces: Column) -> Column:
            before = running(F.transform(pieces, lambda p: F.length(p) + F.length(word)), lambda a, x: a + x)
            begins = F.zip_with(before, pieces, lambda at, piece: at + F.length(piece))
            found = F.transform(begins, lambda begin: F.struct(begin.alias("start"), (begin + F.length(word)).alias("end")))
            return F.slice(found, F.lit(1), F.size(pieces) - 1)

        return bound(F.split(lowered, word, -1), spans)

    return F.array_sort(F.flatten(F.transform(F.array_distinct(tokens(question)), places)))


def merge_spans(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap as one."""

    def islands(all_: Column, reach: Column) -> Column:
        n = F.size(all_)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(all_, i)["start"] > F.get(reach, i)))
        ends = bound(first, lambda f: F.transform(f, lambda i, k: F.coalesce(F.get(f, k + 1), n)))  # where the next one starts
        whole = F.zip_with(first, ends, lambda i, end: F.struct(F.get(all_, i)["start"].alias("start"), F.get(reach, end).alias("end")))
        return F.when(n > 0, whole).otherwise(F.expr(_SPANS))

    def merged(all_: Column) -> Column:
        ends = F.array_append(F.transform(all_, lambda s: s["end"]), F.lit(0))  # so that the last reach is that of all
        return bound(running(ends, F.greatest), lambda reach: islands(all_, reach))

    return bound(spans, merged)


def highlights(text: Column, question: Column) -> Column:
    """Merged spans with their context, clamped to the text: array of (start, end, context_start, context_end)."""

    def around(length: Column) -> Column:
        return F.transform(
            merge_spans(keyword_spans(text, question)),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.greatest(s["start"] - CONTEXT, F.lit(0)).alias("context_start"), F.least(s["end"] + CONTEXT, length).alias("context_end")),
        )

    return bound(F.length(text), around)


def line_numbers(text: Column, positions: Column) -> Column:
    """The line, from 1, of each position from 0 in an array, in the array's order; 1 outside the text and for a null one.

    Positions are sorted among the starts of the lines, and the starts counted: no part of the text is cut out.
    """

    def counted(lines: Column) -> Column:
        begins = running(F.transform(lines, lambda line: F.length(line) + 1), lambda a, x: a + x)
        whole = F.aggregate(lines, F.lit(-1), lambda n, line: n + F.length(line) + 1)
        starts = F.transform(begins, lambda p: F.struct(p.alias("at"), F.lit(-1).alias("i")))
        asked = F.transform(positions, lambda p, i: F.struct(p.cast("int").alias("at"), i.alias("i")))

        def numbered(events: Column) -> Column:
            before = running(F.transform(events, lambda e: F.when(e["i"] < 0, 1).otherwise(0)), lambda a, x: a + x)
            lined = F.zip_with(events, before, lambda e, n: F.struct(e["i"].alias("i"), e["at"].alias("at"), n.alias("n")))
            found = F.array_sort(F.filter(lined, lambda e: e["i"] >= 0))
            return bound(whole, lambda size: F.transform(found, lambda e: F.when((e["at"] >= 0) & (e["at"] < size), e["n"]).otherwise(F.lit(1))))

        return bound(F.array_sort(F.concat(starts, asked)), numbered)

    return bound(F.split(text, "\n", -1), counted)


def citation_lines(text: Column, spans: Column) -> Column:
    """Spans with line numbers: array of (line_start, line_end, char_start, char_end); the end's line is its last character's."""

    def placed(all_: Column) -> Column:
        ends = F.concat(F.transform(all_, lambda s: s["start"]), F.transform(all_, lambda s: s["end"] - 1))
        return bound(line_numbers(text, ends), lambda lines: F.zip_with(F.arrays_zip(all_.alias("s"), F.slice(lines, F.lit(1), F.size(all_)).alias("first")), F.slice(lines, F.size(all_) + 1, F.size(all_)), cited))

    def cited(x: Column, last: Column) -> Column:
        return F.struct(x["first"].alias("line_start"), last.alias("line_end"), x["s"]["start"].alias("char_start"), x["s"]["end"].alias("char_end"))

    return bound(spans, placed)


def cite(hits: DataFrame) -> DataFrame:
    """``hits`` (question, text, source, ...) with highlights, highlight_count, line_start and line_end; no source is 'unknown'."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = hits.withColumn("highlights", citation_lines(text, merge_spans(keyword_spans(text, F.col("question")))))
    return found.withColumns(
        {
            "source": F.coalesce("source", F.lit("unknown")),
            "highlight_count": F.size("highlights"),
            "line_start": F.lit(1),
            "line_end": line_number(text, F.length(text) - 1),
        }
    )


def marked(text: Column, spans: Column, max_length: int = MAX_LENGTH) -> Column:
    """The text with its spans (char_start, char_end), in order, between asterisks, cut at ``max_length`` with an ellipsis.

    Marks only move text to the right, so only the first ``max_length`` characters and the spans that start in them are looked at.
    """
    text, spans = F.substring(text, 1, max_length + 1), F.filter(spans, lambda s: s["char_start"] <= max_length)

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, F.greatest(s["char_start"] - acc["at"], F.lit(0)))
        inside = F.substring(text, s["char_start"] + 1, s["char_end"] - s["char_start"])
        return F.struct(s["char_end"].alias("at"), F.concat(acc["out"], before, F.lit("**"), inside, F.lit("**")).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)

    def cut(out: Column) -> Column:
        return F.when(F.length(out) > max_length, F.concat(F.substring(out, 1, max_length), F.lit("..."))).otherwise(out)

    return bound(bound(whole, lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text)))), cut)


def sources(hits: DataFrame) -> DataFrame:
    """(query_id, sources): the distinct sources of each query's hits, sorted."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_set(F.coalesce("source", F.lit("unknown")))).alias("sources"))
