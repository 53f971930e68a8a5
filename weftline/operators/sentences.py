"""Sentences by statistics of the corpus, after Kiss and Strunk (2006), without annotated text.

A text is cut into fragments behind every token that ends in a full stop, an exclamation or a question mark. Which of these
ends a sentence is learnt from all texts:

* *Abbreviations*: a word that stands before a full stop more often than chance, by Dunning's log-likelihood ratio, scaled
  down for long words and for occurrences without the stop, and up for stops inside.
* *Sentence starters*: words that follow a full stop behind an ordinary word more often than chance, by the same ratio.

A full stop behind an abbreviation or an initial does not end a sentence, unless a sentence starter with a capital
follows; nor does one before a small letter. The other marks do, also before small letters. Numbers such as 3.5 hold no candidate.

Counts are by word, with partial sums before the shuffle. A text stays in its row: fragments are an array, decisions look at
the next one in it, and no text is shuffled. The learnt tables are as large as the abbreviations of the corpus; up to
``KNOWN`` counted rows they go to the tasks as sets, beyond that fragments are joined with them and gathered by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import ANY_SPACE, HELD, SPACES, stripped
from weftline.operators.sizing import small_side, stored

#: Fixed values of the published method: least scores of abbreviations and starters, the share of stops behind an abbreviation.
ABBREVIATION, STARTER, STOPS = 0.3, 30.0, 0.99
#: Abbreviations and starters that go to every task as sets, at most.
KNOWN = 20_000
#: Characters that may follow a mark before the space.
CLOSING = r"\x22'\)\]\x{bb}\x{201d}\x{2019}"
#: A fragment: up to and with a token that ends in a mark, and the spaces behind it; or what is left.
FRAGMENT = rf"(?s).*?[.!?]+[{CLOSING}]*[{ANY_SPACE}]+|.+\z"
#: The words of a text, with a stop that follows them directly.
WORD = r"\p{L}[\p{L}\p{M}.]*"
_LAST = rf"(\p{{L}}[\p{{L}}\p{{M}}.]*)\.[{CLOSING}]*[{ANY_SPACE}]*$"
_NEXT = rf"^[^\p{{L}}\p{{N}}]*(\p{{L}}[\p{{L}}\p{{M}}]*)"
_STOP = rf"[^.!?]\.[{CLOSING}]*[{ANY_SPACE}]+$"


@dataclass(frozen=True)
class Learnt:
    """Stored tables: abbreviations (word) and starters (word), in small letters, with their counts and scores."""

    abbreviations: DataFrame
    starters: DataFrame


def pieces_of(text: Column) -> Column:
    """Of each fragment of a text, in order: fragment, the word before its full stop, the next fragment's first word, whether it ends in one full stop."""

    def judged(every: Column) -> Column:
        def piece(fragment: Column, i: Column) -> Column:
            following = F.regexp_extract(F.get(every, i + 1), _NEXT, 1)
            return F.struct(fragment.alias("fragment"), F.lower(F.regexp_extract(fragment, _LAST, 1)).alias("word"), following.alias("next"), fragment.rlike(_STOP).alias("stop"))

        return F.transform(every, piece)

    cut = F.regexp_extract_all(text, F.lit(FRAGMENT), F.lit(0))
    return F.get(F.transform(F.array(cut), judged), F.lit(0))  # a text is cut once, however often its fragments are mentioned


def fragments(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, i, fragment, word, next, stop): the ``pieces_of`` each text."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(pieces_of(F.col(text_col))).alias("i", "piece")).select("id", "i", "piece.*")


def _log(p: Column, k: Column, n: Column) -> Column:
    """The log-likelihood of k of n at p."""
    return k * F.ln(p) + (n - k) * F.ln(F.lit(1.0) - p)


def _kept(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))


def words(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n, n_stop): how often each word occurs, and how often with a full stop behind it; a word may hold stops, not end in one."""
    each = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0))).alias("w"))
    return each.groupBy(F.regexp_replace("w", r"\.+$", "").alias("word")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("w").rlike(r"[^.]\.$"), 1).otherwise(0)).alias("n_stop"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(word, n, n_stop, score) of the abbreviations among ``words``."""
    total = counts.agg(F.sum("n").alias("total"), F.sum("n_stop").alias("stops"))
    each = counts.where("n_stop > 0").crossJoin(F.broadcast(total))  # one row
    ratio = 2 * (_log(F.lit(STOPS), F.col("n_stop"), F.col("n")) - _log(_kept(F.col("stops") / F.col("total")), F.col("n_stop"), F.col("n")))
    inside = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    letters = F.length("word") - inside
    scaled = ratio * F.exp(-letters.cast("double")) * (inside + 1) * F.pow(letters.cast("double"), -(F.col("n") - F.col("n_stop")).cast("double"))
    return each.select("word", "n", "n_stop", F.round(scaled, 6).alias("score")).where(F.col("score") >= ABBREVIATION)


def starters(pieces: DataFrame, counts: DataFrame, known: DataFrame) -> DataFrame:
    """(word, n, n_start, score) of the sentence starters; ``pieces`` are fragments, ``known`` the abbreviations."""
    ends = pieces.where("stop AND word <> '' AND next <> ''").join(small_side(known.select("word")), "word", "left_anti")
    follows = stored(ends.groupBy(F.lower("next").alias("word")).agg(F.count("*").alias("n_start")), "sentence-follows")  # texts are cut once
    total = counts.agg(F.sum("n").alias("total"))
    ended = follows.agg(F.sum("n_start").alias("ends"))
    each = follows.join(counts.select("word", "n"), "word").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(ended))  # one row each
    k, n, c, t = F.col("n_start").cast("double"), F.col("ends").cast("double"), F.col("n").cast("double"), F.col("total").cast("double")
    free, behind, else_ = _kept(c / t), _kept(k / n), _kept((c - k) / (t - n))
    ratio = 2 * (_log(behind, k, n) + _log(else_, c - k, t - n) - _log(free, k, n) - _log(free, c - k, t - n))
    return each.where(F.col("n_start") * F.col("total") > F.col("ends") * F.col("n")).select("word", "n", "n_start", F.round(ratio, 4).alias("score")).where(F.col("score") >= STARTER)


def learn(texts: DataFrame, id_col: str, text_col: str) -> Learnt:
    """The tables of a corpus; of an empty one, empty tables."""
    counts = stored(words(texts, text_col), "sentence-words")
    known = stored(abbreviations(counts), "sentence-abbreviations")
    return Learnt(known, stored(starters(fragments(texts, id_col, text_col), counts, known), "sentence-starters"))


def sentences(texts: DataFrame, learnt: Learnt, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_no, sentence): the stripped sentences of each text, numbered from 0; ids must be unique.

    Null, empty and blank texts have none. Other columns are not read.
    """
    known = learnt.abbreviations.select("word", F.lit(True).alias("short")).union(learnt.starters.select("word", F.lit(False))).limit(KNOWN + 1).collect()
    if len(known) > KNOWN:
        return _joined(fragments(texts, id_col, text_col), learnt)
    made = _assembled(frozenset(r.word for r in known if r.short), frozenset(r.word for r in known if not r.short))
    each = texts.select(F.col(id_col).alias("id"), _marked(pieces_of(F.col(text_col))).alias("pieces"))
    return each.mapInArrow(made, f"id {each.schema['id'].dataType.simpleString()}, sentence_no int, sentence string")


def _marked(pieces: Column) -> Column:
    """Of each piece what decides: fragment, word, start (the next word in small letters), stop, goes_on (whatever is learnt), capital."""

    def marked(p: Column) -> Column:
        capital = F.coalesce(p["next"].rlike(r"^\p{Lu}"), F.lit(False))
        goes_on = F.coalesce(p["next"].rlike(r"^\p{Ll}"), F.lit(False)) | (F.length(p["word"]) == 1) & capital
        return F.struct(p["fragment"].alias("fragment"), p["word"].alias("word"), F.lower(p["next"]).alias("start"), p["stop"].alias("stop"), goes_on.alias("goes_on"), capital.alias("capital"))

    return F.transform(pieces, marked)


def _assembled(short: frozenset, starts: frozenset):
    """An Arrow function: (id, ``_marked`` pieces) to numbered sentences, stripped, blank ones left out."""

    def sentences_of(pieces: list | None) -> list[str]:
        out, parts = [], []
        for p in pieces or ():
            parts.append(p["fragment"])
            if not (p["stop"] and (p["goes_on"] or p["word"] in short and not (p["capital"] and p["start"] in starts))):
                out.append("".join(parts).strip(SPACES))
                parts = []
        return list(filter(None, [*out, "".join(parts).strip(SPACES)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, HELD):
                found = [sentences_of(p.as_py()) for p in whole.column(1).slice(at, HELD)]
                rows = pa.array([i for i, each in enumerate(found) for _ in each], pa.int64())
                numbers = pa.array([n for each in found for n in range(len(each))], pa.int32())
                columns = [whole.column(0).slice(at, HELD).take(rows), numbers, pa.array([x for each in found for x in each], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "sentence_no", "sentence"])

    return run


def _joined(pieces: DataFrame, learnt: Learnt) -> DataFrame:
    """The same from ``fragments`` by joins with the learnt tables, where these are too large for sets."""
    short = small_side(learnt.abbreviations.select(F.col("word").alias("short")))
    start = small_side(learnt.starters.select(F.col("word").alias("start")))
    judged = pieces.join(short, pieces.word == short.short, "left").join(start, F.lower(pieces.next) == start.start, "left")
    initial = (F.length("word") == 1) & F.col("next").rlike(r"^\p{Lu}")
    goes_on = F.col("stop") & (F.col("next").rlike(r"^\p{Ll}") | initial | (F.col("short").isNotNull() & ~(F.col("start").isNotNull() & F.col("next").rlike(r"^\p{Lu}"))))
    order = Window.partitionBy("id").orderBy("i")
    ends = judged.select("id", "i", "fragment", F.when(goes_on, 0).otherwise(1).alias("end"))
    placed = ends.withColumn("no", F.coalesce(F.sum("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = placed.groupBy("id", "no").agg(F.sort_array(F.collect_list(F.struct("i", "fragment"))).alias("parts"))
    made = whole.select("id", "no", stripped(F.array_join(F.transform("parts", lambda p: p["fragment"]), "")).alias("sentence")).where("sentence <> ''")
    return made.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("no")) - 1).alias("sentence_no"), "sentence")
