"""The words of many questions found in all texts at once, and spans that arrive as rows merged across rows.

The distinct words of all questions become one Aho-Corasick automaton, so that a text is read once however many questions
there are. At most ``BLOCK_WORDS`` words are in an automaton, the bound on what goes to the driver and to every task; more
words are dealt by hash into blocks, and each block reads the texts again. Words are found as ``citations.keyword_spans``
finds them: lower-cased, also inside longer words, and places of one word do not overlap one another.

Marks of many questions merge as bits of covered positions (``covered_cells``), a row for 64 positions. Spans that come as
rows, from wherever, are merged by ``merge_rows``, a sweep line in tiles of ``TILE`` positions. A tile is merged by itself; of each tile only the furthest end and the
last beginning go through the window over a key, so a key with most of the rows is spread over as many tasks as it has tiles.

Null texts, questions, and spans with a null place have no rows; empty ones neither. Repeated texts and ids count each by itself
in ``word_places``; in ``word_spans`` rows of one id are one text's. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import tokens
from weftline.operators.sizing import stored

BLOCK_WORDS = 200_000
#: Characters that a worker looks at together; a longer text is looked at alone.
SLICE_CHARS = 500_000
TILE = 4_096
CELL = 64


def question_words(questions: DataFrame, question: str = "question") -> DataFrame:
    """(word): the distinct words of all questions."""
    return questions.select(F.explode(F.array_distinct(tokens(F.col(question)))).alias("word")).distinct()


def _blocks(words: DataFrame, block_words: int) -> Iterator[list[str]]:
    """The words, one block after another, so that the driver holds one at a time."""
    n = words.count()
    count = -(-n // block_words)
    dealt = words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(max(count, 1))))
    for b in range(count):
        if held := sorted(r.word for r in dealt.where(F.col("block") == b).select("word").collect()):
            yield held


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of at most ``SLICE_CHARS`` characters, or of one text."""
    column, begin, held, size = batch.column(1), 0, [], 0
    for i in range(batch.num_rows):
        text = column[i].as_py()
        if held and size + len(text) > SLICE_CHARS:
            yield begin, held
            begin, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield begin, held


def _overlaps_itself(word: str) -> bool:
    """Whether two places of the word can overlap: whether it ends as it begins."""
    return any(word.startswith(word[i:]) for i in range(1, len(word)))


def _apart(word: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which places, sorted by word and start, are left when places of a word may not overlap: the leftmost first."""
    keep = np.ones(len(word), bool)
    close = (word[1:] == word[:-1]) & (start[1:] - start[:-1] < length[1:])
    free = -1
    for i in np.flatnonzero(close) + 1:
        if i < 2 or not close[i - 2]:  # a chain begins: the place before stays
            free = start[i - 1] + length[i - 1]
        keep[i] = start[i] >= free
        if keep[i]:
            free = start[i] + length[i]
    return keep


def _places(automaton: ahocorasick.Automaton, sizes: np.ndarray, chained: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, start in the joined texts, begin of each text); a word has no line break, so no place spans two texts."""
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    found = np.fromiter(automaton.iter("\n".join(texts)), dtype=[("end", np.int64), ("word", np.int64)])
    word, start = found["word"], found["end"] + 1 - sizes[found["word"]]
    if (mine := chained[word]).any():
        some = np.flatnonzero(mine)
        some = some[np.lexsort((start[some], word[some]))]
        keep = ~mine
        keep[some] = _apart(word[some], start[some], sizes[word[some]])
        word, start = word[keep], start[keep]
    return word, start, begins


def _covered(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` positions some place covers."""
    return np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size] > 0


def _scan(texts: DataFrame, key: Column, text: str, words: list[str], emit: Callable, schema: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(sent.value):
            automaton.add_word(word, i)
        automaton.make_automaton()
        sizes = np.array([len(w) for w in sent.value], np.int64)
        chained = np.array([_overlaps_itself(w) for w in sent.value], bool)
        for batch in batches:
            for first, held in _slices(batch):
                yield emit(batch.column(0).slice(first, len(held)), sent.value, sizes, *_places(automaton, sizes, chained, held))

    return texts.where(F.length(text) > 0).select(key.alias("key"), F.lower(text).alias("text")).mapInArrow(run, schema)


def _counted(keys, words, sizes, word, start, begins) -> pa.RecordBatch:
    at = np.searchsorted(begins, start, "right") - 1
    holders = np.bincount(np.unique(word * len(begins) + at) // len(begins), minlength=len(words))
    places = np.bincount(word, minlength=len(words))
    seen = np.flatnonzero(places)
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in seen], pa.string()), pa.array(holders[seen], pa.int64()), pa.array(places[seen], pa.int64())], ["word", "n_texts", "n_places"])


def _spanned(keys, words, sizes, word, start, begins) -> pa.RecordBatch:
    """Spans that touch or overlap as one: what no span covers parts them, and line breaks between texts are not covered."""
    inside = np.concatenate([[False], _covered(start, start + sizes[word], begins[-1] + 1)])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    at = np.searchsorted(begins, begin, "right") - 1
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(begin - begins[at], pa.int32()), pa.array(end - begins[at], pa.int32())], ["key", "start", "end"])


def _celled(keys, words, sizes, word, start, begins) -> pa.RecordBatch:
    """The covered positions of each text as bits, 64 to a cell, and whether the position before a cell is covered."""
    cells = -(-np.diff(begins) // CELL)
    bases = np.concatenate([[0], np.cumsum(cells)])
    at = np.searchsorted(begins, start, "right") - 1
    moved = start - begins[at] + bases[at] * CELL  # each text begins with a cell
    inside = _covered(moved, moved + sizes[word], int(bases[-1]) * CELL)
    bits = np.packbits(inside, bitorder="little").view("<i8")
    before = np.concatenate([[False], inside[CELL - 1 :: CELL][:-1]])
    before[bases[:-1]] = False
    held = np.flatnonzero((bits != 0) | before)  # a cell after a covered position is sent though empty: another row may cover it
    of = np.searchsorted(bases, held, "right") - 1
    cell, before = held - bases[of], before[held].astype(np.int64)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(cell, pa.int32()), pa.array(bits[held], pa.int64()), pa.array(before, pa.int64())], ["key", "cell", "bits", "before"])


def word_places(texts: DataFrame, words: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_texts, n_places): in how many texts, and how often in all, each word is; words in no text have no row."""
    schema, found = "word string, n_texts long, n_places long", None
    for block in _blocks(words, block_words):
        part = _scan(texts, F.lit(0), text, block, _counted, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return texts.sparkSession.createDataFrame([], schema)
    return found.groupBy("word").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_places").alias("n_places"))


def word_spans(texts: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, start, end): the places of any of the words, those of one block merged; ``merge_rows`` merges them across blocks."""
    kind = texts.schema[key].dataType.simpleString()
    schema, found = f"key {kind}, start int, end int", None
    for block in _blocks(words, block_words):
        part = _scan(texts, F.col(key), text, block, _spanned, schema)
        found = part if found is None else found.unionByName(part)
    found = texts.sparkSession.createDataFrame([], schema) if found is None else found
    return found.withColumnRenamed("key", key)


def covered_cells(texts: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, cell, bits, before): the positions of each key that any of the words covers, over all blocks and rows, as bits.

    Bit i of a cell is position ``64 * cell + i``; ``before`` is 1 if the position before the cell is covered. Spans that
    touch or overlap are one run of covered positions, so that bits merge them whatever row they come from, before the shuffle too.
    """
    kind = texts.schema[key].dataType.simpleString()
    schema, found = f"key {kind}, cell int, bits long, before long", None
    for block in _blocks(words, block_words):
        part = _scan(texts, F.col(key), text, block, _celled, schema)
        found = part if found is None else found.unionByName(part)
    found = texts.sparkSession.createDataFrame([], schema) if found is None else found
    return found.groupBy("key", "cell").agg(F.bit_or("bits").alias("bits"), F.max("before").alias("before")).withColumnRenamed("key", key)


def covered_summary(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_spans, n_covered, first_start, last_end) of ``covered_cells``; a key without spans has no row."""
    begins = F.col("bits").bitwiseAND(F.bitwise_not(F.shiftleft("bits", 1).bitwiseOR(F.col("before"))))
    digits = F.bin("bits")
    first = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    at = F.col("cell") * CELL
    return cells.groupBy(key).agg(
        F.sum(F.bit_count(begins)).alias("n_spans"),
        F.sum(F.bit_count("bits")).alias("n_covered"),
        F.min(F.when(F.col("bits") != 0, at + first)).alias("first_start"),
        F.max(F.when(F.col("bits") != 0, at + F.length(digits))).alias("last_end"),
    )


def merge_rows(spans: DataFrame, key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """(key, start, end): spans that arrive as rows, those of a key that touch or overlap as one; a null key is a key."""
    placed = spans.where("start IS NOT NULL AND end IS NOT NULL").select(F.col(key).alias("k"), "start", "end")
    placed = placed.groupBy("k", "start").agg(F.max("end").alias("end")).withColumn("tile", F.floor(F.col("start") / tile))
    in_tile = Window.partitionBy("k", "tile").orderBy("start")
    before = in_tile.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("start") > F.max("end").over(before), 1).otherwise(0)
    pieces = placed.withColumn("opens", opens).withColumn("piece", F.sum("opens").over(in_tile.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = stored(pieces.groupBy("k", "tile", "piece").agg(F.min("start").alias("start"), F.max("end").alias("end")), "pieces")
    earlier = Window.partitionBy("k").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = pieces.groupBy("k", "tile").agg(F.max("end").alias("tile_end"), F.max("start").alias("tile_start"))
    tiles = tiles.withColumn("reach", F.max("tile_end").over(earlier))
    # The pieces of a tile are apart, so if any of them begins an island of its own, the last one does.
    tiles = tiles.withColumn("opened", F.expr("CASE WHEN reach IS NULL OR tile_start > reach THEN tile_start END"))
    tiles = tiles.select(F.col("k").alias("tk"), F.col("tile").alias("tt"), "reach", F.last("opened", True).over(earlier).alias("since"))
    joined = pieces.join(tiles, pieces.k.eqNullSafe(tiles.tk) & (pieces.tile == tiles.tt))
    island = F.expr("CASE WHEN reach IS NULL OR start > reach THEN start ELSE since END")
    return joined.withColumn("island", island).groupBy(F.col("k").alias(key), F.col("island").alias("start")).agg(F.max("end").alias("end"))
