"""Phrases whose words keep company, per language: counted exactly, found through a sketch of all phrases.

Three steps, all of them scans of the texts that carry little:

1. *Sketch.* Every phrase of up to three words falls into one of 2^64 cells by a hash of its words and language. Tasks sum
   the cells of a few megabytes of text, cut them by range into blocks and shuffle the blocks; each block is added up on
   its own. A cell's sum is an upper bound of the count of each phrase in it, and only cells of ``LEAST`` and more go on.
   Phrases of three words are sketched after those of two, and only where both of their halves go on: a bitmap of fixed
   size (``BITS``) says so to all tasks; what it lets through by chance costs work, not results.
2. *Candidates.* One more scan gives the words of the cells that go on, each from one place that is known to have it, so that
   no phrase is sent twice. From the upper bounds follow bounds of the scores,
   and from these the phrases that can be among the first ``top`` of their language, with a margin, the longer phrases
   that may put them out, and their parts. There are a few times ``top`` of them, however large the corpus.
3. *Count.* They become Aho-Corasick automata of at most ``PATTERNS`` phrases, one per language, each phrase between
   spaces and each end of a piece marked, so that overlapping phrases all match and none matches inside a word. The texts
   are scanned once per automaton, counts are summed, and all thresholds, scores and ranks are made from these counts.

The ranking is complete if ``top`` counted phrases are no worse than the bound of the best phrase that was not counted;
else the margin is widened and the third step repeated. The bounds of a score divide by upper bounds of the parts' counts,
so they hold as long as no cell that matters holds two phrases; with 64 bits, one cell in about 10^19 / (number of phrases)
does. Counts, scores and ranks themselves are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.shared import bounded, documents, written

LEAST, TOP = 10, 2000
#: A phrase goes if a longer one around it has this share of its occurrences, in hundredths.
SHARE = 50
#: The bitmap of cells that go on has 2^BITS bits.
BITS = 27
#: Text, in bytes, whose cells a task sums before it sends them on, and text of one block of the sketch.
FLUSH, BLOCK = 8_000_000, 8_000_000
#: Text, in bytes, and rows that are taken apart at a time.
PART, ROWS = 1_000_000, 1024
#: Phrases of one automaton, and candidates beyond ``top`` that are counted at first, in hundredths of ``top``.
PATTERNS, MARGIN = 200_000, 125
#: Parts of a language that are ranked on their own first.
DEALT = 64

_SPACE, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_ROUNDS = 12

_rng = np.random.default_rng(42)
#: A number for each byte at each place in a word; delimiters add nothing.
_PLACES = _rng.integers(0, 1 << 64, (64, 256), np.uint64)
_PLACES[:, list(_SPACE + _BREAK)] = 0
_FACTORS = _rng.integers(0, 1 << 64, 4, np.uint64) | np.uint64(1)
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACE)], _KIND[list(_BREAK)] = 1, 2
#: Lower case, one kind of space, one kind of break.
_PLAIN = bytes(0x20 if c in _SPACE else 0x0A if c in _BREAK else c for c in bytes(range(256)).lower())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a text of one language: where they are, whether the next one is in the same piece, and the cells of phrases."""

    def __init__(self, blob: bytes, lang: str):
        self.data = blob.lower()  # ASCII only
        b = np.frombuffer(self.data, np.uint8)
        word = np.zeros(len(b) + 2, np.int8)
        word[1:-1] = _KIND[b] == 0
        edge = np.diff(word)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.append(0, np.cumsum(_KIND[b] == 2, dtype=np.int32))
        self.pair = breaks[self.ends[:-1]] == breaks[self.starts[1:]]  # words i and i + 1
        self.triple = self.pair[:-1] & self.pair[1:]
        self.hashes = np.zeros(0, np.uint64)
        if len(self.starts):
            at = self.starts[0]
            place = np.arange(at, len(b), dtype=np.int32) - np.repeat(self.starts, np.diff(np.append(self.starts, len(b)))).astype(np.int32)
            self.hashes = np.add.reduceat(_PLACES.ravel()[((place & 63) << 8) + b[at:]], self.starts - at)
        self.salt = np.uint64(xxhash.xxh64_intdigest(lang.encode()))

    def cells(self, n: int) -> np.ndarray:
        """The cell of the phrase of ``n`` words that starts at each word, whether or not it stays in one piece."""
        count = max(len(self.hashes) - n + 1, 0)
        h = np.full(count, self.salt + np.uint64(n))
        for k in range(n):
            h = h + _mixed(self.hashes[k : k + count]) * _FACTORS[k]
        return _mixed(h) & ~np.uint64(1) | np.uint64(n == 1)  # odd for words

    def whole(self, n: int) -> np.ndarray:
        """Where phrases of ``n`` words stay in one piece."""
        return np.ones(len(self.starts), bool) if n == 1 else self.pair if n == 2 else self.triple

    def phrase(self, at: int, n: int) -> str:
        """The phrase of ``n`` words from word ``at``."""
        return b" ".join(self.data[self.starts[i] : self.ends[i]] for i in range(at, at + n)).decode()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, texts with line breaks between) of a batch (lang, text), about ``PART`` bytes at a time."""
    for lang in pc.unique(batch.column(0)).to_pylist():
        texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PART, "right")))
            part = texts.slice(at, to - at)
            yield lang, pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "\n")[0].as_buffer().to_pybytes()
            at = to


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.uint64, str, bytes, bool]]:
    """(flush, lang, texts, last): texts as ``_by_language`` gives them, the number of the flush that they belong to, whether it ends with them.

    A flush is about ``FLUSH`` bytes of one task; it has the same number and texts in every scan of the same plan.
    """
    own, at, size, held = TaskContext.get().partitionId() << 24, 0, 0, None
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for lang, blob in _by_language(batch.slice(start, ROWS)):
                if held is not None:
                    yield np.uint64(own + at), *held, size >= FLUSH
                    if size >= FLUSH:
                        at, size = at + 1, 0
                held, size = (lang, blob), size + len(blob)
    if held is not None:
        yield np.uint64(own + at), *held, True


def _known(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the cells."""
    bit = cells >> np.uint64(64 - BITS)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _in_flush(cells: np.ndarray, flush: np.uint64) -> np.ndarray:
    """A key for each cell in a flush."""
    return cells ^ (np.atleast_1d(flush) * _FACTORS[3])


def _sketch(texts: DataFrame, blocks: int, sizes: tuple[int, ...], halves=None) -> DataFrame:
    """(cell, n, key) of the cells of phrases of these sizes with ``LEAST`` or more, and a key of the cell in one flush that has it; with ``halves``, a broadcast bitmap, only of those whose halves it has.

    ``blocks`` is a power of two.
    """
    shift = np.uint64(64 - blocks.bit_length() + 1)

    def summed(cells: list[np.ndarray], flush: np.uint64) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(cells), return_counts=True)
        block = (found >> shift).astype(np.int64) if blocks > 1 else np.zeros(len(found), np.int64)
        at = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(found)) if len(found) else np.zeros(1, np.int64)
        parts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        columns = {
            "block": pa.array(block[at[:-1]], pa.int64()),
            "flush": pa.array([int(flush)] * len(parts), pa.int64()),
            "cells": pa.array([found[i:j].tobytes() for i, j in parts], pa.binary()),
            "counts": pa.array([n[i:j].astype("<u4").tobytes() for i, j in parts], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held = None if halves is None else np.frombuffer(halves.value, np.uint64), []
        for flush, lang, blob, last in _flushes(batches):
            words = Words(blob, lang)
            for n in sizes:
                whole = words.whole(n)
                if bitmap is not None:
                    half = _known(bitmap, words.cells(n - 1))
                    whole = whole & half[:-1] & half[1:]
                held.append(words.cells(n)[whole])
            if last:
                yield summed(held, flush)
                held = []

    def added(table: pa.Table) -> pa.Table:
        cells = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("cells")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")])
        flush = np.repeat(table.column("flush").to_numpy(), [len(x.as_buffer()) // 8 for x in table.column("cells")])
        order = np.argsort(cells, kind="stable")
        cells, counts, flush = cells[order], counts[order].astype(np.int64), flush[order]
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        sums = np.add.reduceat(counts, first)
        heavy = sums >= LEAST
        return pa.table({"cell": pa.array(cells[first][heavy].view(np.int64)), "n": pa.array(sums[heavy]), "key": pa.array(_in_flush(cells[first], flush[first].view(np.uint64))[heavy].view(np.int64))})

    return texts.mapInArrow(run, "block long, flush long, cells binary, counts binary").groupBy("block").applyInArrow(added, "cell long, n long, key long")


def _bitmap(cells: DataFrame, key: str):
    """The bitmap of a column of ``cells``, a broadcast of fixed size."""
    bit = F.shiftrightunsigned(key, 64 - BITS)
    words = cells.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^(BITS - 6) rows
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return cells.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def _phrases(texts: DataFrame, chosen, anywhere: bool = False) -> DataFrame:
    """(cell, lang, phrase, x, y, z, w) of phrases of two and three words; ``chosen``, a broadcast bitmap, says which cells in which flush, or, if ``anywhere``, in all.

    x and y are the cells of the parts after a cut behind the first word, z and w after one behind the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, sent = np.frombuffer(chosen.value, np.uint64), np.zeros(0, np.uint64)
        for flush, lang, blob, last in _flushes(batches):
            words = Words(blob, lang)
            one, two, three = (words.cells(n) for n in (1, 2, 3))
            for n, cells in ((2, two), (3, three)):
                at = np.flatnonzero(words.whole(n) & _known(bitmap, cells if anywhere else _in_flush(cells, flush)))
                at = at[np.unique(cells[at], return_index=True)[1]]
                at = at[~np.isin(cells[at], sent)]
                sent = np.concatenate([sent, cells[at]])
                columns = {"cell": cells[at], "x": one[at], "y": one[at + 1]} if n == 2 else {"cell": cells[at], "x": one[at], "y": two[at + 1], "z": two[at], "w": one[at + 2]}
                arrays = {k: pa.array(v.view(np.int64)) for k, v in columns.items()} | {k: pa.nulls(len(at), pa.int64()) for k in "xyzw" if k not in columns}
                arrays |= {"lang": pa.array([lang] * len(at), pa.string()), "phrase": pa.array([words.phrase(i, n) for i in at.tolist()], pa.string())}
                yield pa.RecordBatch.from_pydict({k: arrays[k] for k in ("cell", "lang", "phrase", "x", "y", "z", "w")})
            if last:
                sent = np.zeros(0, np.uint64)

    return texts.mapInArrow(run, "cell long, lang string, phrase string, x long, y long, z long, w long")


def _counted(texts: DataFrame, patterns: DataFrame, size: int) -> DataFrame:
    """(id, n): how often each pattern (id, lang, phrase) occurs, and with id null how many words each language has."""
    shards = -(-size // PATTERNS) if size else 1

    def scan(shard: int) -> DataFrame:
        own = patterns.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)) == shard).select("id", "lang", "phrase").toArrow()  # about PATTERNS rows
        words: dict[str, tuple[list[int], list[str]]] = {}
        for i, lang, phrase in zip(*(c.to_pylist() for c in own.columns), strict=True):
            ids, phrases = words.setdefault(lang, ([], []))
            ids.append(i)
            phrases.append(phrase)

        def automaton(phrases: list[str]):
            import ahocorasick

            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, phrase in enumerate(phrases):
                made.add_word(f" {phrase} ", k)
            made.make_automaton()
            return made

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, counts, totals = {}, {}, {}
            for batch in batches:
                for lang, blob in _by_language(batch):
                    line = b" " + re.sub(b"  +", b" ", re.sub(b" *\n[ \n]*", b" \n ", blob.translate(_PLAIN))) + b" "
                    b = np.frombuffer(line, np.uint8)
                    in_word = (b != 0x20) & (b != 0x0A)
                    totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(in_word[1:] & ~in_word[:-1]))
                    if lang not in words:
                        continue
                    if lang not in made:
                        made[lang] = automaton(words[lang][1])
                        counts[lang] = np.zeros(len(words[lang][0]), np.int64)
                    hits = np.fromiter(map(itemgetter(1), made[lang].iter(line.decode())), np.int64)
                    counts[lang] += np.bincount(hits, minlength=len(counts[lang]))
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"id": pa.array(np.array(words[lang][0], np.int64)[at]), "lang": pa.array([lang] * len(at), pa.string()), "n": pa.array(n[at])})
            if shard == 0 and totals:
                yield pa.RecordBatch.from_pydict({"id": pa.nulls(len(totals), pa.int64()), "lang": pa.array(list(totals), pa.string()), "n": pa.array(list(totals.values()), pa.int64())})

        return texts.mapInArrow(run, "id long, lang string, n long")

    each = scan(0)
    for shard in range(1, shards):
        each = each.unionByName(scan(shard))
    return each.groupBy("id", "lang").agg(F.sum("n").alias("n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (left right)), at most 1000000 for true counts; products have up to 38 digits."""
    wide = "decimal(38,0)"
    over = F.lit(1_000_000).cast("decimal(7,0)") * a.cast("decimal(15,0)") * a.cast("decimal(15,0)")
    under = left.cast("decimal(19,0)") * right.cast("decimal(19,0)")
    return F.call_function("div", over.cast(wide), under.cast(wide))


def _key(score: str = "score", a: str = "a", phrase: str = "phrase") -> Column:
    """What phrases are ordered by."""
    return F.struct((-F.col(score)).alias("score"), (-F.col(a)).alias("a"), F.col(phrase).alias("phrase"))


def _bounds(texts: DataFrame, many: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, phrase, cell, a, score): bounds of the count and the score of each phrase of the cells ``many``; a written table.

    Should a scan deal the texts to tasks in another way than the one before, places that had a cell lack it. That shows in the
    number of cells, and the words are then taken from all places.
    """
    wanted = many.count()
    for key in ("key", "cell"):
        phrases = _phrases(texts, _bitmap(many, key), key == "cell").dropDuplicates(["cell", "lang", "phrase"])
        found = written(_sides(written(phrases, "phrase-words"), sums), "phrase-bounds")
        if found.select("cell").distinct().count() == wanted:
            break
    return found


def _sides(phrases: DataFrame, sums: DataFrame) -> DataFrame:
    """``phrases`` with the bounds that follow from ``sums``; those whose own cell is not in it are left out."""
    parts = phrases.select("cell", "lang", "phrase", F.explode(F.array(*(F.struct(F.lit(c).alias("role"), F.col(c).alias("part")) for c in ("cell", "x", "y", "z", "w")))).alias("p"))
    known = parts.select("cell", "lang", "phrase", "p.*").where("part IS NOT NULL").join(sums.select(F.col("cell").alias("part"), "n"), "part")
    sides = known.groupBy("lang", "phrase", "cell").agg(*(F.max(F.when(F.col("role") == c, F.col("n"))).alias(f"n_{c}") for c in ("cell", "x", "y", "z", "w")))
    found = sides.where("n_cell IS NOT NULL").withColumnRenamed("n_cell", "a")
    first, second = _score(F.col("a"), F.col("n_x"), F.col("n_y")), _score(F.col("a"), F.col("n_z"), F.col("n_w"))
    return found.select("lang", "phrase", "cell", "a", F.least(first, second).alias("score"))  # least leaves out nulls


def _halves(phrase: Column) -> Column:
    """Both halves of a phrase of three words, as an array."""
    return F.array(F.regexp_extract(phrase, "^(.*) [^ ]*$", 1), F.regexp_extract(phrase, "^[^ ]* (.*)$", 1))


def _longer(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer, n_longer): for each phrase inside candidates of three words, one row for each of those; ``phrases`` has lang, phrase, a."""
    return phrases.where(_words(F.col("phrase")) == 3).select("lang", F.explode(_halves(F.col("phrase"))).alias("part"), F.col("phrase").alias("longer"), F.col("a").alias("n_longer")).withColumnRenamed("part", "phrase")


def _words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank: of ``DEALT`` parts of it first, so that one language is many tasks."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def _exact(wanted: DataFrame, patterns: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the ``wanted`` phrases (lang, phrase) that stay; ``patterns`` (lang, phrase, a) has exact counts of them, their parts and longer ones."""
    counts = patterns.select("lang", "phrase", "a")
    own = wanted.join(counts, ["lang", "phrase"]).where(F.col("a") >= LEAST)
    cuts = own.select("lang", "phrase", "a", F.posexplode(F.split("phrase", " ")).alias("k", "word")).where("k > 0")
    head, tail = F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " "), F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.lit(2)), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", head.alias("head"), tail.alias("tail"))
    for side, n in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(n)), ["lang", side])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longest = _longer(counts.where(F.col("a") >= LEAST)).groupBy("lang", "phrase").agg(F.max("n_longer").alias("n_longer"))
    left = best.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("n_longer") < SHARE * F.col("a"), F.lit(True)))
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, margin: int = MARGIN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Null texts are empty, null languages are ``und``. Other columns are not read, so no name can clash. Repeated rows count
    again. Languages without phrases, and empty tables, have no rows.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = 1 << max(4, (size // BLOCK).bit_length())

    pairs = written(_sketch(texts, blocks, (1, 2)), "phrase-pairs")
    triples = written(_sketch(texts, blocks, (3,), _bitmap(pairs, "cell")), "phrase-triples")
    sums = pairs.union(triples)
    many = sums.where("cell % 2 = 0")
    found = _bounds(texts, many, sums)

    longest = _longer(found).groupBy("lang", "phrase").agg(F.max("n_longer").alias("n_longer"))
    judged = found.join(longest, ["lang", "phrase"], "left").select("lang", "phrase", "a", "score", F.coalesce(100 * F.col("n_longer") >= SHARE * F.col("a"), F.lit(False)).alias("gone"))
    judged = written(judged, "phrase-judged")
    for _ in range(_ROUNDS):
        much = top * margin // 100
        last = _ranked(judged.where("NOT gone"), much).where(F.col("rank") == much).select("lang", _key().alias("last"))
        last = written(last, "phrase-last")
        wanted = written(judged.join(bounded(last), "lang", "left").where(F.col("last").isNull() | (_key() <= F.col("last"))).select("lang", "phrase", "a"), "phrase-wanted")
        near = _longer(judged).join(wanted.select("lang", "phrase", "a"), ["lang", "phrase"]).where("4 * n_longer >= a").select("lang", F.col("longer").alias("phrase"))
        each = wanted.select("lang", "phrase").union(near)
        part = F.when(_words(F.col("phrase")) == 3, F.concat(_halves(F.col("phrase")), F.split("phrase", " "))).otherwise(F.split("phrase", " "))
        patterns = each.union(each.select("lang", F.explode(part))).distinct()
        patterns = written(patterns.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase"), "phrase-patterns")  # written: the numbers stay
        counts = written(_counted(texts, patterns, patterns.count()), "phrase-counts")
        known = patterns.join(counts.drop("lang"), "id").select("lang", "phrase", F.col("n").alias("a"))
        ranked = written(_ranked(_exact(wanted.select("lang", "phrase"), known), top), "phrase-ranked")
        reached = ranked.join(bounded(last), "lang").where(_key() <= F.col("last")).groupBy("lang").agg(F.count("*").alias("sure"))
        if not last.join(reached, "lang", "left").where(F.coalesce("sure", F.lit(0)) < top).head(1):
            totals = counts.where("id IS NULL").select("lang", F.col("n").alias("total"))
            return ranked.join(bounded(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
        margin *= 4
    raise RuntimeError(f"the ranking was not complete after {_ROUNDS} rounds")


def query(spark, sf_dir):
    """op11: all ``documents``."""
    return collocations(documents(spark, sf_dir).select("text", "lang"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, ws FROM (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)) WHERE len(ws) > 0
),
w AS (SELECT lang, piece, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM pieces),
g AS (SELECT lang, word AS w1, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY lang, piece ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS c FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS c FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.c AS a, 1 AS k, x.c AS l, y.c AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2 WHERE f2.c >= 10
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.c, 1, x.c, y.c FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.c, 2, x.c, y.c FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(c) AS c FROM (SELECT lang, w1 || ' ' || w2 AS phrase, c FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, c FROM f3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase WHERE longer.c IS NULL OR 100 * longer.c < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
"""
