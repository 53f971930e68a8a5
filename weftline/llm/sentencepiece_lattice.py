"""SentencePiece encoding and decoding over a relational lattice.

The lattice of a word is relational: its substrings of bounded length are exploded, joined to the piece table by equality
(the table is a vocabulary file, a fixed broadcast) and grouped back to the word's edges. A higher-order ``aggregate``
folds the edges into ids. For unigram models the fold is Viterbi. For BPE models a best-scoring path is not the library's
segmentation, so the fold replays the merges on the same edges: it removes the boundary inside the best edge that covers
exactly two symbols until none is left.

Words repeat, so the lattice is built once per word of the corpus's heavy vocabulary: all words with at least a
``1 / heavy_words`` share of all occurrences, counted over all documents, hence at most ``heavy_words`` rows. That
dictionary goes to the tasks that hold the texts; documents are never shuffled. Other words are rare, and each task
folds them by the same rules from the same piece table, remembering a bounded number.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.encode import Memory, vocabulary
from weftline.llm.shared import documents, text_or_empty, written

SPACE = "▁"
#: A word with the spaces before it, or the spaces at the end of a text; no piece crosses a word.
WORD = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
#: Bound of the dictionary that is sent to tasks: words with at least one in so many occurrences.
HEAVY_WORDS = 500_000
#: Longer words are folded where they stand.
HEAVY_LENGTH = 32
#: Longer words are merged by a queue, one at a time.
MERGED_LENGTH = 64
#: Rare words that a worker remembers in each of two generations.
MEMO_WORDS = 150_000
BATCH = 512
#: What this process remembers for the dictionary at hand.
_MEMORIES: dict[str, tuple[Memory, Callable]] = {}


@dataclass
class Vocabulary:
    """What a model file says: pieces with ids and scores, the first byte id, and whether the model is BPE."""

    pieces: dict[str, tuple[int, float]]
    byte_base: int
    merges: bool
    spelled: list[bytes]

    @cached_property
    def longest(self) -> int:
        """Characters of the longest piece."""
        return max(map(len, self.pieces), default=1)

    @cached_property
    def unknown(self) -> float:
        """Score of a character outside the vocabulary on a Viterbi path."""
        return min((s for _, s in self.pieces.values()), default=0.0) - 10.0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model; refuses what would not give the library's ids."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            m.ParseFromString(file.read())
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not m.trainer_spec.byte_fallback or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram or BPE models with identity normalisation, a dummy prefix and byte fallback")
        pieces = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses words")
        first = next(i for i, p in enumerate(m.pieces) if p.type == 6)
        if [p.piece for p in m.pieces[first : first + 256]] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("byte pieces are not in order")
        spelled = [p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else b"" for p in m.pieces]
        spelled[first : first + 256] = [bytes([b]) for b in range(256)]
        return cls(pieces, first, m.trainer_spec.model_type == 2, spelled)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score)."""
        return spark.createDataFrame([(p, i, s) for p, (i, s) in self.pieces.items()], "piece string, id int, score double")

    def fold(self, word: str) -> list[int]:
        """The ids of one word, where it stands."""
        symbols = self._merged(word) if self.merges else self._best_path(word)
        out: list[int] = []
        for s in symbols:
            out += [self.pieces[s][0]] if s in self.pieces else [self.byte_base + b for b in s.encode("utf-8", "surrogatepass")]
        return out

    def _merged(self, word: str) -> list[str]:
        if len(word) > MERGED_LENGTH:
            return self._merged_by_queue(word)
        rank, none = self.ranks.get, len(self.pieces)
        parts = list(word)
        ranks = [rank(a + b, none) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)  # the leftmost of equals
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def fold_many(self, words: list[str]) -> list[bytes]:
        """The ids of words as little-endian integers. Those of ``MERGED_LENGTH`` characters at most are merged together,
        one merge in each of them at a time, on arrays of all their symbols."""
        out = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= MERGED_LENGTH] if self.merges else []
        if short:
            for k, ids in zip(short, self._merged_together([words[k] for k in short]), strict=True):
                out[k] = ids
        for k, w in enumerate(words):
            if not out[k] and w:
                out[k] = np.array(self.fold(w), "<i4").tobytes()
        return out

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The symbol of each character (an unknown one is a number of its own), and the pairs that merge: key, rank, symbol."""
        symbol = np.arange(0x110000, dtype=np.int64) + len(self.spelled)
        for piece, (i, _) in self.pieces.items():
            if len(piece) == 1:
                symbol[ord(piece)] = i
        of = lambda s: self.pieces[s][0] if s in self.pieces else int(symbol[ord(s)]) if len(s) == 1 else None
        pairs = {}
        for piece, (i, _) in self.pieces.items():
            for cut in range(1, len(piece)):
                a, b = of(piece[:cut]), of(piece[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) + b] = (self.ranks[piece], i)
        keys = np.array(sorted(pairs), np.int64)
        return symbol, keys, np.array([pairs[k][0] for k in keys.tolist()], np.int64), np.array([pairs[k][1] for k in keys.tolist()], np.int64)

    def _merged_together(self, words: list[str]) -> list[bytes]:
        symbol, keys, ranks, made = self._tables
        none = len(ranks)
        now = symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        place = np.full(len(now), none)  # of the pair that begins here, among all pairs; none ranks last
        rank_of = np.append(ranks, np.iinfo(np.int64).max)

        def look(at: np.ndarray) -> None:
            place[at] = none
            at = at[at < len(now) - 1]
            key = (now[at] << 32) + now[at + 1]
            found = np.minimum(np.searchsorted(keys, key), none - 1)
            place[at] = np.where((keys[found] == key) & (word[at] == word[at + 1]), found, none)

        look(np.arange(len(now)))
        done_word, done_symbol = [], []
        while len(now):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = rank_of[place]
            counts = np.diff(np.append(starts, len(now)))
            best = np.repeat(np.minimum.reduceat(rank, starts), counts)
            over = best == rank_of[none]
            if over.any():  # words without a pair are done
                done_word.append(word[over])
                done_symbol.append(now[over])
                now, word, place, rank, best = (x[~over] for x in (now, word, place, rank, best))
                if not len(now):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]  # the leftmost of equals
            now[at] = made[place[at]]
            kept = np.ones(len(now), bool)
            kept[at + 1] = False
            at = at - np.arange(len(at))  # one symbol less for each merge before
            now, word, place = now[kept], word[kept], place[kept]
            look(at)
            look(at[at > 0] - 1)
        word, now = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        word, now = word[order], now[order]
        if (strange := now >= len(self.spelled)).any():  # characters outside the vocabulary become bytes
            spelled = [[self.byte_base + b for b in chr(s - len(self.spelled)).encode("utf-8", "surrogatepass")] for s in now[strange].tolist()]
            sizes = np.ones(len(now), np.int64)
            sizes[strange] = [len(x) for x in spelled]
            wide = np.repeat(now, sizes)
            wide[np.repeat(strange, sizes)] = np.concatenate([np.array(x) for x in spelled])
            word, now = np.repeat(word, sizes), wide
        data = memoryview(now.astype("<i4").tobytes())
        bounds = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        return [bytes(data[a:b]) for a, b in pairwise(bounds)]

    @cached_property
    def ranks(self) -> dict[str, int]:
        """The order in which pieces merge: best score first, equal scores equal."""
        order = {score: k for k, score in enumerate(sorted({s for _, s in self.pieces.values()}, reverse=True))}
        return {p: order[s] for p, (_, s) in self.pieces.items()}

    def _merged_by_queue(self, word: str) -> list[str]:
        symbols: list[str | None] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(word):
                pair = symbols[left] + symbols[after[left]]
                if pair in self.pieces:
                    heapq.heappush(queue, (-self.pieces[pair][1], left, pair))

        for i in range(len(word) - 1):
            offer(i)
        while queue:
            _, left, pair = heapq.heappop(queue)
            if symbols[left] is None or after[left] >= len(word) or symbols[left] + symbols[after[left]] != pair:
                continue
            gone = after[left]
            symbols[left], symbols[gone] = pair, None
            after[left] = after[gone]
            if after[left] < len(word):
                before[after[left]] = left
            offer(left)
            offer(before[left])
        return [s for s in symbols if s is not None]

    def _best_path(self, word: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = []
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                if piece in self.pieces or end - start == 1:
                    ways.append((best[start][0] + (self.pieces[piece][1] if piece in self.pieces else self.unknown), start))
            best.append(max(ways))
        out, end = [], len(word)
        while end:
            out.append(word[best[end][1] : end])
            end = best[end][1]
        return out[::-1]


def normalised(text: Column) -> Column:
    """The text as the model sees it: spaces escaped, a dummy prefix before anything."""
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(SPACE), F.translate(text, " ", SPACE)))


def lattice(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, edges): for distinct words, the array of edges (score, start, end, id), best first, leftmost of equals first."""
    n = F.length("word")

    def from_start(start: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.least(F.lit(vocab.longest), n - start)),
            lambda size: F.struct(start.alias("start"), (start + size).alias("end"), F.substring(F.col("word"), start + 1, size).alias("piece")),
        )

    cut = words.select("word", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_start))).alias("s")).select("word", "s.*")
    edge = F.struct((-F.col("score")).alias("cost"), "start", "end", "id")
    grouped = cut.join(F.broadcast(vocab.table(words.sparkSession)), "piece").groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    none = F.expr("CAST(array() AS array<struct<cost:double,start:int,end:int,id:int>>)")
    return words.join(grouped, "word", "left").select("word", F.coalesce("edges", none).alias("edges"))


def merge_bounds(word: Column, edges: Column) -> Column:
    """The symbol bounds that BPE merging leaves."""

    def covers_two(bounds: Column, e: Column) -> Column:
        within = F.size(F.filter(bounds, lambda p: (p > e["start"]) & (p < e["end"])))
        return F.array_contains(bounds, e["start"]) & F.array_contains(bounds, e["end"]) & (within == 1)

    def step(bounds: Column, _: Column) -> Column:
        best = F.get(F.filter(edges, lambda e: covers_two(bounds, e)), F.lit(0))
        after = F.transform(F.array(best), lambda b: F.when(b.isNull(), bounds).otherwise(F.filter(bounds, lambda p: (p <= b["start"]) | (p >= b["end"]))))
        return F.get(after, F.lit(0))  # a one-element array, so that the best edge is sought once

    n = F.length(word)
    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)


def viterbi_bounds(word: Column, edges: Column, unknown: float) -> Column:
    """The bounds of the best-scoring path; of equal paths the one whose last piece is shorter, as in ``Vocabulary``."""
    n = F.length(word)

    def step(best: Column, end: Column) -> Column:
        known = F.transform(F.filter(edges, lambda e: e["end"] == end), lambda e: F.struct((F.element_at(best, e["start"] + 1)["score"] - e["cost"]).alias("score"), e["start"].alias("back")))
        single = F.exists(edges, lambda e: (e["end"] == end) & (e["start"] == end - 1))
        other = F.struct((F.element_at(best, end)["score"] + F.lit(unknown)).alias("score"), (end - 1).alias("back"))
        return F.array_append(best, F.array_max(F.when(single, known).otherwise(F.array_append(known, other))))

    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))
    best = F.aggregate(F.sequence(F.lit(1), n), zero, step)
    walk = F.aggregate(
        F.sequence(F.lit(1), n),
        F.array(n),
        lambda bounds, _: F.when(F.get(bounds, F.lit(0)) == 0, bounds).otherwise(F.array_prepend(bounds, F.element_at(best, F.get(bounds, F.lit(0)) + 1)["back"])),
    )
    return walk


def encode_words(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, ids) of distinct non-empty words, by lattice and fold."""
    edges = lattice(words, vocab)
    word, e = F.col("word"), F.col("edges")
    bounds = merge_bounds(word, e) if vocab.merges else viterbi_bounds(word, e, vocab.unknown)
    cut = edges.withColumn("bounds", bounds)

    def ids(i: Column) -> Column:
        start, end = F.element_at("bounds", i), F.element_at("bounds", i + 1)
        found = F.get(F.filter(e, lambda x: (x["start"] == start) & (x["end"] == end)), F.lit(0))
        hexed = F.hex(F.substring(word, start + 1, end - start))
        spelled = F.transform(F.sequence(F.lit(1), F.shiftright(F.length(hexed), 1)), lambda k: F.conv(F.substring(hexed, (k * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("int") + vocab.byte_base)
        return F.when(found.isNull(), spelled).otherwise(F.array(found["id"]))

    return cut.select("word", F.flatten(F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), ids)).alias("ids"))


def heavy_vocabulary(docs: DataFrame, text_col: str, heavy_words: int, heavy_length: int) -> DataFrame:
    """(word): those with at least ``1 / heavy_words`` of all word occurrences of all documents; at most ``heavy_words``."""
    cut = docs.select(F.explode(F.split(text_or_empty(text_col), " ")).alias("word")).where("word <> ''")  # words after one space
    each = cut.select(F.concat(F.lit(SPACE), "word").alias("word"))
    counts = written(each.groupBy("word").agg(F.count("*").alias("n")), "piece-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col("n") * heavy_words >= total) & (F.length("word") <= heavy_length)).select("word")


def encode(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    heavy_words: int = HEAVY_WORDS,
    heavy_length: int = HEAVY_LENGTH,
) -> DataFrame:
    """(doc_id, ids) of every whole text; null and empty texts have no ids; ids of rows may be null or repeat.

    Equal to the library's ``encode``. An empty table gives no rows; other columns are not read.
    """
    coder = Coder.fitted(docs, model_path, text_col, heavy_words, heavy_length)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([batch.column(0), listed(coder.encode(batch.column(1).to_pylist()))], names=["doc_id", "ids"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def listed(ids: list[bytes]) -> pa.Array:
    """Little-endian ids as an array of lists."""
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


@dataclass
class Coder:
    """What a task needs to encode texts: the vocabulary and the ids of the heavy words, which the lattice has given."""

    vocab: Vocabulary
    known: dict[str, bytes]
    token: str

    @classmethod
    def fitted(cls, docs: DataFrame, model_path: str, text_col: str = "text", heavy_words: int = HEAVY_WORDS, heavy_length: int = HEAVY_LENGTH) -> Coder:
        vocab = Vocabulary.load(model_path)
        heavy = encode_words(heavy_vocabulary(docs, text_col, heavy_words, heavy_length), vocab)
        known = {r.word: np.array(r.ids, "<i4").tobytes() for r in heavy.toLocalIterator()}  # at most heavy_words
        return cls(vocab, known, uuid.uuid4().hex)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text; this process remembers the words of one coder."""
        if self.token not in _MEMORIES:
            _MEMORIES.clear()
            _MEMORIES[self.token] = Memory(self.vocab.fold_many, self.known, MEMO_WORDS), re.compile(WORD).findall
        memory, words_of = _MEMORIES[self.token]
        return memory.join([words_of(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts])


def decoded(ids: np.ndarray, spelled: list[bytes]) -> str:
    """The text of ids; only one document's are Python numbers at a time."""
    text = b"".join(map(spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text and text[0] == " " else text


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of the ids; null ids give null, no ids the empty text.

    Byte pieces that form no character become U+FFFD, as in the library; the dummy prefix goes. Other columns pass through;
    a column named decoded is refused.
    """
    spelled = Vocabulary.load(model_path).spelled
    if "decoded" in encoded.columns:
        raise ValueError("there is a column named decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids = batch.column(batch.schema.names.index(ids_col))
                values, bounds, known = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist(), ids.is_valid().to_pylist()
                texts = [decoded(values[bounds[k] : bounds[k + 1]], spelled) if there else None for k, there in enumerate(known)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit(None).cast("string")).schema)


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts to ids and back in one pass: doc_id, ids, n_tokens, decoded_crc32 (of the decoded text in UTF-8).

    Null and empty texts have no ids, and decode to the empty text.
    """
    coder = Coder.fitted(docs, vocabulary("piece_bpe_32k.model"), text_col)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = coder.vocab.spelled
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids = coder.encode(batch.column(1).to_pylist())
                sums = [zlib.crc32(decoded(np.frombuffer(x, "<i4"), spelled).encode()) for x in ids]
                columns = [batch.column(0), listed(ids), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "decoded_crc32"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, decoded_crc32 long")


def query(spark, sf_dir):
    """op2: all ``documents``."""
    return coded(documents(spark, sf_dir))
