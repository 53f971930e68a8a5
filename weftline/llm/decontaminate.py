"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows: runs of ``window`` words, and whole items that are shorter. All patterns of
one length share a shift table on blocks of ``BLOCK`` words. The scan looks at the block that ends where a window
would end: a block that occurs in no pattern lets it skip ``length - BLOCK + 1`` words at once, a block that ends some
pattern selects the bucket of patterns with that suffix, and their words are compared directly. Texts stay in the task
that reads them: one narrow stage, no shuffle.

The tables are built on the driver from a bounded block of benchmark rows and sent with the scan. A benchmark larger
than ``block_bytes`` is taken in several blocks, one scan of all documents after another; each but the first writes the
hits of the few texts that have any, and the last scan joins them, so that no worker ever holds the tables of two blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import documents, written

WINDOW = 10
BLOCK = 2
#: Bytes of benchmark text whose windows make one set of tables; a worker holds about 100 bytes for each of them.
BLOCK_BYTES = 1_000_000

#: Lower-cases A-Z, keeps 0-9, a-z and all non-ASCII bytes, and makes every other byte a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class PatternSet:
    """Wu-Manber tables for all patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length = length
        self.block = min(BLOCK, length)
        self.farthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[int]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.farthest), length - end)
            self.bucket[pattern[length - self.block :]].append((pattern, items))

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence."""
        length, block, shift, farthest = self.length, self.block, self.shift.get, self.farthest
        end, n = length, len(words)
        while end <= n:
            suffix = tuple(words[end - block : end])
            skip = shift(suffix, farthest)
            if skip == 0:
                begin = end - length
                for pattern, items in self.bucket[suffix]:
                    if words[begin] == pattern[0] and tuple(words[begin:end]) == pattern:
                        yield begin, items
                skip = 1
            end += skip


def build(items: list[tuple[str, str | None]], window: int) -> list[PatternSet]:
    """The tables of a bounded list of (item_id, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(dict)
    for item, text in items:
        words = words_of(text)
        if words:
            length = min(window, len(words))
            for pattern in {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}:
                by_length[length].setdefault(pattern, []).append(item)
    return [PatternSet(length, patterns) for length, patterns in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans with the same cover."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _scanner(sets: list[PatternSet], text_col: str):
    """An Arrow function that adds the hits of one block of the benchmark to the columns ``__wm_*``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = dict(zip(names, batch.columns, strict=True))
            counts, spans_out, items_out = [], [], []
            before = zip(column["__wm_spans"].to_pylist(), column["__wm_items"].to_pylist(), strict=True)
            for text, (spans, items) in zip(column[text_col].to_pylist(), before, strict=True):
                words = words_of(text)
                found, hit = set(items), list(span_pairs(spans))
                for patterns in sets:
                    for begin, owners in patterns.scan(words):
                        hit.append((begin, begin + patterns.length))
                        found.update(owners)
                counts.append(len(words))
                spans_out.append([x for span in merged(hit) for x in span])
                items_out.append(sorted(found))
            column["__wm_words"] = pa.array(counts, pa.int64())
            column["__wm_spans"] = pa.array(spans_out, pa.list_(pa.int64()))
            column["__wm_items"] = pa.array(items_out, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names=names)

    return run


def span_pairs(flat: list[int]) -> Iterator[tuple[int, int]]:
    """(begin, end) pairs of a flat list."""
    return zip(flat[::2], flat[1::2], strict=True)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's rows in blocks of about ``block_bytes`` bytes; the driver holds one at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator(prefetchPartitions=False):
        if row[0] is None or not row[1]:
            continue
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with three columns more: ``__wm_words`` (number of words), ``__wm_spans`` (the hit words as a flat list of
    begin, end, ... of disjoint spans) and ``__wm_items`` (items with occurring windows, as strings, sorted).

    Null and empty texts have no words and no hits; so have all texts where the benchmark is empty. Benchmark rows with a
    null id or without words are no items; repeated items count once. All columns of ``docs`` are carried along as they
    are; only names that begin with ``__wm_`` are taken.
    """
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks, [])
    key = F.unhex(F.md5(F.col(text_col).cast("string")))
    spans, items = F.expr("CAST(array() AS array<bigint>)"), F.expr("CAST(array() AS array<string>)")
    later = [_hits(docs.select(key.alias("key"), F.col(text_col).alias("text")), build(block, window)) for block in blocks]
    if not later:
        out = docs.withColumns({"__wm_words": F.lit(0).cast("long"), "__wm_spans": spans, "__wm_items": items})
    else:
        by_text = reduce(DataFrame.union, later).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # a row for each block at most
        by_text = by_text.select(F.col("key").alias("__wm_key"), F.col("spans").alias("__wm_spans"), F.col("items").alias("__wm_items"))
        out = docs.withColumns({"__wm_words": F.lit(0).cast("long"), "__wm_key": key}).join(by_text, "__wm_key", "left").drop("__wm_key")
        out = out.withColumns({"__wm_spans": F.coalesce("__wm_spans", spans), "__wm_items": F.coalesce("__wm_items", items)})
    return out.mapInArrow(_scanner(build(first, window), text_col), out.schema)


def _hits(texts: DataFrame, sets: list[PatternSet]) -> DataFrame:
    """(key, spans, items) of the texts (key, text) that one block hits, a written table; equal texts once."""
    none = {"__wm_words": F.lit(0).cast("long"), "__wm_spans": F.expr("CAST(array() AS array<bigint>)"), "__wm_items": F.expr("CAST(array() AS array<string>)")}
    wide = texts.withColumns(none)
    found = wide.mapInArrow(_scanner(sets, "text"), wide.schema).where(F.size("__wm_items") > 0)
    return written(found.select("key", F.col("__wm_spans").alias("spans"), F.col("__wm_items").alias("items")).dropDuplicates(["key"]), "benchmark-hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no window of the benchmark."""
    return find_contamination(docs, benchmark, **options).where(F.size("__wm_items") == 0).select(*docs.columns)


def query(spark, sf_dir):
    """op7: all ``documents`` against all ``benchmark`` items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    spans = F.col("__wm_spans")
    # the hit words of disjoint spans: every end less every begin
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    listed = F.array_join("__wm_items", ",")
    return found.select(
        "doc_id",
        F.col("__wm_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__wm_items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS pat
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT k FROM p),
wins AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS pat
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)
),
hits AS (SELECT doc_id, item_id, i, p.k AS k FROM wins JOIN p ON wins.pat = p.pat AND wins.k = p.k),
pos AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
