"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: one Arrow stage, no shuffle. Equal fingerprints are one class before anything is compared.

Candidates: bit i of a fingerprint gets the nonzero vector ``1 + i mod 15`` of GF(2)^4; the mask of v keeps the bits
whose vector has an odd inner product with v. Any three vectors leave some nonzero v orthogonal to all of them, so two
fingerprints that differ in at most three bits agree under at least one of the 15 masks: no link is missed.

Buckets of up to ``PAIR_LIMIT`` classes are compared pair by pair. Members of larger buckets are linked without pairs,
exactly and with bounded work for each of them: x and y differ in at most three bits if and only if some z is within one
bit of x and two bits of y. All x and y that meet at one z form one component if any x is there, so each z links its
visitors in a star. Components are found by star contraction over class representatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.shared import documents, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: A bucket with more classes than this is linked through meeting points: about the same work for each class.
PAIR_LIMIT = 256


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius + 1) - 1 masks, one of which misses any ``radius`` bits; as unsigned integers."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (v & (1 + i % vectors)).bit_count() % 2) for v in range(1, vectors + 1)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned integer; zero where it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change, ASCII space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):  # 4 MB of bits at a time, however long the text
        block = hashes[begin : begin + (1 << 16)]
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(column: str, n: int) -> F.Column:
    """The fingerprint with 0 to n of its bits flipped, as an array."""
    masks = [_signed(sum(1 << i for i in c)) for k in range(n + 1) for c in combinations(range(64), k)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: F.col(column).bitwiseXOR(m))


def links(classes: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(u, v) between distinct fingerprints (column ``fp``): enough links within ``radius`` for all components.

    Buckets up to ``pair_limit`` give every such pair; larger ones (``radius`` 3) give a star for each meeting point.
    """
    spark = classes.sparkSession
    masks = [_signed(m) for m in covering_masks(radius)]
    keyed = classes.select("fp", F.posexplode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseAND(m))).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["t", "key"]), "simhash-buckets")  # only buckets with something to compare

    small = shared.where(F.col("n") <= pair_limit).select("t", "key", "fp")
    other = small.select("t", "key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = small.withColumnRenamed("fp", "u").join(other, ["t", "key"]).where(F.col("u") < F.col("v")).where(near).select("u", "v")

    crowded = shared.where(F.col("n") > pair_limit).select("fp").distinct()
    if radius != RADIUS or crowded.isEmpty():
        if radius != RADIUS and not crowded.isEmpty():
            raise ValueError("meeting points are laid out for radius 3")
        return pairs
    crowded = written(crowded, "simhash-crowded")
    close = crowded.select("fp", F.explode(_flips("fp", 1)).alias("z"))
    centre = written(close.groupBy("z").agg(F.min("fp").alias("u")), "simhash-centres")
    wide = crowded.select("fp", F.explode(_flips("fp", 2)).alias("z"))
    stars = wide.join(centre, "z").where("fp <> u").select(F.col("fp").alias("u"), F.col("u").alias("v")).distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (least id reachable over links within ``radius``).

    Texts without words share fingerprint zero and are linked like any others. Rows with a null id take part, but name
    a component only where all its ids are null. An empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(classes.select("fp"), radius))
    named = classes.join(linked, classes.fp == linked.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = written(named, "simhash-classes")
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    class_of = named.join(heads, "component").select("fp", "component_id")
    return prints.join(class_of, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, whose id names their component: one document of each group stays.

    Only the ids of the documents that go are joined, so that few copies make a small join. Rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def query(spark, sf_dir):
    """op4: all ``documents``."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
