"""What a least-recently-used cache does over a table of accesses, without running it from first to last.

An access hits if its key was used before and fewer than ``max_size`` other keys have been used since (its reuse distance).
The accesses are numbered and cut into segments. A segment's end is known by its last ``max_size`` distinct keys, and two
neighbours make one such list, so the lists of all prefixes come from joins in a logarithmic number of rounds. With the list
before it in front, each segment finds the reuse distances of its own accesses by merge counting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.sizing import stored
from weftline.operators.store import numbered

#: Accesses in a segment, and at least so many times the cache's size.
SEGMENT, TIMES = 65_536, 8


@dataclass(frozen=True)
class CacheRun:
    """``accesses`` (the order's columns, key, hit) and ``contents`` (key, rank): what is held at the end, the last used first."""

    accesses: DataFrame
    contents: DataFrame


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each element how many before it are smaller: halves of blocks of each power of two, merged in order of value."""
    found, by_value = np.zeros(len(values), np.int64), np.lexsort((-np.arange(len(values)), values))  # equal ones backwards
    for bit in range(max(len(values) - 1, 0).bit_length()):
        at = by_value[np.argsort(by_value >> (bit + 1), kind="stable")]  # by block, then by value
        left, block = (at >> bit) & 1 == 0, at >> (bit + 1)
        lefts = np.cumsum(left)
        before = (lefts - left)[np.searchsorted(block, block)]
        found[at] += np.where(left, 0, lefts - before)
    return found


def _distances(keys: pa.ChunkedArray) -> np.ndarray:
    """Distinct other keys since the last use of each key in a sequence; -1 for a first use."""
    codes = keys.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    last = np.full(len(codes), -1)
    same = codes[order[1:]] == codes[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    return np.where(last < 0, -1, _smaller_before(last) - last - 1)


def _recent(rows: DataFrame, max_size: int) -> DataFrame:
    """(segment, key, at): of rows like these the ``max_size`` keys of each segment that were used last."""
    uses = rows.groupBy("segment", "key").agg(F.max("at").alias("at"))
    last = Window.partitionBy("segment").orderBy(F.desc("at"))
    return uses.withColumn("n", F.row_number().over(last)).where(F.col("n") <= max_size).drop("n")


def lru(accesses: DataFrame, order: list[str], key: str, max_size: int = 1000, segment: int | None = None) -> CacheRun:
    """The run of a cache of ``max_size`` keys that starts empty: a miss puts its key in and, when full, the least recently used one out.

    Accesses are taken by ``order``, then by key; those with a null key look nothing up and go. Columns but these are not
    carried. ``segment`` bears on work only; ``order`` has no column named key, at, segment, hit or own.
    """
    if max_size < 1:
        raise ValueError("a cache holds one key at least")
    if taken := {"key", "at", "segment", "hit", "own"} & set(order):
        raise ValueError(f"columns are named {sorted(taken)}")
    size = segment or max(SEGMENT, TIMES * max_size)
    known = accesses.select(*order, F.col(key).alias("key")).where("key IS NOT NULL")
    placed = numbered(known, 0, [*order, "key"], "at").withColumn("segment", F.floor(F.col("at") / size))
    placed = stored(placed, "accesses")
    reach, last = 1, placed.agg(F.max("segment")).first()[0] or 0
    states = stored(_recent(placed, max_size), "states")
    while reach <= last:
        moved = states.withColumn("segment", F.col("segment") + reach).where(F.col("segment") <= last)
        states = stored(_recent(states.unionByName(moved), max_size), "states")
        reach *= 2

    columns = [*placed.columns, "hit"]

    def judged(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        distance = _distances(rows["key"])
        hit = pa.array((distance >= 0) & (distance < max_size))
        return rows.append_column("hit", hit).filter(rows["own"]).select(columns)

    before = states.select((F.col("segment") + 1).alias("segment"), "key", "at").where(F.col("segment") <= last)
    rows = placed.withColumn("own", F.lit(True)).unionByName(before.withColumn("own", F.lit(False)), allowMissingColumns=True)
    shape = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes)
    found = rows.groupBy("segment").applyInArrow(judged, shape + ", hit boolean")
    newest = Window.orderBy(F.desc("at"))  # max_size rows
    contents = states.where(F.col("segment") == last).select("key", F.row_number().over(newest).alias("rank"))
    return CacheRun(found.select(*order, "key", "hit"), contents)
