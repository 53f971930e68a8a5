"""The cache's run from reuse distances equals a cache that is run."""

from __future__ import annotations

import random
from collections import OrderedDict

import numpy as np
import pytest

from weftline.operators import lru


def run(keys: list[str], size: int) -> tuple[list[bool], list[str]]:
    """Hits, and what is held at the end, the last used first."""
    held, hits = OrderedDict(), []
    for key in keys:
        hits.append(key in held)
        if key not in held and len(held) == size:
            held.popitem(last=False)
        held[key] = True
        held.move_to_end(key)
    return hits, list(held)[::-1]


@pytest.mark.parametrize("size, segment", [(1, 40), (7, 16), (7, 100), (50, None), (3, 1)])
def test_run_equals_a_cache(spark, size, segment):
    draw = random.Random(size)
    keys = ["hot" if draw.random() < 0.33 else f"k{int(draw.expovariate(0.08))}" for _ in range(300 if segment != 1 else 40)]
    rows = [(i, k, "x") for i, k in enumerate(keys)] + [(7, None, "null")]
    draw.shuffle(rows)
    found = lru.lru(spark.createDataFrame(rows, "n long, text string, own string").repartition(3), ["n"], "text", size, segment)
    hits, held = run(keys, size)
    assert [(r["key"], r["hit"]) for r in found.accesses.orderBy("n").collect()] == list(zip(keys, hits, strict=True))
    assert [r["key"] for r in found.contents.orderBy("rank").collect()] == held


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "n long, text string")
    found = lru.lru(none, ["n"], "text", 2)
    assert found.accesses.count() == found.contents.count() == 0
    with pytest.raises(ValueError):
        lru.lru(none, ["n"], "text", 0)
    with pytest.raises(ValueError):
        lru.lru(none.withColumnRenamed("n", "at"), ["at"], "text", 2)


def test_smaller_before():
    values = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5])
    assert lru._smaller_before(values).tolist() == [sum(x < v for x in values[:i]) for i, v in enumerate(values)]
