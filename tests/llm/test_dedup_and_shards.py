"""Exact deduplication and sharding: brute force and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from weftline.llm import exact_dedup, sharding

ROWS = [
    (5, "a b"), (3, "a \t\n b"), (9, "a b"), (1, None), (2, ""), (4, " "), (8, "  \x0b"), (None, "a b"), (None, "lonely"), (7, "x " * 60_000), (6, "x " * 60_000), (6, "x " * 60_000), *[(100 + i, "hot") for i in range(200)],
]


def check_dedup(spark, **options):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS keep_id", "3 AS group_size", "4 AS item").repartition(5)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, **options).collect())) == want
    assert exact_dedup.exact_dedup(docs.limit(0), **options).count() == 0


def test_groups_of_equal_texts(spark):
    check_dedup(spark)


def test_a_tiny_sketch_changes_nothing(spark):
    check_dedup(spark, heavy_capacity=1, sketch_capacity=8)


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t" * (i % 7), "hot" if i % 3 else f"s{i % 12}" if i % 12 else None) for i in range(3001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS shard", "3 AS slot").repartition(6)
    got = sharding.interleave(docs, 16).collect()
    assert sorted(r.doc_id for r in got) == list(range(3001))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    source = {i: s for i, _, s in rows}
    total = Counter(source.values())
    for s in sizes:
        own = Counter(source[r.doc_id] for r in got if r.shard == s)
        for name, n in total.items():
            assert abs(own[name] - n / 16) <= 2
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (r.doc_id % 7 + 1, zlib.crc32(b"t" * (r.doc_id % 7)), "rows", None)
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs.repartition(3), 16).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}
    assert again != {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs, 16, seed="other").collect()}


def test_many_small_sources_reach_every_shard(spark):
    rows = [(i, "t", "large" if i < 4000 else f"small{i}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small = Counter(r.shard for r in sharding.interleave(docs, 16).collect() if r.doc_id >= 4000)
    assert all(200 < small[s] < 300 for s in range(16))


def test_odd_rows_are_placed_once(spark):
    rows = [(None, None, None), (None, None, None), (1, "", ""), (1, "", ""), (2, "long " * 50_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(docs, 3).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [1, 2, 2]
    assert sharding.interleave(docs, 16).count() == 5
    assert sharding.interleave(docs.limit(0), 16).count() == 0
