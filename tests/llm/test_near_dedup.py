"""SimHash, covering masks, links and components against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import xxhash

from weftline.llm import simhash
from weftline.llm.components import components


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_every_triple_of_bits_is_missed_by_some_mask():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for bits in combinations(range(64), 3):
        flipped = sum(1 << b for b in bits)
        assert any(m & flipped == 0 for m in masks)


def test_fingerprints_match_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "Two Words", "É É é x", "a b c", "A b\x0bC d E f g"] + [
        " ".join(rng.choice(["Ab", "cd", "Ef", "ñ"]) for _ in range(rng.randrange(1, 60))) for _ in range(50)
    ]
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def test_links_of_small_and_crowded_buckets(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = set(base)
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in prints)
    linked = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = plain_components(signed, linked)
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for limit in (256, 4):
        got = {r.node: r.component for r in components(simhash.links(classes, pair_limit=limit)).collect()}
        assert {p: got.get(p, p) for p in signed} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (7, 6), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    long_text = "word other " * 30_000
    rows = [(5, "same text here now"), (3, "same text here now"), (9, None), (8, ""), (None, "alone in the world"), (4, long_text), (4, long_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component", "3 AS first")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [(i[1], c) for i, c in got] == [(3, 3), (4, 4), (4, 4), (5, 3), (8, 8), (9, 8), (0, None)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 4, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in docs.items()}
    want = plain_components(docs, [(a, b) for a, b in combinations(docs, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = simhash.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
