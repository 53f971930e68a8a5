"""Near copies of the pipeline against brute force on five-word shingles."""

from __future__ import annotations

import random
from itertools import combinations

from test_near_dedup import plain_components, plain_print

import corpus_pipeline
from weftline.llm import near_copies, simhash


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(docs):
    sets = {i: plain_set(t) for i, t in docs.items()}
    linked = [(a, b) for a, b in combinations(docs, 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return set(plain_components(docs, linked).values())


def test_stage_finds_copies_at_similarity(spark):
    rng, docs = random.Random(3), {0: "", 1: None, 2: "One two", 3: "one TWO", 4: "one two three four five", 5: "one two three four six"}
    passage = " ".join(f"p{i}" for i in range(12))
    for family in range(12):
        base = [f"w{family}x{i}" for i in range(rng.choice([30, 120]))]
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            docs[len(docs)] = " ".join([*words, passage])
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS key")
    want = plain_kept(docs)
    for kept in (corpus_pipeline.near_stage(spark, rows, ""), near_copies.drop_near_copies(rows, block_lines=2, frequent=3)):
        assert kept.columns == rows.columns
        assert {r.doc_id for r in kept.collect()} == want


def test_rows_that_repeat_or_lack_an_id(spark):
    copy, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = spark.createDataFrame([(1, copy), (2, copy + " end"), (2, other), (2, other), (None, copy), (None, "alone here")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, rows, "").collect()]
    assert sorted(got, key=str) == sorted([(1, copy), (2, other), (2, other), (None, "alone here")], key=str)
    assert corpus_pipeline.near_stage(spark, rows.limit(0), "").count() == 0


def test_stage_links_by_covering_hashing_first(spark, monkeypatch):
    """What op4's operator links is checked and known before buckets are compared; the rest is still found."""
    base = [f"w{i}" for i in range(400)]
    docs = {0: base, 1: [*base[:200], "x", *base[201:]], 2: base[:380], 3: [f"v{i}" for i in range(40)], 4: [f"v{i}" for i in range(39)]}
    docs = {i: " ".join(words) for i, words in docs.items()}
    near = [(a, b) for a, b in combinations(docs, 2) if (plain_print(docs[a]) ^ plain_print(docs[b])).bit_count() <= 3]
    assert near and len(near) < 4
    seen, links, buckets = [], simhash.links, near_copies.bucket_links

    def linked(classes):
        out = links(classes)
        seen.append({frozenset((r.u, r.v)) for r in out.collect()})
        return out

    def compared(*args):
        seen.append(args[-1].count())
        return buckets(*args)

    monkeypatch.setattr(near_copies.simhash, "links", linked)
    monkeypatch.setattr(near_copies, "bucket_links", compared)
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == plain_kept(docs)
    signed = {i: p - (1 << 64) if (p := plain_print(t)) >= 1 << 63 else p for i, t in docs.items()}
    assert seen == [{frozenset((signed[a], signed[b])) for a, b in near}, len(near)]
