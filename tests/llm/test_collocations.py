"""Collocations against counting by hand, on a small table with odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import collocations


def brute(rows, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def table():
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma", "été", "x1", "delta"]
    rows = [(" ".join(rng.choices(words, [6, 5, 4, 3, 2, 1], k=rng.randrange(30))) + rng.choice([".", "", "\n", "  ,"]), rng.choice(["en", "fr", None])) for _ in range(150)]
    rows += [("one two three. " * 12, "en"), ("red\tgreen  red green red", "de"), ("red green red green " * 9, "de"), ("", "en"), (None, "en"), ("... !!", "xx"), ("a\x00b c d " * 11, "en"), ("aa aa aa aa aa " * 4, "de"), ("word", None), ("pp qq ", "zz")]
    return rows + [("rep eat ed", "en")] * 40 + [("long " * 5000 + "tail", "en")]


@pytest.mark.parametrize(("top", "margin", "patterns"), [(2000, 125, 200_000), (3, 100, 5)])
def test_equal_to_counting_by_hand(spark, monkeypatch, top, margin, patterns):
    """With a small ``top`` the margin is widened; with few phrases to an automaton there are several scans."""
    monkeypatch.setattr(collocations, "PATTERNS", patterns)
    rows = table()
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS cell", "2 AS phrase", "3 AS n").repartition(3)
    found = collocations.collocations(docs, top=top, margin=margin)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, top)


def test_many_blocks_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH", 500)
    monkeypatch.setattr(collocations, "BLOCK", 100)
    rows = table()
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).collect())) == brute(rows, 2000)


def test_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_wide_products_are_exact(spark):
    a, left, right = 3_000_000_007, 4_000_000_009, 5_000_000_021
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score(*(collocations.F.col(c) for c in "alr"))).first()
    assert row[0] == 1_000_000 * a * a // (left * right)


def test_cells_of_a_phrase_do_not_depend_on_what_stands_around_it():
    one, other = collocations.Words(b"x. Some  words\there", "en"), collocations.Words("ü some words here, y".encode(), "en")
    assert one.cells(3)[1] == other.cells(3)[1]
    assert not np.intersect1d(one.cells(3)[1:2], collocations.Words(b"x. some words here", "fr").cells(3)).size
