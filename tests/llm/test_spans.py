"""Benchmark windows and personal data against brute force."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from weftline.llm import decontaminate as dc
from weftline.llm import pii


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_hits(text, items, window):
    words, hit, found = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for at in range(len(words) - k + 1):
                if words[at : at + k] == w[i : i + k]:
                    hit.update(range(at, at + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_windows_equal_brute_force(spark):
    rng = random.Random(9)
    letters = ["a", "B", "c", "É", "1", "d"]
    say = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(letters) for _ in range(n))
    items = [(i, say(rng.randrange(0, 9))) for i in range(25)] + [(7, "A b"), (90, None), (91, ""), (None, "c c c"), (92, "!!")]
    texts = [say(rng.randrange(0, 40)) for _ in range(60)] + [None, "", "a " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    for size in (1_000_000, 20):
        out = dc.find_contamination(docs, bench, window=4, block_bytes=size)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one worker's tables at a time
        got = out.collect()
        assert len(got) == len(texts)
        for r in got:
            if r.doc_id < 62:
                spans = list(zip(r["__wm_spans"][::2], r["__wm_spans"][1::2], strict=True))
                assert (r["__wm_words"], sum(b - a for a, b in spans), r["__wm_items"]) == plain_hits(texts[r.doc_id], known, 4)
    clean = dc.decontaminate(docs, bench, window=4)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts[:62]) if not plain_hits(t, known, 4)[2]} | ({62} - {r.doc_id for r in got if r["__wm_items"]})
    none = dc.find_contamination(docs, bench.limit(0)).collect()
    assert all(r["__wm_items"] == [] and r["__wm_words"] == len(plain_words(texts[r.doc_id])) for r in none)
    assert dc.find_contamination(docs.limit(0), bench).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 if x > 4 else x * 2 for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS email_spans", "'x' AS kind")
    return {r.doc_id: r for r in pii.find_pii(docs).collect()}


def test_base_spans_equal_python(spark):
    rng = random.Random(10)
    parts = ["a", "@", ".", "b.c", "1", "25", "256", "0300", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "x@y.z", "_", "%", "é", "\n", "10.0.0.255", "+49 (30) 1234-5678"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "é𝒳 me@x.org", "0" * 12, "4" * 40]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        have = sorted((s.start, s.rank, s.end, s.kind) for k in PLAIN for s in got[i][f"{k}_spans"])
        assert have == base_spans(t), t


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 100_000, "1 " * 100_000, "+" * 200_000, "+1" * 100_000, "a@" * 50_000, "a@b.c " * 500, "AB12" * 50_000]
    got = found(spark, texts)
    assert len(got[7].email_spans) == 500


def test_many_matches_take_linear_time(spark):
    text = "mail a@b.c " + "é 10.0.0.1 " * 40_000
    found(spark, ["warm 1.2.3.4"])
    began = time.monotonic()
    got = found(spark, [text])[0]
    assert time.monotonic() - began < 20  # the growing array took minutes
    assert [(s.start, s.end) for s in got.ip_spans[::9999]] == [(13 + 11 * i, 21 + 11 * i) for i in range(0, 40_000, 9999)]
    assert got.email_spans[0].score == 95


def test_checksums_context_and_redaction(spark):
    texts = ["pay to IBAN GB82 WEST 1234 5698 7654 32 now", "GB82WEST12345698765432", "GB83WEST12345698765432", "my social security number is 123-45-6789", "part 123-45-6789", "ssn 000-45-6789", "mail contact me@x.org or 10.0.0.1"]
    got = found(spark, texts)
    assert [len(got[i].iban_spans) for i in range(3)] == [1, 1, 0]
    assert got[0].iban_spans[0].score > got[1].iban_spans[0].score
    assert [len(got[i].ssn_spans) for i in range(3, 6)] == [1, 0, 0]
    assert got[6].email_spans[0].score == 95
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = pii.find_pii(docs).join(docs, "doc_id").withColumn("all", F.concat(*(f"{k.name}_spans" for k in pii.KINDS)))
    red = {r[0]: r[1] for r in held.select("doc_id", pii.redact(F.col("text"), F.col("all"))).collect()}
    assert red[6] == "mail contact <email> or <ip>" and red[4] == texts[4]
    assert pii.find_pii(docs.limit(0)).count() == 0
