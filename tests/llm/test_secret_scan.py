"""Secrets: places against Python's patterns, verdicts by owners."""

from __future__ import annotations

import hashlib
import re
import time

from weftline.llm import secret_scan

ROWS = [
    (1, "api_key = 'abcdefghij12' and TOKEN:\"ABCDEF123456789\"", "org/a"), (2, "AKIA1234567890ABCD AKIA123 xAKIAAKIAAKIAAKIA99", "org/b"),
    (3, "0123456789abcdef0 deadbeef ü deadbeefdeadbeef", None), (4, "token=token:abcdefghijklmnop secret  :  x", "p"), (5, None, "org/a"), (6, "", None), (None, "ghp_AbCdEfGhIjKl0123456789 ", "q/1"),
    (7, "password==hunter2hunter2hunter2\npasswd:short", "r"), (7, "password==hunter2hunter2hunter2\npasswd:short", "r"), (8, "😀 secret='😀' secret=Aa0+/_.=-Aa0+", "s"),
    (9, "x" * 30 + " Zx9Zx9kLmN0pQrStUvWxYz12", "t"),
    *[(100 + i, "see AKIA1234567890WXYZ and Zx9Zx9kLmN0pQrStUvWxYz12" * (i % 3), f"own{i % 4}/repo{i}") for i in range(40)],
]


def brute(rows):
    found = []
    for i, text, source in rows:
        for rank, k in enumerate(secret_scan.KINDS):
            for m in re.finditer(k.plain, text or ""):
                if len(m[k.group]) >= k.least:
                    found.append((i, source, rank, k, m.start(), m.end(), m[k.group]))
    owners, repositories = {}, {}
    for _, source, *_, value in found:
        owners.setdefault(value, set()).add(re.sub("/[^/]*$", "", source) if source else source)
        repositories.setdefault(value, set()).add(source)
    out = []
    for n, (i, text, source) in enumerate(rows):
        spans = []
        for rank, k in enumerate(secret_scan.KINDS):
            for m in re.finditer(k.plain, text or ""):
                value = m[k.group]
                if len(value) < k.least:
                    continue
                copied = len(owners[value]) >= 3 or len(repositories[value]) >= 5
                random = bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value) and len(set(value)) >= 10)
                verdict = "copied" if copied else "live" if random else "weak"
                if k.base or verdict == "live":
                    spans.append((m.start(), rank, m.end(), k.name, verdict, len(repositories[value]), len(owners[value])))
        out.append((i, sorted(spans)))
    return sorted(out, key=str)


def test_spans_and_verdicts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 AS row", "2 AS found", "3 AS value").repartition(5)
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.find_secrets(docs).collect()), key=str)
    assert got == brute(ROWS)
    assert {s[4] for _, spans in got for s in spans} == {"copied", "live", "weak"}
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_frequent_values_are_judged_like_others(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "HEAVY_SHARE", 3)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.find_secrets(docs).collect()), key=str) == brute(ROWS)


def test_no_value_leaves_the_scan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    scanned = secret_scan.scan(docs, "doc_id", "text", secret_scan.F.col("source"), secret_scan.F.col("source"))
    values = {bytes(s.value) for r in scanned.collect() for s in r.found}
    assert hashlib.sha256(b"abcdefghij12").digest() in values
    assert all(len(v) == 32 for v in values)


def test_long_texts_take_linear_time(spark):
    rows = [(1, "token=" + "a" * 400_000, "a"), (2, "AKIA" * 100_000, "b"), (3, "token " * 60_000, "c"), (4, ("password" + " " * 50) * 8_000, "d"), (5, "token=abcdefghijkl " * 30_000, "e"), (6, "ab12" * 100_000, "f")]
    began = time.perf_counter()
    spans = {r.doc_id: len(r.spans) for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert spans[5] == 30_000 and spans[4] == 0 and spans[6] == 1
    assert time.perf_counter() - began < 60
