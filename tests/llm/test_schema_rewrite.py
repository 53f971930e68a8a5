"""The rewrite of drifted files against a plain sort, and against attempts that were lost or came twice."""

from __future__ import annotations

import datetime
import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from weftline.llm import schema_rewrite as sr

NAMES = [name for name, _ in sr.CLIENTS.values()]
SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
AT = datetime.datetime(2024, 2, 3, 4, 5, 6, 789)


def rows(n):
    made = [(i, i // 2, "crm", AT + datetime.timedelta(seconds=i), f"n|{i}", None if i % 5 == 0 else f"e{i}\n", "Zü" * (i % 3), i % 25, None if i % 7 == 0 else "s", None if i % 11 == 0 else i * 1.37 - 50) for i in range(n)]
    made += [(3, 9, None, None, "again", "", "", None, None, -0.001)] * 2 + [(None, 1, "web", AT, None, None, None, None, None, 1e300), (-4, None, "", AT, "x" * 100_000, "?", "none", -1, "", float("nan"))]
    return made


def brute(table, files):
    table = sorted(table, key=lambda r: (zlib.crc32(b"" if r[0] is None else str(r[0]).encode()), r[0] is not None, r[0] or 0))
    per = 1 + len(table) // files
    out = []
    for f in range(-(-len(table) // per)):
        version = zlib.crc32(f"7:{f}".encode()) % 24
        version = 0 if version > 15 else version
        lines, ids, nulls = [], [], 0
        for r in (dict(zip(NAMES, r, strict=True)) for r in table[f * per : (f + 1) * per]):
            if version & 4:
                r |= {"nation_id": -1, "city": "none"}
            if version & 8 and r["balance"] is not None:
                with np.errstate(over="ignore"):
                    r["balance"] = float(np.float32(r["balance"]))
            nulls += sum(v is None for v in r.values())
            if r["updated_at"]:
                r["updated_at"] = (r["updated_at"] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
            if r["balance"] is not None and math.isfinite(r["balance"]):
                r["balance"] = math.floor(1048576 * r["balance"])
            lines.append("|".join("?" if v is None else str(v) for v in r.values()))
            ids.append("?" if r["client_id"] is None else str(r["client_id"]))
        out.append((f, len(lines), nulls, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256("\n".join(lines).encode()).hexdigest(), version != 0))
    return out


@pytest.mark.parametrize(("n", "files"), [(40, 20), (300, 12), (1, 1000)])
def test_files_hold_the_sorted_rows(spark, n, files):
    table = rows(n)
    clients = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 AS rank", "2 AS file_no", "3 AS __crc").repartition(5)
    found = sr.rewrite_clients(clients, ranges=3, files=files).orderBy("file_no").collect()
    assert [(r.file_no, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.rewritten) for r in found] == brute(table, files)
    folder = os.path.dirname(found[0].path)
    assert sorted(os.listdir(folder)) == [sr.file_name(r.file_no) for r in found]
    for r in found:
        assert sr.same_schema(pq.read_schema(r.path), sr.arrow_schema(sr.CLIENTS))
        assert r.columns == ",".join(NAMES)
        assert r.start_columns == ",".join(sr.start_schema(r.file_no).names)
    assert spark.read.parquet(folder).count() == len(table)


def test_an_empty_table_gives_no_files(spark):
    assert sr.rewrite_clients(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_second_attempt_changes_nothing(spark):
    """Tasks that ran once already, before and after files were replaced, find the same."""
    clients = spark.createDataFrame(rows(60), SCHEMA)
    first = {r.file_no: r for r in sr.rewrite_clients(clients, ranges=2, files=10).collect()}
    folder = os.path.dirname(first[0].path)
    staging = folder.replace("/files", "/staging")
    staged = spark.createDataFrame([(r.file_no, r.start_columns, r.rewritten) for r in first.values()], "file_no long, start_columns string, rewritten boolean")
    again = sr.publish(staged, len(first), folder, staging, sr.file_name, sr.digests, "columns string, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")
    assert {r.file_no: r for r in again.collect()} == first
    assert not [x for x in os.listdir(staging) if not x.endswith(".crc")]


def test_drift_bits():
    names = {v: sr.start_schema(f).names for f in range(400) for v in [sr.version_of(f)]}
    assert set(names) == set(range(16))
    assert names[0] == NAMES
    assert names[1].index("email") == NAMES.index("name")
    assert names[2] == NAMES[:1] + NAMES[:0:-1]
    assert "nation_id" not in names[4] and "city" not in names[12]
