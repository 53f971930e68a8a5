"""Token ids, their files and their attribution against whole-text encoding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import encode, token_counts, token_output
from weftline.llm.shared import fresh_path

PATH = encode.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False)


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   ", "\n", " \n ", "a\n b", "a \n b\t c", "é ñ ü", "<|endoftext|> x", "x <|endoftext|> y", "a<|endoftext|>  b<|endoftext|><|endoftext|> \nc <|endo", "𝒳 y𝒳", "it's 'we'll 12,000.5 !!", "  x  y", "z" * 5000, "x\r\n y"]


def test_word_memory_gives_the_ids_of_whole_texts(spark, plain):
    rng = random.Random(3)
    pieces = [" ", " ", " ", "a", "B", "ab", "é", "\n", "\t", "1", "!", "'s", " ", " ", "𝒳"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for memo in (10, 100_000):
        code = encode.WordEncoder(PATH, memo)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in code(texts)] == [plain(t).ids for t in texts]


def test_special_strings_are_the_library_s(plain):
    """The contract names the library and no setting of its own, so the string of a special token is that token."""
    assert np.frombuffer(encode.WordEncoder(PATH)(["x <|endoftext|> y"])[0], "<u4").tolist() == plain("x <|endoftext|> y").ids == [87, 220, 50256, 331]


def test_a_word_is_encoded_once_whatever_stands_behind_it(plain):
    code, text = encode.WordEncoder(PATH), "x beta beta, beta.\nbeta beta!? (beta) beta"
    assert np.frombuffer(code([text])[0], "<u4").tolist() == plain(text).ids
    assert sorted(code.memory.now) == sorted(["beta", "(beta", *(encode.TAIL + x for x in (",", ".", "\n", "beta", "!?", ")"))])


def test_cuts_in_words_keep_the_ids(plain):
    rng = random.Random(5)
    pieces = ["a", "Re", "ll", "s", "é", "ſ", "ƀ", "ß", "ª", "и", "e\u0301", "²", "½", "7", "'", "'s", "’", ",", ".", "\n", "\n", "\r", "\t", "_", "(", ")", " ", " ", " ", encode.TAIL, "\u00a0", "\u3000", "<|endoftext|>", "[", "`", "{", "@"]
    texts = ["".join(rng.choice(pieces[:31] if i % 3 else pieces) for _ in range(rng.randrange(30))) for i in range(6000)]
    for code in (encode.WordEncoder(PATH, 10), encode.WordEncoder(PATH)):
        assert [np.frombuffer(x, "<u4").tolist() for x in code(texts)] == [plain(t).ids for t in texts]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        encode.WordEncoder(encode.vocabulary("word_bpe_49k.json"))


def test_files_hold_every_id_in_order(spark, plain):
    rows = [(i, t) for i, t in zip(random.Random(4).sample(range(1000), len(ODD)), ODD, strict=True)]
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").selectExpr("*", "7 AS ids", "'x' AS ordinal", "'y' AS file")
    path = fresh_path(spark, "test-ids")
    token_output.write_ids(docs.repartition(5), path, PATH)
    got = {r.doc_id: r for r in token_output.document_table(spark, path).collect()}
    start = 0
    for i, text in sorted([(-1, "no id"), *rows]):
        ids = np.array([*plain(text).ids, 0], "<u4")
        r = got[None if i < 0 else i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = token_output.read_ids(spark, path).where(f"doc_id = {rows[0][0]}")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id," in one._jdf.queryExecution().toString()
    assert one.first().ids == [*plain(rows[0][1]).ids, 0]
    empty = fresh_path(spark, "test-none")
    token_output.write_ids(docs.limit(0), empty, PATH)
    assert spark.read.schema("doc_id long, ordinal long, ids array<int>").orc(empty).count() == 0


def by_force(plain, text, begin, end, rule):
    spans = plain(text).offsets
    n = sum(begin <= (a if rule == "start" else b - 1) < end for a, b in spans)
    return n, sum(begin < end and a < end and b > begin and not (begin <= a and b <= end) for a, b in spans)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines_and_given_spans(spark, plain, rule):
    ascii_texts = ["one two\nthree\n\nfour  five", "no break", "a\n", "", None, "x" * 300 + "\n" + "word " * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ascii_texts)], "doc_id long, text string").selectExpr("*", "1 AS section", "2 AS n_tokens")
    got = token_counts.token_counts(docs, PATH, rule).collect()
    for r in got:
        assert (r.n_tokens, r.n_crossing) == by_force(plain, ascii_texts[r.doc_id], r.begin_char, r.end_char, rule)
    for i, t in enumerate(ascii_texts):
        own = [r for r in got if r.doc_id == i]
        assert "".join((t or "")[r.begin_char : r.end_char] for r in sorted(own, key=lambda r: r.section)) == (t or "")
        assert sum(r.n_tokens for r in own) == len(plain(t).ids) == pytest.approx(sum(r.token_share for r in own))
    spans = spark.createDataFrame([(1, "hello wonderful world", [(0, 5), (3, 9), (9, 9), (7, 99)]), (2, "é ñandú öl", [(0, 4), (4, 10)]), (3, "x", [])], "doc_id long, text string, s array<struct<begin:int,end:int>>")
    got = token_counts.token_counts(spans, PATH, rule, spans_col="s").collect()
    assert [(r.doc_id, r.section, r.begin_char, r.end_char) for r in sorted(got)] == [(1, 0, 0, 5), (1, 1, 3, 9), (1, 2, 9, 9), (1, 3, 7, 21), (2, 0, 0, 4), (2, 1, 4, 10)]
    for r in got:
        if r.doc_id == 1:
            assert (r.n_tokens, r.n_crossing) == by_force(plain, "hello wonderful world", r.begin_char, r.end_char, rule)
    assert sum(r.n_tokens for r in got if r.doc_id == 2) == len(plain("é ñandú öl").ids)
    assert token_counts.token_counts(docs.limit(0), PATH, rule).count() == 0


def test_queries_cover_the_table(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    totals = {r.doc_id: r.n for r in token_counts.query(spark, sf).groupBy("doc_id").agg({"n_tokens": "sum"}).toDF("doc_id", "n").collect()}
    assert totals == {i: len(plain(t).ids) for i, t in docs.items()}
    start = 0
    for r in sorted(token_output.query(spark, sf).collect()):
        ids = np.array([*plain(docs[r.doc_id]).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
