"""The relational lattice and both folds against the library, brute force and exact round trips."""

from __future__ import annotations

import random
import zlib
from itertools import combinations

import pytest
import sentencepiece

from weftline.llm import sentencepiece_lattice as sp
from weftline.llm.encode import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b   c", "\n", "a\nb\tc", "é ñandú ß", "𝒳 日本 語", "Internationalisierung", "x" * 3000, "the " * 2000, "1.5 !! -- ### a@b.c", "▁ a▁b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("heavy", [1, 10_000_000])
def test_ids_and_texts_equal_the_library(spark, library, heavy):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "b", "the", "ing", " ", " ", "é", "日", "\n", "1"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 AS ids", "2 AS word", "'x' AS n")
    encoded = sp.encode(docs, PATH, heavy_words=heavy)
    for r in sp.decode(encoded, PATH).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text), text
        assert r.decoded == library.decode(r.ids) == text.replace("▁", " ")
    assert sp.encode(docs.limit(0), PATH).count() == 0


def test_lattice_fold_equals_the_fold_in_place(spark, library):
    vocab = sp.Vocabulary.load(PATH)
    words = {w for t in ODD[:13] if t for w in sp.re.findall(sp.WORD, sp.SPACE + t.replace(" ", sp.SPACE))} | {"▁anti", "▁▁▁▁▁x", "▁streamers", "▁thenanea"}
    got = {r.word: r.ids for r in sp.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()}
    assert got == {w: vocab.fold(w) for w in words}


def test_viterbi_equals_brute_force(spark):
    scores = {"a": -1.5, "b": -2.0, "ab": -2.25, "abc": -4.0, "bc": -2.125, "c": -3.5, "▁": -1.0, "▁a": -1.75, "ca": -4.0625, "aa": -3.03125}
    vocab = sp.Vocabulary({p: (i + 300, s) for i, (p, s) in enumerate(scores.items())}, 3, False, [])
    rng = random.Random(6)
    words = {"▁" + "".join(rng.choice("abcd") for _ in range(rng.randrange(8))) for _ in range(60)}

    def best(word):
        ways = []
        for k in range(len(word)):
            for inner in combinations(range(1, len(word)), k):
                cut = [word[i:j] for i, j in zip((0, *inner), (*inner, len(word)), strict=True)]
                if all(c in scores or len(c) == 1 for c in cut):
                    ways.append(sum(scores.get(c, vocab.unknown) for c in cut))
        return max(ways)

    got = {r.word: r.ids for r in sp.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()}
    for w in words:
        assert got[w] == vocab.fold(w)
        assert sum(scores.get(s, vocab.unknown) for s in vocab._best_path(w)) == pytest.approx(best(w))


def test_query_round_trips_the_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sp.query(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.ids == library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.decoded_crc32) == (len(r.ids), zlib.crc32(docs[r.doc_id].encode()))
