"""The queries over the reference's operators, by name, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import code, scores, vector
from weftline.functions import text as tx
from weftline.functions.prompts import prompt
from weftline.operators import chunking, citations, embedding, fusion, inverted_index, keyword, lru, question_scan, related, rerank, sentences, similarity, store
from weftline.operators.sizing import fresh_path, stored, texts_of
from weftline.plans import answer, ingestion, sql
from weftline.sources import files
from weftline.streaming import ingest as streaming
from weftline.streaming import unique

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
QUESTION = "the and of tionnd anea the notaword"


def query(oracle: str | None):
    """Registers a function as the query of its name."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Query]:
    """Every registered query."""
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(_ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: user turns of conversations whose id is divisible by 50."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id % 50 = 0")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))


_QUESTIONS = "(SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user' AND conv_id % 50 = 0)"
_DOCUMENTS = "(SELECT doc_id AS chunk_id, source, text FROM documents)"
_ONE = f"(SELECT 0::BIGINT AS query_id, '{QUESTION}' AS question)"


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUESTION)], "query_id long, question string")


# text ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {sql.clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    """T1-T8."""
    return _table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


CLEAN_ROWS = [
    (0, None), (1, "a b c d e f"), (2, "x    y   z  w"), (3, "a\t\t\tb"), (4, "one\r\ntwo\r\n"), (5, "p\n \n \nq"),
    (6, "c\x01\x07d\x7fe"), (7, "tail\u0085\nnext \nend "), (8, "\n\n\n\nlead\n\n\n\nmid\n\n\n\n"), (9, " \t "), (10, ""),
]


@query(f"SELECT id, {sql.clean('text')} AS cleaned FROM {sql.values(CLEAN_ROWS, 'id BIGINT, text VARCHAR')}")
def clean_text_edges(spark, sf_dir):
    """T1-T8 on odd texts."""
    return spark.createDataFrame(CLEAN_ROWS, "id long, text string").select("id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, len({sql.tokens('text')}) AS n_tokens, len(list_distinct({sql.tokens('text')})) AS n_distinct FROM documents")
def token_counts(spark, sf_dir):
    """F1."""
    found = tx.tokens(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_tokens"), F.size(F.array_distinct(found)).alias("n_distinct"))


@query(f"SELECT doc_id, len({sql.sentences('text')}) AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    """C1, C2."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


@query(f"WITH {sql.punkt_ctes('documents', 'doc_id', 'text')} SELECT word, n, n_stop AS n_mark, score, 'abbreviation' AS kind FROM pk_short UNION ALL SELECT word, n, n_start, score, 'starter' FROM pk_start")
def sentence_statistics(spark, sf_dir):
    """What the texts say of abbreviations and sentence starters."""
    learnt = sentences.learn(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return (
        learnt.abbreviations.withColumnRenamed("n_stop", "n_mark").withColumn("kind", F.lit("abbreviation")).union(learnt.starters.withColumnRenamed("n_start", "n_mark").withColumn("kind", F.lit("starter")))
    )


@query(f"WITH {sql.punkt_ctes('documents', 'doc_id', 'text')} SELECT id AS doc_id, sentence_no::INTEGER AS sentence_no, sentence FROM pk_sentences")
def statistical_sentences(spark, sf_dir):
    """The sentences of all documents by these statistics."""
    docs = _table(spark, sf_dir, "documents")
    return sentences.sentences(docs, sentences.learn(docs, "doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("SELECT sha256(text) AS key, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def embedding_dedupe_key(spark, sf_dir):
    """Texts that an embedding cache would hold once."""
    return _table(spark, sf_dir, "documents").groupBy(tx.text_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("SELECT 1 AS size, 1000 AS max_size, 0.0::DOUBLE AS hit_rate WHERE false UNION ALL SELECT least(count(DISTINCT sha256(text)), 1000), 1000, 0.0 FROM documents")
def cache_stats(spark, sf_dir):
    """A3: the statistics of a cache of 1000 texts after all documents."""
    keys = _table(spark, sf_dir, "documents").select(tx.text_key(F.col("text")).alias("key")).distinct()
    return keys.agg(F.least(F.count("*"), F.lit(1000)).alias("size"), F.lit(1000).alias("max_size"), F.lit(0.0).alias("hit_rate"))


# chunks --------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS i, doc_id, sha256(text) AS key FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, lag(i) OVER (PARTITION BY key ORDER BY i) AS p FROM a),
d AS (SELECT b.i, count(DISTINCT a.key) AS n FROM b JOIN a ON a.i > b.p AND a.i < b.i GROUP BY b.i)
SELECT doc_id, p IS NOT NULL AND coalesce(n, 0) < 500 AS hit FROM b LEFT JOIN d USING (i)""")
def cache_lru_hits(spark, sf_dir):
    """Which documents a cache of 500 embeddings knows already, in order."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", tx.text_key(F.col("text")).alias("text_key"))
    return lru.lru(docs, ["doc_id"], "text_key", 500).accesses.select("doc_id", "hit")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, sha256(text) AS key FROM conversations WHERE text IS NOT NULL)
SELECT key, rank::INTEGER AS rank FROM (SELECT key, row_number() OVER (ORDER BY max(i) DESC) AS rank FROM a GROUP BY key) WHERE rank <= 100""")
def cache_lru_contents(spark, sf_dir):
    """What a cache of 100 embeddings holds after all turns."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.text_key(F.col("text")).alias("text_key"))
    return lru.lru(turns, ["conv_id", "turn"], "text_key", 100).contents


@query(f"SELECT * FROM {sql.chunks('documents', 'doc_id, source', sql.clean('text'))}")
def sentence_chunks(spark, sf_dir):
    """The chunks of all documents."""
    return chunking.explode_chunks(_table(spark, sf_dir, "documents"), chunking.sentence_windows(F.col("text"), clean=True), "doc_id", "source")


@query(f"SELECT * FROM {sql.chunks('documents', 'doc_id', 'text', 2, 3, 10)}")
def chunk_overlap_gt_size(spark, sf_dir):
    """An overlap larger than the window steps by whole windows."""
    return chunking.explode_chunks(_table(spark, sf_dir, "documents"), chunking.sentence_windows(F.col("text"), 2, 3, 10), "doc_id")


CHUNK_ROWS = [
    (0, None), (1, ""), (2, "   "), (3, " short text stays as it is "), (4, "x" * 49), (5, "x" * 50), (6, "a. b. c. d. e. f. g. h. i. j. k. l. m. n. o. p. q. r. s. t."),
    (7, "This is sentence one. This is sentence two. This is sentence three. This is sentence four."), (8, " ".join(f"Sentence number {i} here." for i in range(12))), (9, " ".join(f"Sentence number {i} here." for i in range(13))),
]


@query(f"SELECT * FROM {sql.chunks(sql.values(CHUNK_ROWS, 'id BIGINT, text VARCHAR'), 'id', 'text')}")
def chunk_short_text(spark, sf_dir):
    """C4-C6 on odd texts."""
    return chunking.explode_chunks(spark.createDataFrame(CHUNK_ROWS, "id long, text string"), chunking.sentence_windows(F.col("text")), "id")


OCR_ROWS = [("a.png", ""), ("b.png", None), ("c.jpg", "x" * 100), ("d.jpg", "Recognised words of a sign. " * 20), ("e.gif", "No marks " * 30)]


@query(f"""
WITH o AS (SELECT * FROM {sql.values(OCR_ROWS, 'name VARCHAR, text VARCHAR')}), w AS (SELECT name, list(chunk_text ORDER BY chunk_index) AS c FROM {sql.chunks('o', 'name', 'text')} GROUP BY name),
a AS (SELECT o.name, CASE WHEN coalesce(text, '') = '' THEN ['[Image: ' || o.name || ']'] WHEN length(text) > 100 AND c IS NOT NULL THEN c ELSE [text] END AS c FROM o LEFT JOIN w ON o.name = w.name)
SELECT name, unnest(range(len(c)))::INTEGER AS chunk_index, unnest(c) AS chunk_text, len(c)::INTEGER AS total_chunks FROM a""")
def ocr_chunks(spark, sf_dir):
    """C7."""
    return chunking.explode_chunks(spark.createDataFrame(OCR_ROWS, "name string, text string"), chunking.ocr_chunks(F.col("name"), F.col("text")), "name")


CODE_ROWS = [
    ("src/a.py", "\n".join(f"value_{i} = {i} * {i}" for i in range(101))), ("src/b.JS", "\n".join(f"const x{i} = {i};" for i in range(50))), ("lib/c.rs", "\n".join(f"let y{i} = {i};" for i in range(51))),
    ("notes", "\n".join(f"line {i}" for i in range(49))), (".bashrc", "export A=1\n" * 8), ("d.tsx", ""), ("e.weird", "short"), ("dir.py/f", "z = 1\n" * 12),
]
_LANGUAGE = "CASE regexp_extract(lower(path), '[^/.][^/]*(\\.[^./]+)$', 1) " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in code.LANGUAGES.items()) + " END"


@query(f"""
SELECT path AS file_path, language, unnest(range(len(b)))::INTEGER AS chunk_index, unnest(b).ls AS line_start, unnest(b).le AS line_end, unnest(b).t AS text FROM (
  SELECT path, {_LANGUAGE} AS language, list_filter(list_transform(range(0, len(l), 50), lambda k: {{'ls': (k + 1)::INTEGER, 'le': least(k + 50, len(l))::INTEGER, 't': array_to_string(l[k + 1:k + 50], chr(10))}}), lambda x: length({sql.strip("x['t']")}) >= 50) AS b
  FROM (SELECT path, string_split(code, chr(10)) AS l FROM {sql.values(CODE_ROWS, 'path VARCHAR, code VARCHAR')}))""")
def line_blocks_50(spark, sf_dir):
    """C8, F4."""
    return chunking.line_blocks(spark.createDataFrame(CODE_ROWS, "path string, code string"))


@query(f"SELECT path, {_LANGUAGE} AS language FROM {sql.values(CODE_ROWS, 'path VARCHAR, code VARCHAR')}")
def detect_language(spark, sf_dir):
    """F4."""
    return spark.createDataFrame(CODE_ROWS, "path string, code string").select("path", code.language(F.col("path")).alias("language"))


STRUCTURE_ROWS = [("m.py", "import os\n\ndef first(a, b):\n    x = a\n\n    return x\n\n@wrap\ndef second():\n    pass\nclass Box:\n    def get(self) -> int:\n        return 1\n\n    async def put(self, v):\n        self.v = v\n"), ("n.js", "def not_python():\n  pass")]
_STRUCTURES = [("m.py", "first", None, 3, 8), ("m.py", "second", None, 9, 10), ("m.py", "get", "Box", 12, 14), ("m.py", "put", "Box", 15, 17)]


@query(f"SELECT * FROM {sql.values(_STRUCTURES, 'file_path VARCHAR, name VARCHAR, class VARCHAR, line_start INTEGER, line_end INTEGER')}")
def code_structures(spark, sf_dir):
    """C9, C10 as they are meant."""
    return chunking.code_structures(spark.createDataFrame(STRUCTURE_ROWS, "path string, code string"))


# keyword search ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id AS chunk_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS token FROM documents) GROUP BY ALL")
def bm25_postings(spark, sf_dir):
    """B1."""
    return keyword.postings(_documents(spark, sf_dir))


@query(f"WITH {sql.weight_ctes(_DOCUMENTS)} SELECT token, df, round(idf, 6) AS idf FROM kw_idf")
def bm25_idf(spark, sf_dir):
    """B2, A6."""
    return keyword.token_idf(_documents(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {sql.weight_ctes(_DOCUMENTS)} SELECT token, df, round(idf, 6) AS idf FROM kw_idf")
def bm25_added_documents(spark, sf_dir):
    """The idf of all documents from the stored counts of the even ones and those of the odd ones, added later."""
    docs = _documents(spark, sf_dir)
    parts = [stored(keyword.document_frequencies(docs.where(F.col("chunk_id") % 2 == k)), "frequencies") for k in (0, 1)]
    return keyword.idf_of(keyword.add_frequencies(*parts), docs.agg(F.count("*").alias("n_chunks"))).withColumn("idf", F.round("idf", 6))


@query(f"WITH {sql.keyword_ctes(_DOCUMENTS, _QUESTIONS, 15)} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM kw_top")
def bm25_index_segments(spark, sf_dir):
    """The stated questions against a stored index of three segments, appended one after another."""
    docs = _documents(spark, sf_dir)
    index = inverted_index.KeywordIndex(spark, fresh_path(spark, "index"))
    for k in range(3):
        index.append(docs.where(F.col("chunk_id") % 3 == k))
    return index.search(_questions(spark, sf_dir), 15).top


@query(f"""WITH {sql.weight_ctes(_DOCUMENTS)}, asked AS (SELECT DISTINCT query_id, unnest({sql.tokens('question')}) AS token FROM {_QUESTIONS})
SELECT query_id, count(*) AS n_postings, true AS saved FROM asked JOIN kw_post USING (token) GROUP BY 1""")
def bm25_index_work(spark, sf_dir):
    """The postings of each stated question's words, and whether the search scored fewer of them."""
    index = inverted_index.KeywordIndex(spark, fresh_path(spark, "index"))
    index.append(_documents(spark, sf_dir))
    return index.search(_questions(spark, sf_dir), 15).work.select("query_id", "n_postings", (F.col("n_scored") < F.col("n_postings")).alias("saved"))


@query("SELECT 0::BIGINT AS query_id, 0::BIGINT AS n_hits")
def bm25_no_corpus(spark, sf_dir):
    """Without chunks, and for a question without words, nothing is found."""
    docs, none = _documents(spark, sf_dir), spark.createDataFrame([(0, "?! ...")], "query_id long, question string")
    found = keyword.keyword_topk(docs.limit(0), _one(spark), 5).union(keyword.keyword_topk(docs, none, 5))
    return found.agg(F.lit(0).cast("long").alias("query_id"), F.count("*").alias("n_hits"))


@query(f"WITH {sql.keyword_ctes(_DOCUMENTS, _ONE, None)} SELECT n AS n_chunks, round(avgdl, 6) AS avg_len FROM kw_stat")
def bm25_corpus_stats(spark, sf_dir):
    """A6."""
    return keyword.corpus_stats(_documents(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {sql.keyword_ctes(_DOCUMENTS, _QUESTIONS, 15)} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM kw_top")
def bm25_topk(spark, sf_dir):
    """The stated questions against all documents."""
    return keyword.keyword_topk(_documents(spark, sf_dir), _questions(spark, sf_dir), 15)


@query(f"WITH {sql.keyword_ctes(_DOCUMENTS, _ONE, 15)} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM kw_top")
def bm25_duplicate_terms(spark, sf_dir):
    """A question that repeats a word and has one that no document has."""
    return keyword.keyword_topk(_documents(spark, sf_dir), _one(spark), 15)


TINY_ROWS = [(0, "alpha beta"), (1, "beta gamma")]


@query("SELECT 0::BIGINT AS query_id, 0::BIGINT AS chunk_id, 0.0::DOUBLE AS score WHERE false")
def bm25_tiny_corpus(spark, sf_dir):
    """With two documents, a word of one has idf 0 and finds nothing."""
    asked = spark.createDataFrame([(0, "alpha")], "query_id long, question string")
    return keyword.keyword_scores(spark.createDataFrame(TINY_ROWS, "chunk_id long, text string"), asked)


# vectors -------------------------------------------------------------------------------------------------------------

_FIRST = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("SELECT vec_id, len(embedding) AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    """F7, V8, E6."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT chunk_id, score FROM (SELECT a.vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings a, {_FIRST} b ORDER BY score DESC, chunk_id LIMIT 10) WHERE score >= 0")
def cosine_topk_single(spark, sf_dir):
    """F8, V1-V3: the first vector against all."""
    vectors = _table(spark, sf_dir, "embeddings")
    return similarity.cosine_topk_one(vectors, vectors.orderBy("vec_id").first()["embedding"], 10, id_col="vec_id")


_BATCH = f"(SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)"


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM {_BATCH} WHERE score >= 0) WHERE rank <= 10")
def cosine_topk_batch(spark, sf_dir):
    """V4, V5: every vector whose id is divisible by 50 against all."""
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return similarity.cosine_topk(vectors, asked, 10, id_col="vec_id")


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM {_BATCH} WHERE score >= 0) WHERE rank <= 10")
def cosine_index_topk(spark, sf_dir):
    """V4, V5, V7: the same through an index of cells, in two rounds with exact bounds."""
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return similarity.vector_index(vectors, "vec_id").search(asked, 10)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM {_BATCH} WHERE score >= 0.25) WHERE rank <= 20")
def cosine_threshold(spark, sf_dir):
    """V2, V3 with a threshold."""
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return similarity.cosine_topk(vectors, asked, 20, 0.25, id_col="vec_id")


@query(f"SELECT doc_id, b::INTEGER AS bucket, round(x, 6) AS x FROM {sql.hashed('documents', 'doc_id', 'text')}")
def embedding_hashing(spark, sf_dir):
    """E1, E2 with the deterministic stand-in: its vectors, sparse."""
    held = embedding.embed(_table(spark, sf_dir, "documents").select("doc_id", "text"), embedding.HashingEmbedder())
    return held.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).where("x > 0").withColumn("x", F.round("x", 6))


# fusion and reranking ------------------------------------------------------------------------------------------------

FUSION_ROWS = [(0, i, float(k), float(s)) for i, (k, s) in enumerate([(3, 0.9), (0, 0.8), (5, 0.1), (2, 0.5)])] + [(1, 0, 0.0, 0.4), (1, 1, 0.0, 0.7)] + [(2, 0, 2.0, 0.5), (2, 1, 2.0, 0.5)]


@query(f"""SELECT query_id, chunk_id, round(CASE WHEN max(kw) OVER w = min(kw) OVER w THEN 1.0 ELSE (kw - min(kw) OVER w) / nullif(max(kw) OVER w - min(kw) OVER w, 0) END, 6) AS scaled
FROM {sql.values(FUSION_ROWS, 'query_id BIGINT, chunk_id BIGINT, kw DOUBLE, sem DOUBLE')} WINDOW w AS (PARTITION BY query_id)""")
def minmax_normalize(spark, sf_dir):
    """F6, H5."""
    rows = spark.createDataFrame(FUSION_ROWS, "query_id long, chunk_id long, kw double, sem double")
    return rows.select("query_id", "chunk_id", F.round(scores.min_max(F.col("kw"), Window.partitionBy("query_id")), 6).alias("scaled"))


_SEM = f"""sem_all AS (SELECT q.query_id, c.chunk_id, round(sum(q.x * c.x), 6) AS score FROM q_vec q JOIN c_vec c USING (b) GROUP BY ALL),
sem_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sem_all WHERE score >= 0) WHERE rank <= {{k}})"""


def _hybrid_sql(chunk_table: str, query_table: str, over: int) -> str:
    return f"""{sql.keyword_ctes(chunk_table, query_table, over)},
q_vec AS (SELECT * FROM {sql.hashed(query_table, 'query_id', 'question')}), c_vec AS (SELECT * FROM {sql.hashed(chunk_table, 'chunk_id', 'text')}), {_SEM.format(k=over)}"""


@query(f"WITH {_hybrid_sql(_DOCUMENTS, _QUESTIONS, 30)} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM {sql.fused('kw_top', 'sem_top', 10, 0.3)}")
def hybrid_fusion(spark, sf_dir):
    """H1-H8: the stated questions against all documents, vectors by the stand-in."""
    docs, asked = _documents(spark, sf_dir), _questions(spark, sf_dir)
    model = embedding.HashingEmbedder()
    vectors = embedding.embed(asked, model, "question", "vector")
    held = embedding.embed(docs, model)
    return fusion.fuse(keyword.keyword_topk(docs, asked, 30), similarity.cosine_topk(held, vectors, 30), 10)


_NO_HITS = "(SELECT query_id, chunk_id, kw AS score FROM f WHERE kw > 0)"


@query(f"""WITH f AS (SELECT * FROM {sql.values(FUSION_ROWS, 'query_id BIGINT, chunk_id BIGINT, kw DOUBLE, sem DOUBLE')})
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM {sql.fused(_NO_HITS, '(SELECT query_id, chunk_id, sem AS score FROM f)', 5, 0.3)}""")
def hybrid_no_keyword_hits(spark, sf_dir):
    """H4, H5: a side without hits scales to 1 for all."""
    rows = spark.createDataFrame(FUSION_ROWS, "query_id long, chunk_id long, kw double, sem double")
    return fusion.fuse(rows.where("kw > 0").withColumnRenamed("kw", "score"), rows.withColumnRenamed("sem", "score"), 5)


def _overlap_sql(question: str, text: str) -> str:
    asked = f"list_distinct({sql.tokens(question)})"
    return f"round(len(list_intersect({asked}, {sql.tokens(text)})) / greatest(len({asked}), 1)::DOUBLE, 6)"


@query(f"""WITH {sql.keyword_ctes(_DOCUMENTS, _QUESTIONS, 20)},
s AS (SELECT query_id, chunk_id, k.score AS fused_score, {_overlap_sql('question', 'text')} AS score FROM kw_top k JOIN {_DOCUMENTS} d USING (chunk_id) JOIN {_QUESTIONS} q USING (query_id))
SELECT query_id, chunk_id, fused_score, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def rerank_lexical(spark, sf_dir):
    """R1-R3 with the deterministic stand-in."""
    docs, asked = _documents(spark, sf_dir), _questions(spark, sf_dir)
    found = texts_of(keyword.keyword_topk(docs, asked, rerank.CANDIDATES), docs).join(asked, "query_id")
    return rerank.rerank(found, 5).select("query_id", "chunk_id", "fused_score", "score", "rank")


# related files -------------------------------------------------------------------------------------------------------

GRAPH_ROWS = [
    (0, "app/main", "repo", "from util.io import load\nimport app.main\n"), (1, "util/io", "repo", "import os\nimport util.text"), (2, "util/text", "repo", "x = 1"), (3, "web/index.js", "repo", "const a = require('util/text');\nimport b from \"app/main\""),
    (4, None, "paper.pdf", "no code here"), (5, "", "notes", "import ghost"), (6, None, None, "nothing"), *[(7 + i, "util/io", "repo", f"part {i}") for i in range(6)], (13, "os", "repo", "system"), (14, "hub", "repo", "import a1\nimport b1\nimport c1\nimport d1"), (15, "a1", "repo", "import hub"), (16, "b1", "repo", "b"), (17, "c1", "repo", "c"), (18, "d1", "repo", "d"),
]
HIT_ROWS = [(0, 0, 1), (0, 2, 2), (1, 4, 1), (2, 14, 1), (3, 8, 1), (3, 4, 2)]
_GRAPH = sql.values(GRAPH_ROWS, "chunk_id BIGINT, file_path VARCHAR, source VARCHAR, text VARCHAR")
_TARGETS = "list_concat(" + ", ".join("regexp_extract_all(text, '" + p.replace("'", "''") + "', 1)" for p in related.IMPORTS) + ")"
_EDGES = f"edges AS (SELECT DISTINCT file_path, replace(target, '.', '/') AS related_file FROM (SELECT file_path, unnest({_TARGETS}) AS target FROM g WHERE file_path <> '') WHERE replace(target, '.', '/') <> file_path)"


def _graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRAPH_ROWS, "chunk_id long, file_path string, source string, text string")


@query(f"WITH g AS (SELECT * FROM {_GRAPH}), {_EDGES} SELECT * FROM edges")
def import_edges(spark, sf_dir):
    """G1."""
    return related.import_edges(_graph(spark))


@query(f"""WITH RECURSIVE g AS (SELECT * FROM {_GRAPH}), {_EDGES},
r AS (SELECT DISTINCT file_path AS start, file_path AS file, 0 AS depth FROM g WHERE file_path <> '' UNION SELECT start, related_file, depth + 1 FROM r JOIN edges ON file = file_path WHERE depth < 2)
SELECT start, file, min(depth)::INTEGER AS depth FROM r GROUP BY ALL""")
def related_files(spark, sf_dir):
    """G2."""
    chunks = _graph(spark)
    return related.related_files(chunks.where("file_path <> ''").select(F.col("file_path").alias("file")), related.import_edges(chunks), 2)


_FILE = "coalesce(nullif(file_path, ''), source, 'unknown')"


@query(f"SELECT {_FILE} AS file, list(chunk_id ORDER BY chunk_id) AS chunk_ids FROM {_GRAPH} GROUP BY 1")
def chunks_by_file(spark, sf_dir):
    """G3."""
    return related.chunks_by_file(_graph(spark))


@query(f"""WITH g AS (SELECT * FROM {_GRAPH}), {_EDGES}, h AS (SELECT * FROM {sql.values(HIT_ROWS, 'query_id BIGINT, chunk_id BIGINT, rank INTEGER')}),
p AS (SELECT *, {_FILE} AS file FROM g), s AS (SELECT DISTINCT query_id, file FROM h JOIN p USING (chunk_id) WHERE query_id IN (SELECT query_id FROM h JOIN g USING (chunk_id) WHERE file_path <> '')),
f AS (SELECT query_id, file FROM s UNION SELECT query_id, related_file FROM s JOIN edges ON s.file = edges.file_path),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file) AS n FROM f) WHERE n <= 3),
c AS (SELECT * FROM (SELECT file, chunk_id, row_number() OVER (PARTITION BY file ORDER BY chunk_id) AS n FROM p) WHERE n <= 5)
SELECT query_id, chunk_id, rank, false AS is_related FROM h UNION ALL
SELECT DISTINCT query_id, chunk_id, NULL::INTEGER, true FROM t JOIN c USING (file) WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM h)""")
def expand_related(spark, sf_dir):
    """G4, G5."""
    return related.expand(spark.createDataFrame(HIT_ROWS, "query_id long, chunk_id long, rank int"), _graph(spark))


# citations -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, s AS "start", e AS "end", greatest(s - 50, 0) AS context_start, least(e + 50, length(text)) AS context_end
FROM {sql.spans(f"(SELECT doc_id, text, '{QUESTION}' AS question FROM documents)", 'doc_id', 'text', 'question')} JOIN documents USING (doc_id)""")
def highlight_spans(spark, sf_dir):
    """One question's words in all documents."""
    found = citations.highlights(F.col("text"), F.lit(QUESTION))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


_ASKED = f"(SELECT DISTINCT unnest({sql.tokens('question')}) AS word FROM {_QUESTIONS})"
_PLACES = f"(SELECT word, count(*) FILTER (n > 0) AS n_texts, sum(n)::BIGINT AS n_places FROM (SELECT word, len(string_split(lower(text), word)) - 1 AS n FROM documents, {_ASKED} WHERE text IS NOT NULL) GROUP BY word HAVING sum(n) > 0)"


@query(f"SELECT word, n_texts, n_places FROM {_PLACES}")
def question_word_places(spark, sf_dir):
    """Every word of the stated questions in all documents, each document read once."""
    words = question_scan.question_words(_questions(spark, sf_dir))
    return question_scan.word_places(_table(spark, sf_dir, "documents"), words)


@query(f"""SELECT query_id, count(*) AS n_words, sum(n_places)::BIGINT AS n_places, max(n_texts) AS most_texts
FROM (SELECT query_id, unnest(list_distinct({sql.tokens('question')})) AS word FROM {_QUESTIONS}) JOIN {_PLACES} USING (word) GROUP BY query_id""")
def question_places(spark, sf_dir):
    """For each stated question how many of its words are in documents, and in how many places."""
    asked = _questions(spark, sf_dir).select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("question")))).alias("word"))
    places = stored(question_scan.word_places(_table(spark, sf_dir, "documents"), asked.select("word").distinct()), "places")
    each = asked.join(places, "word").groupBy("query_id")
    return each.agg(F.count("*").alias("n_words"), F.sum("n_places").alias("n_places"), F.max("n_texts").alias("most_texts"))


@query(f"""SELECT doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_covered, min(s) AS first_start, max(e) AS last_end FROM {sql.spans(f"(SELECT doc_id, text, (SELECT string_agg(question, ' ') FROM {_QUESTIONS}) AS question FROM documents)", 'doc_id', 'text', 'question')} GROUP BY doc_id""")
def question_spans_merged(spark, sf_dir):
    """What the stated questions together mark in each document, merged across rows."""
    words = question_scan.question_words(_questions(spark, sf_dir))
    return question_scan.covered_summary(question_scan.covered_cells(_table(spark, sf_dir, "documents"), words))


CITE_ROWS = [(0, "ends with the match", "match"), (1, "aaa aa", "aa a"), (2, "thing in things", "in thing"), (3, "one\ntwo one\nthree one", "one two one"), (4, "", "x"), (5, "no hit", "zzz"), (6, "über ÜBER", "über"), (7, "x" * 600 + " tail", "tail")]
_CITE = sql.values(CITE_ROWS, "id BIGINT, text VARCHAR, question VARCHAR")


@query(f"SELECT id, s AS char_start, e AS char_end, {sql.line_number('text', 's')} AS line_start, {sql.line_number('text', '(e - 1)')} AS line_end FROM {sql.spans(_CITE, 'id', 'text', 'question')} JOIN {_CITE} USING (id)")
def highlight_merge(spark, sf_dir):
    """I1-I3, F3 on odd texts."""
    rows = spark.createDataFrame(CITE_ROWS, "id long, text string, question string")
    spans = citations.citation_lines(F.col("text"), citations.merge_spans(citations.keyword_spans(F.col("text"), F.col("question"))))
    return rows.select("id", F.explode(spans).alias("s")).select("id", "s.char_start", "s.char_end", "s.line_start", "s.line_end")


@query(f"SELECT doc_id, {sql.line_number('text', '(length(text) - 1)')} AS last_line, {sql.line_number('text', '(length(text) // 2)')} AS middle_line, {sql.line_number('text', 'length(text)')} AS outside FROM documents")
def line_numbers(spark, sf_dir):
    """F3."""
    t, n = F.col("text"), F.length("text")
    middle = F.expr("CAST(length(text) div 2 AS INT)")
    return _table(spark, sf_dir, "documents").select("doc_id", tx.line_number(t, n - 1).alias("last_line"), tx.line_number(t, middle).alias("middle_line"), tx.line_number(t, n).alias("outside"))


@query(f"""WITH s AS (SELECT * FROM {sql.spans(_CITE, 'id', 'text', 'question')}), c AS (SELECT * FROM {_CITE}),
parts AS (SELECT id, s, substr(text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || '**' || substr(text, s + 1, e - s) || '**' AS part FROM s JOIN c USING (id) WINDOW w AS (PARTITION BY id ORDER BY s)),
whole AS (SELECT c.id, coalesce((SELECT string_agg(part, '' ORDER BY s) FROM parts p WHERE p.id = c.id), '') || substr(text, coalesce((SELECT max(e) FROM s WHERE s.id = c.id), 0) + 1) AS t FROM c)
SELECT id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END AS marked FROM whole""")
def format_citation(spark, sf_dir):
    """F9."""
    rows = spark.createDataFrame(CITE_ROWS, "id long, text string, question string")
    spans = citations.citation_lines(F.col("text"), citations.merge_spans(citations.keyword_spans(F.col("text"), F.col("question"))))
    return rows.select("id", "text", spans.alias("s")).select("id", citations.marked(F.col("text"), F.col("s")).alias("marked"))


@query(f"WITH {sql.keyword_ctes(_DOCUMENTS, _QUESTIONS, 10)} SELECT query_id, list(DISTINCT source ORDER BY source) AS sources FROM kw_top JOIN {_DOCUMENTS} USING (chunk_id) GROUP BY 1")
def unique_sources(spark, sf_dir):
    """I4."""
    docs = _documents(spark, sf_dir)
    return citations.sources(keyword.keyword_topk(docs, _questions(spark, sf_dir), 10).join(docs, "chunk_id"))


PROMPT_ROWS = [(i, m, "What is it?", c) for i, (m, c) in enumerate([("Mistral-7B", ["one", "two"]), ("x-instruct", []), ("GEMMA-2b", ["only"]), ("other", ["a\nb", "c"]), ("other", [])])]
_BODY = "'" + "You are a helpful AI assistant. Answer the question based on the provided context. If the answer is not in the context, say so clearly." + "' || chr(10) || chr(10) || 'Context:' || chr(10) || ctx || chr(10) || chr(10) || 'Question: ' || question"


@query(f"""SELECT id, CASE WHEN lower(model) LIKE '%mistral%' OR lower(model) LIKE '%instruct%' THEN '<s>[INST] ' || {_BODY} || chr(10) || chr(10) || 'Answer: [/INST]'
  WHEN lower(model) LIKE '%gemma%' THEN '<start_of_turn>user' || chr(10) || {_BODY} || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) ELSE {_BODY} || chr(10) || chr(10) || 'Answer:' END AS prompt
FROM (SELECT *, coalesce(array_to_string(list_transform(range(len(contexts)), lambda i: 'Context ' || (i + 1) || ':' || chr(10) || contexts[i + 1]), chr(10) || chr(10)), '') AS ctx
      FROM {sql.values(PROMPT_ROWS, 'id BIGINT, model VARCHAR, question VARCHAR, contexts VARCHAR[]')})""")
def prompts(spark, sf_dir):
    """F10."""
    rows = spark.createDataFrame(PROMPT_ROWS, "id long, model string, question string, contexts array<string>")
    return rows.select("id", prompt(F.col("model"), F.col("question"), F.col("contexts")).alias("prompt"))


# store, files and statistics -----------------------------------------------------------------------------------------


@query(f"SELECT (SELECT count(*) FROM {sql.chunks('documents', 'doc_id', sql.clean('text'))}) AS total_chunks, (SELECT max(len(embedding)) FROM embeddings)::INTEGER AS embedding_dim")
def store_stats(spark, sf_dir):
    """A1, A7."""
    chunks = answer.ingest(_table(spark, sf_dir, "documents")).select(F.lit(None).cast("array<float>").alias("embedding"))
    vectors = _table(spark, sf_dir, "embeddings").select("embedding")
    return store.store_stats(chunks).crossJoin(store.store_stats(vectors).select(F.col("embedding_dim").alias("dim"))).select("total_chunks", F.col("dim").alias("embedding_dim"))


@query(f"SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM {sql.chunks('documents', 'doc_id, source', sql.clean('text'))} GROUP BY source")
def chunks_per_source(spark, sf_dir):
    """A5."""
    per_doc = answer.ingest(_table(spark, sf_dir, "documents")).groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_docs"))


@query(f"SELECT row_number() OVER (ORDER BY doc_id, chunk_index) + 99 AS chunk_id, doc_id, chunk_index FROM {sql.chunks('documents', 'doc_id', sql.clean('text'))}")
def store_numbering(spark, sf_dir):
    """K4: the ids that an append after 100 chunks gives."""
    return store.numbered(answer.ingest(_table(spark, sf_dir, "documents")), 100, again=True).select("chunk_id", "doc_id", "chunk_index")


@query("SELECT event_type, count(*) AS count, round(avg(value), 6) AS avg_duration, round(sum(value), 6) AS total_duration, min(value) AS min_duration, max(value) AS max_duration, round(avg(user_id), 6) AS avg_memory_delta FROM events GROUP BY 1")
def op_stats(spark, sf_dir):
    """A2, on events."""
    return store.operation_stats(_table(spark, sf_dir, "events"), "event_type", "value", "user_id")


FILE_ROWS = [("a.pdf", "255044462d312e37"), ("b.PDF", "2550444600"), ("c.pdf", ""), ("d.pdf", "00112233"), ("e.txt", "25504446"), ("f.png", "89504e47"), ("g.JPEG", "ff"), ("h.png", ""), ("i.svg", "3c")]


@query(f"""SELECT path, lower(path) LIKE '%.pdf' AND length(h) BETWEEN 2 AND 104857600 AND upper(substr(h, 1, 8)) = '25504446' AS is_pdf,
regexp_extract(lower(path), '(\\.[^./]+)$', 1) IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.webp') AND length(h) BETWEEN 2 AND 104857600 AS is_image FROM {sql.values(FILE_ROWS, 'path VARCHAR, h VARCHAR')}""")
def validate_files(spark, sf_dir):
    """F12, F13."""
    rows = spark.createDataFrame(FILE_ROWS, "path string, h string").withColumn("content", F.unhex("h"))
    return rows.select("path", files.valid_pdf(F.col("path"), F.col("content")).alias("is_pdf"), files.valid_image(F.col("path"), F.col("content")).alias("is_image"))


USE_ROWS = [(0, None), (1, 0.0), (2, 39.9), (3, 40.0), (4, 69.9), (5, 70.0), (6, 84.9), (7, 85.0), (8, 100.0)]


@query(f"SELECT id, CASE WHEN u IS NULL THEN 64 WHEN u < 40 THEN 128 WHEN u < 70 THEN 64 WHEN u < 85 THEN 32 ELSE 16 END AS batch, printf('%.1f%%', coalesce(u, 0)) AS shown FROM {sql.values(USE_ROWS, 'id BIGINT, u DOUBLE')}")
def batch_sizes(spark, sf_dir):
    """E3, F15."""
    rows = spark.createDataFrame(USE_ROWS, "id long, u double")
    return rows.select("id", scores.batch_size(F.col("u")).alias("batch"), scores.percent(F.coalesce(F.col("u"), F.lit(0.0)) / 100).alias("shown"))


REQUEST_ROWS = [(0, None), (1, ""), (2, " \t\n"), (3, "  what? "), (4, "x" * 10_000), (5, "x" * 10_001), (6, " " * 9_999 + "y"), (7, " " * 10_000 + "y")]


@query(f"SELECT id, CASE WHEN length(text) <= 10000 AND {sql.strip('text')} <> '' THEN {sql.strip('text')} END AS message FROM {sql.values(REQUEST_ROWS, 'id BIGINT, text VARCHAR')}")
def request_limits(spark, sf_dir):
    """What of a request's text is taken."""
    return spark.createDataFrame(REQUEST_ROWS, "id long, text string").select("id", ingestion.accepted(F.col("text")).alias("message"))


@query(f"SELECT query_id, NULL::VARCHAR AS first_source, '{answer.NO_DOCUMENTS}' AS answer FROM {_QUESTIONS} WHERE {sql.strip('question')} IS NOT NULL")
def empty_store_answers(spark, sf_dir):
    """The stated questions against a store in which nothing has been ingested."""
    nothing = store.ChunkStore(spark, fresh_path(spark, "store"))
    return answer.answer(nothing.load(), _questions(spark, sf_dir)).select("query_id", F.get("sources", F.lit(0)).alias("first_source"), "answer")


# ingestion -----------------------------------------------------------------------------------------------------------

_FILE = "substr(sha256(file_path), 1, 32) AS doc_id, regexp_extract(file_path, '([^/]*)$', 1) AS source"
_STRUCTURE_TEXT = f"""SELECT s.file_path, line_start, line_end, rtrim(array_to_string(string_split(code, chr(10))[line_start:line_end], chr(10)), chr(10)) AS text, 'function' AS type, name, class
FROM {sql.values(_STRUCTURES, 'file_path VARCHAR, name VARCHAR, class VARCHAR, line_start INTEGER, line_end INTEGER')} s JOIN {sql.values(STRUCTURE_ROWS, 'path VARCHAR, code VARCHAR')} f ON s.file_path = f.path"""


@query(f"""WITH files AS (SELECT * FROM {sql.values(CODE_ROWS, 'path VARCHAR, code VARCHAR')} UNION ALL SELECT 'n.js', '{STRUCTURE_ROWS[1][1].replace(chr(10), "' || chr(10) || '")}'),
each AS ({_STRUCTURE_TEXT} UNION ALL SELECT path, k + 1, least(k + 50, len(l)), array_to_string(l[k + 1:k + 50], chr(10)), 'code_block', NULL, NULL
  FROM (SELECT path, l, unnest(range(0, len(l), 50)) AS k FROM (SELECT path, string_split(code, chr(10)) AS l FROM files)) WHERE length({sql.strip("array_to_string(l[k + 1:k + 50], chr(10))")}) >= 50)
SELECT {_FILE}, file_path, {_LANGUAGE.replace('lower(path)', 'lower(file_path)')} AS language, (row_number() OVER f - 1)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY file_path))::INTEGER AS total_chunks,
  line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, text, type, name, class FROM each WINDOW f AS (PARTITION BY file_path ORDER BY line_start)""")
def code_ingestion(spark, sf_dir):
    """Functions of files in which they are found, else blocks."""
    return ingestion.ingest_code(spark.createDataFrame(CODE_ROWS + STRUCTURE_ROWS, "path string, code string"), structures=True)


@query(f"""SELECT 'img/' || name AS file_path, substr(sha256('img/' || name), 1, 32) AS doc_id, name AS source, 'image' AS type, 640 AS image_width, 480 AS image_height, 'PNG' AS image_format, coalesce(length(ocr), 0) > 0 AS has_ocr_text,
unnest(range(len(c)))::INTEGER AS chunk_index, len(c)::INTEGER AS total_chunks, unnest(c) AS text FROM (SELECT name, text AS ocr, CASE WHEN coalesce(text, '') = '' THEN ['[Image: ' || name || ']'] ELSE [text] END AS c FROM {sql.values([r for r in OCR_ROWS if len(r[1] or '') <= 100], 'name VARCHAR, text VARCHAR')})""")
def image_ingestion(spark, sf_dir):
    """Images whose recognised text is short or absent, as the store keeps them; long ones are in ocr_chunks."""
    rows = spark.createDataFrame([r for r in OCR_ROWS if len(r[1] or "") <= 100], "name string, ocr_text string")
    text = F.length(F.coalesce("ocr_text", F.lit(""))) > 0
    return ingestion.ingest_images(rows.select(F.concat(F.lit("img/"), "name").alias("path"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("PNG").alias("format"), "ocr_text", text.alias("has_text")))


@query(f"""WITH c AS (SELECT doc_id, chunk_index, chunk_text FROM {sql.chunks('documents', 'doc_id, source', sql.clean('text'))}),
n AS (SELECT doc_id % 2 AS half, row_number() OVER (ORDER BY doc_id % 2, doc_id, chunk_index) - 1 AS chunk_id, * FROM c)
SELECT chunk_id, doc_id::VARCHAR AS doc_id, chunk_index, chunk_text AS text FROM n""")
def store_round_trip(spark, sf_dir):
    """Two appends, the second one made twice as after a failure, and what is loaded."""
    kept = store.ChunkStore(spark, fresh_path(spark, "store"))
    chunks = answer.ingest(_table(spark, sf_dir, "documents"))
    for half in ("0", "1", "1"):
        kept.append(chunks.where(F.col("doc_id") % 2 == int(half)), batch=half)
    return kept.load().select("chunk_id", "doc_id", "chunk_index", "text")


@query(f"""SELECT token, count(*) AS df FROM (SELECT text, chunk_index, unnest(list_distinct({sql.tokens('chunk_text')})) AS token
FROM {sql.chunks('(SELECT DISTINCT text FROM documents)', 'text', sql.clean('text'))}) GROUP BY token""")
def stream_unique_frequencies(spark, sf_dir):
    """Documents that arrive in two runs of a stream, some again in the second; each text is counted once."""
    arrived, segments, checkpoint = (fresh_path(spark, name) for name in ("arrived", "segments", "stream"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    for part in ("doc_id % 2 = 0", "doc_id % 4 <> 2 OR doc_id IS NULL"):
        docs.where(part).write.mode("append").parquet(arrived)
        stream = streaming.stream_documents(spark, arrived, "doc_id long, source string, text string")
        unique.ingest_unique(stream, segments, checkpoint).awaitTermination()
    return unique.frequencies(spark, segments)


# whole plans ---------------------------------------------------------------------------------------------------------

_CHUNKS = "chunks"
_NUMBERED = f"chunks AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS chunk_id, source, chunk_text AS text FROM {sql.chunks('documents', 'doc_id, source', sql.clean('text'))})"


@query(f"""WITH {_NUMBERED}, asked AS (SELECT * FROM {_QUESTIONS}), {_hybrid_sql(_CHUNKS, 'asked', 60)},
top AS (SELECT * FROM {sql.fused('kw_top', 'sem_top', 20, 0.3)}),
scored AS (SELECT query_id, chunk_id, question, text, source, top.score AS fused_score, {_overlap_sql('question', 'text')} AS score FROM top JOIN chunks USING (chunk_id) JOIN asked USING (query_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5),
marks AS (SELECT query_id, chunk_id, count(*) AS n FROM {sql.spans('best', 'query_id, chunk_id', 'text', 'question')} GROUP BY ALL)
SELECT query_id, chunk_id, source, text, fused_score, score, rank::INTEGER AS rank, coalesce(n, 0)::INTEGER AS highlight_count, ({sql.line_number('text', '(length(text) - 1)')})::INTEGER AS line_end
FROM best LEFT JOIN marks USING (query_id, chunk_id)""")
def rag_contexts_batch(spark, sf_dir):
    """Ingest all documents, answer the stated questions: hybrid candidates, reranked, cited."""
    model = embedding.HashingEmbedder()
    chunks = embedding.embed(store.numbered(answer.ingest(_table(spark, sf_dir, "documents")), 0, again=True), model)
    hits = answer.retrieve(chunks, _questions(spark, sf_dir), embedder=model)
    return citations.cite(hits).select("query_id", "chunk_id", "source", "text", "fused_score", "score", "rank", "highlight_count", "line_end")


@query(f"""WITH {_NUMBERED}, {sql.keyword_ctes(_CHUNKS, _ONE, 5)}, best AS (SELECT kw_top.*, source, text FROM kw_top JOIN chunks USING (chunk_id)),
marks AS (SELECT chunk_id, count(*) AS n FROM {sql.spans(f"(SELECT chunk_id, text, '{QUESTION}' AS question FROM best)", 'chunk_id', 'text', 'question')} GROUP BY ALL)
SELECT query_id, chunk_id, source, text, score, rank::INTEGER AS rank, coalesce(n, 0)::INTEGER AS highlight_count FROM best LEFT JOIN marks USING (chunk_id)""")
def keyword_answers(spark, sf_dir):
    """The keyword path end to end: clean, chunk, rank, cite."""
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited keyword hits of one question over all documents."""
    chunks = store.numbered(answer.ingest(_table(spark, sf_dir, "documents")), 0, again=True)
    found = texts_of(keyword.keyword_topk(chunks, _one(spark), 5), chunks).join(_one(spark), "query_id")
    return citations.cite(found).select("query_id", "chunk_id", "source", "text", "score", "rank", "highlight_count")
