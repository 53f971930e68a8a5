"""A stream of documents with repeats, stopped and started again, against the table of its distinct texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import keyword
from weftline.operators.store import ChunkStore
from weftline.streaming import ingest, unique

ROWS = [(1, "a", "One sentence that is long enough. Another one that is long enough too."), (2, "b", None), (3, "b", ""), (4, None, "Short words, all of them short.")]
SCHEMA = "doc_id long, source string, text string"


def test_repeats_restarts_and_replays(spark, tmp_path):
    folder, segments, checkpoint = (str(tmp_path / name) for name in ("in", "segments", "checkpoint"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    odd = spark.createDataFrame([*ROWS, *((i, "copy", ROWS[0][2]) for i in range(500))], SCHEMA)
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert unique.frequencies(spark, segments).count() == 0
    for arrived in (docs.where("doc_id % 2 = 0"), docs.union(odd), odd.union(docs)):
        arrived.repartition(3).write.mode("append").parquet(folder)
        unique.ingest_unique(ingest.stream_documents(spark, folder, SCHEMA), segments, checkpoint, store).awaitTermination()
    texts = docs.union(odd).select("text").distinct()
    chunks = ingest.stream_chunks(texts.withColumns({"doc_id": F.lit(0), "source": F.lit("s")}))
    wanted = {tuple(r) for r in keyword.document_frequencies(chunks).collect()}
    assert {tuple(r) for r in unique.frequencies(spark, segments).collect()} == wanted
    assert sorted(r.text for r in store.load().select("text").collect()) == sorted(r.text for r in chunks.select("text").collect())
    # The last batch once more, as after a failure behind its writes.
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    unique.ingest_unique(ingest.stream_documents(spark, folder, SCHEMA), segments, checkpoint, store).awaitTermination()
    assert {tuple(r) for r in unique.frequencies(spark, segments).collect()} == wanted
    assert store.load().count() == chunks.count()


def test_of_a_table_one_of_each_text(spark):
    rows = [*ROWS, (1, "a", ROWS[0][2]), (None, None, "Short words, all of them short.")]
    found = unique.unique_documents(spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit("x"), "part": F.lit(1)}))
    assert sorted(r.text or "" for r in found.collect()) == sorted({text or "" for *_, text in ROWS})
