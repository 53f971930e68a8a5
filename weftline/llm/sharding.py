"""Proportional stratified interleaving (DataFrame functions only).

Rows are shuffled by a seeded digest and ranked within their source; a row's fractional rank ``(rank - 1/2) / n`` says
how far through its source it stands, and a seeded phase of the source turns it around the circle, so that many small
sources spread over all of it. Sorted by it, all sources advance at the same pace, so every contiguous cut has the mixture
of the whole. The sorted order is cut into shards whose row counts differ by at most one (law ``rows``).

No source and no sort is ever ranked in one task: both rankings are two-level. Rows are dealt by a prefix of the digest
(then of the fractional rank) to buckets of at most about ``BUCKET_ROWS`` rows, buckets are counted, counts are summed up
over one row for each, and ``row_number`` runs only inside a bucket. Texts are measured at the scan and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.shared import documents, text_or_empty, written

SEED = "weftline"
#: Rows that a bucket of either ranking has, about; 16 to the power of ``PREFIX`` buckets at least.
BUCKET_ROWS, PREFIX = 1_000_000, 3


def _before(df: DataFrame, keys: list[str], bucket: str, name: str) -> DataFrame:
    """(keys, bucket, rows in earlier buckets of the same keys); one row per bucket that occurs."""
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("__n"))
    return counts.select(*keys, bucket, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(name))


def interleave(
    docs: DataFrame,
    n_shards: int,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` counts from 0 without gaps in each shard. Null texts have size 1 and the CRC of the empty text; rows
    without a source form a source of their own. Ties (repeated ids) are ordered by size and CRC, and rows that agree in
    those too are interchangeable. An empty table gives no rows; other columns are not read.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("__source"),
    ).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = written(rows, "shard-rows")
    digits, n = PREFIX, rows.count()
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    rows, buckets = rows.withColumn("__b", F.substring("__h", 1, digits)), 16**digits

    totals = rows.groupBy("__source").agg(F.count("*").alias("__total"))
    offsets = _before(rows, ["__source"], "__b", "__before").join(totals, "__source")
    tie = ["doc_id", "size", "text_crc32"]
    inside = Window.partitionBy("__source", "__b").orderBy("__h", *tie)
    ranked = rows.withColumn("__r", F.row_number().over(inside)).join(offsets, ["__source", "__b"])
    fraction = ranked.withColumn("__f", (F.col("__before") + F.col("__r") - 0.5) / F.col("__total")).drop("__b", "__r", "__before", "__total")
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "__source")), 1, 8), 16, 10).cast("double") / 2**32
    fraction = fraction.withColumn("__f", F.col("__f") + phase).withColumn("__f", F.col("__f") - F.floor("__f"))
    fraction = written(fraction.withColumn("__fb", F.floor(F.col("__f") * buckets)), "shard-fractions")

    # at most one row for each bucket; the count of all rows is theirs
    steps = _before(fraction.withColumn("__all", F.lit(0)), ["__all"], "__fb", "__start").drop("__all")
    n_rows = fraction.agg(F.count("*").alias("__rows"))
    inner = Window.partitionBy("__fb").orderBy("__f", "__source", "__h", *tie)
    placed = (
        fraction.withColumn("__i", F.row_number().over(inner) - 1)
        .join(F.broadcast(steps), "__fb")
        .crossJoin(F.broadcast(n_rows))  # one row
        .withColumn("__pos", F.col("__start") + F.col("__i"))
        .withColumn("shard", F.expr(f"__pos * {int(n_shards)} div __rows").cast("int"))
    )
    # the first position of a shard is the least p with floor(p * n_shards / rows) = shard
    first = F.expr(f"(shard * __rows + {int(n_shards) - 1}) div {int(n_shards)}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("__pos") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir):
    """op3: all ``documents`` into shards 0 to 15."""
    return interleave(documents(spark, sf_dir), 16)


ORACLE = r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8))) AS text_crc32,
         coalesce('s' || source, 'n') AS src, md5('weftline:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents, tab
),
f AS (
  SELECT * EXCLUDE (turned), turned - floor(turned) AS fr
  FROM (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY h, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY src)
               + ('0x' || substr(md5('weftline:' || src), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS turned FROM d)
),
p AS (
  SELECT *, row_number() OVER (ORDER BY fr, src, h, doc_id) - 1 AS pos, count(*) OVER () AS n FROM f
),
s AS (SELECT *, (pos * 16) // n AS sh FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, sh::INTEGER AS shard,
       (row_number() OVER (PARTITION BY sh ORDER BY pos) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""
