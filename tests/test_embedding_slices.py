"""A model gets a bounded number of texts at a time, whatever the batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weftline.functions.text import HELD
from weftline.operators.embedding import embed


def test_slices_and_nulls(spark):
    class Counting:
        name = "counting"

        def embed(self, texts):
            return np.array([[len(texts), float(t)] for t in texts])

    rows = spark.range(1000).repartition(1).select("id", F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("text"))
    got = {r.id: r.embedding for r in embed(rows, Counting()).select("id", "embedding").collect()}
    assert all((v is None) == (i % 10 == 0) and (v is None or v[1] == i) for i, v in got.items())
    assert 0 < max(v[0] for v in got.values() if v) <= HELD
    nulls = embed(rows.where("text IS NULL"), Counting()).select("embedding").distinct().collect()
    assert [r.embedding for r in nulls] == [None]
