"""Embeddings by a pluggable model, each distinct text once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import HELD, text_key, word_lists


#: Tokens whose buckets a worker remembers.
REMEMBERED = 500_000


class Embedder(Protocol):
    """A model: its name, and a matrix with one row per text. Loaded once per worker where it is pickled lazily."""

    name: str

    def embed(self, texts: list[str]) -> np.ndarray:
        """Vectors of ``texts``."""
        ...


class HashingEmbedder:
    """A deterministic stand-in for a model: token counts in hashed buckets, length one. Its scores say nothing of a model's quality."""

    def __init__(self, dim: int = 64):
        self.dim, self.name, self.known = dim, f"hashing-{dim}", {}

    def embed(self, texts: list[str]) -> np.ndarray:
        """Vectors of ``texts``; a text without tokens is the zero vector. Distinct tokens are hashed once as long as they are remembered."""
        lists = word_lists(pa.array([text.lower() for text in texts], pa.string()))
        coded = lists.flatten().dictionary_encode()
        words, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        if len(known) > REMEMBERED:
            known.clear()
        known.update([(w, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim) for w in words if w not in known])
        buckets = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        place = row * self.dim + buckets[coded.indices.to_numpy()]
        out = np.bincount(place, minlength=len(texts) * self.dim).astype(float).reshape(len(texts), self.dim)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """``df`` with the vectors of its texts; null texts have none. The model gets ``HELD`` texts at most at a time."""

    def made(texts: pa.Array) -> pa.Array:
        known = texts.drop_null().to_pylist()
        matrix = np.asarray(embedder.embed(known), float) if known else np.zeros((0, 0))
        present = texts.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(present * matrix.shape[1])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()), mask=pa.array(~present))

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([made(texts.slice(at, HELD)) for at in range(0, len(texts), HELD)] or [pa.array([], pa.list_(pa.float64()))])

    return df.withColumn(out_col, vectors(F.col(text_col)))


def embed_cached(df: DataFrame, embedder: Embedder, cache: DataFrame | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``df`` with embeddings, the new cache rows): distinct texts that the cache (model, key, embedding) lacks are embedded once."""
    keyed = df.withColumn("__key", text_key(F.col(text_col)))
    wanted = keyed.where("__key IS NOT NULL").select("__key", F.col(text_col).alias("__text")).dropDuplicates(["__key"])
    own = None
    if cache is not None:
        own = cache.where(F.col("model") == embedder.name).select(F.col("key").alias("__key"), "embedding")
        wanted = wanted.join(own, "__key", "left_anti")
    fresh = embed(wanted, embedder, "__text").select("__key", "embedding")
    known = fresh if own is None else fresh.unionByName(own)
    return keyed.join(known, "__key", "left").drop("__key"), fresh.select(F.lit(embedder.name).alias("model"), F.col("__key").alias("key"), "embedding")
