"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in time
linear in the features of a text. Inputs come from the text alone: its words, hashed and weighted by frequency, and
statistics of its shape, both as values and by quantile bin. Labels, language, source and ids are never inputs.

Training fits a bounded sample (``sample_rows`` labelled documents, chosen by a digest of the id) on the driver; the
executors compute its features. Scoring is one Arrow stage over all documents with the model in the closure.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import documents

#: Labelled documents that the model is fitted to, at most.
SAMPLE_ROWS = 6000
WORD_BUCKETS = 1 << 15
FACTORS = 4
BINS = 8
#: Mini-batches of training, whatever the size of the sample.
UPDATES = 600
THRESHOLD = 0.3
FOLDS = 5
#: Texts that are scored at a time.
BATCH = 256
#: Words whose bucket a worker remembers.
BUCKET_WORDS = 100_000

STATS = ("words", "word_length", "upper", "distinct", "top_share", "repeats", "punctuation", "symbols", "digits", "non_ascii", "lines", "line_repeats")
_PUNCTUATION = b"!\"'(),-.:;?"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_DIGITS = b"0123456789"
_BUCKET_OF: dict[bytes, int] = {}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, word buckets, word weights of length one) of a whole text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    counts = Counter(words)
    lines = data.split(b"\n")
    without = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    upper = sum(c for w, c in counts.items() if len(w) > 1 and (s := w.decode("utf-8", "replace")).isupper() and s[0].isalpha())
    stats = np.array(
        [
            np.log1p(len(words)), len(data) / n, upper / n, len(counts) / n, max(counts.values(), default=0) / n,
            sum(map(operator.eq, words, words[1:])) / n, without(_PUNCTUATION), without(_SYMBOLS), without(_DIGITS),
            1 - len(text) / size if text else 0.0, len(lines) / n, 1 - len(set(lines)) / len(lines),
        ]
    )
    if len(_BUCKET_OF) > BUCKET_WORDS:
        _BUCKET_OF.clear()
    known = _BUCKET_OF
    for w in counts:
        if w not in known:
            known[w] = zlib.crc32(w.lower()) % WORD_BUCKETS
    buckets = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
    weights = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    return stats, buckets, weights / max(1e-9, np.sqrt((weights**2).sum()))


@dataclass
class Model:
    """A fitted machine and the scale of its statistics."""

    mean: np.ndarray
    spread: np.ndarray
    edges: np.ndarray  # (statistics, BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def inputs(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first feature of each row, feature indices, values) of several texts, end to end."""
        k = len(STATS)
        stats = np.array([r[0] for r in rows])
        scaled = np.clip((stats - self.mean) / self.spread, -3, 3) / 3
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(k)], axis=1)
        own = np.arange(k)
        index, value, first = [], [], [0]
        for i, (_, buckets, weights) in enumerate(rows):
            index += [own, k + own * BINS + bins[i], k + k * BINS + buckets]
            value += [scaled[i], np.full(k, 0.5), weights]
            first.append(first[-1] + 2 * k + len(buckets))
        return np.array(first[:-1]), np.concatenate(index), np.concatenate(value)

    def raw(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, factor sums) of each row, by the sum-of-squares identity."""
        weighted = self.factors[index] * value[:, None]
        sums = np.add.reduceat(weighted, first, axis=0)
        squares = np.add.reduceat((weighted**2).sum(axis=1), first)
        return self.bias + np.add.reduceat(self.linear[index] * value, first) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scores of whole texts; few of them are Python strings at a time."""
        out = np.zeros(len(texts))
        for at in range(0, len(texts), BATCH):
            z, _ = self.raw(*self.inputs([features(t) for t in texts.slice(at, BATCH).to_pylist()]))
            out[at : at + BATCH] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, updates: int = UPDATES, rate: float = 0.1, decay: float = 2e-5, batch: int = 64) -> Model:
    """Fits a machine by AdaGrad on the logistic loss, in a fixed order. Without rows every text scores one half."""
    size = len(STATS) * (1 + BINS) + WORD_BUCKETS
    rng = np.random.default_rng(0)
    stats = np.array([r[0] for r in rows]) if rows else np.zeros((1, len(STATS)))
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    share = np.clip(labels.mean(), 0.01, 0.99) if rows else 0.5
    m = Model(stats.mean(axis=0), stats.std(axis=0) + 1e-6, edges, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)) * bool(rows))
    seen_linear, seen_factors = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    done = 0
    while rows and done < updates:
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen, done = order[at : at + batch], done + 1
            first, index, value = m.inputs([rows[i] for i in chosen])
            z, sums = m.raw(first, index, value)
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[chosen]) / len(chosen) ** 0.5
            owner = np.repeat(np.arange(len(chosen)), np.diff([*first, len(index)]))
            slope = error[owner] * value
            used, place = np.unique(index, return_inverse=True)
            gain = slope[:, None] * (sums[owner] - m.factors[index] * value[:, None])
            g = np.bincount(place, slope, len(used)) + decay * m.linear[used]
            seen_linear[used] += g**2
            m.linear[used] -= rate * g / np.sqrt(seen_linear[used])
            for f in range(FACTORS):
                g = np.bincount(place, gain[:, f], len(used)) + decay * m.factors[used, f]
                seen_factors[used, f] += g**2
                m.factors[used, f] -= rate * 0.5 * g / np.sqrt(seen_factors[used, f])
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def held_out(id_col: str) -> F.Column:
    """Whether an id belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of ``labels`` from a bounded sample outside the held-out fold; null ids and labels are left out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = known.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    chosen = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("__doc", "__label", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            arrays = [pa.array([r[k].tolist() for r in found], pa.list_(t)) for k, t in enumerate((pa.float64(), pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc", "label", "stats", "buckets", "weights"])

    kind = chosen.schema["__doc"].dataType.simpleString()
    table = chosen.mapInArrow(run, f"doc {kind}, label int, stats array<double>, buckets array<int>, weights array<float>").toArrow().sort_by([("doc", "ascending"), ("label", "ascending")])
    columns = []
    for c in ("stats", "buckets", "weights"):  # slices of the Arrow values, in their own types: no objects or copies of the numbers
        lists = pa.concat_arrays(table[c].chunks) if table.num_rows else pa.array([], table.schema.field(c).type)
        values, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
        columns.append([values[i:j] for i, j in pairwise(bounds)])
    marks = table["label"].to_numpy().astype(float)
    model = fit(list(zip(*columns, strict=True)), marks)
    del table, columns, lists, values
    pa.default_memory_pool().release_unused()  # the driver keeps the model alone
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts are scored as texts without words."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], names=["doc_id", "score"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``; rows are filtered where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(batch.schema.names.index(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    """op9: every whole text of ``documents``."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
