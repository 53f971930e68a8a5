"""Token counts by offset-mapped attribution.

Each document is encoded once. The bytes that its tokens stand for give every token a byte span; an interval join of
those spans with the spans of sections (two binary searches per section over sorted bounds) attributes the tokens. A
token that crosses a boundary is allocated by an explicit rule: ``start`` - the section that holds its first byte - or
``end`` - the one that holds its last byte; ``token_share`` splits it in proportion to its bytes on either side. Where
the sections tile a text, each rule adds up to the tokens of the text. One Arrow stage, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.encode import encoder, vocabulary
from weftline.llm.shared import documents

BATCH = 256
RULES = ("start", "end")


def line_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the lines of a text, each with its line break; an empty text is one empty line."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.append(0, ends[:-1]), ends


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens by the rule, boundary-crossing tokens, share) of sections [lo, hi) over tokens [starts, ends)."""
    places = starts if rule == "start" else ends - 1
    counted = np.searchsorted(places, hi) - np.searchsorted(places, lo)
    touching = np.searchsorted(starts, hi) - np.searchsorted(ends, lo, "right")
    inside = np.searchsorted(ends, hi, "right") - np.searchsorted(starts, lo)
    empty = hi <= lo
    counted[empty], touching[empty], inside[empty] = 0, 0, 0
    at = np.append(starts, ends[-1:] if len(ends) else 0)
    index = np.arange(len(at))
    share = np.interp(hi, at, index) - np.interp(lo, at, index) if len(at) else np.zeros(len(lo))
    return counted, touching - np.maximum(inside, 0), share


def token_counts(
    docs: DataFrame, vocabulary_path: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None
) -> DataFrame:
    """One row per section: doc_id, section, begin_char, end_char, n_tokens, n_crossing, token_share.

    ``spans_col`` names an array of structs (begin, end) in code points, end exclusive; spans may overlap or leave gaps
    and are clipped to the text; a null or empty array gives no rows. Without it the sections are the lines of the text.
    Null texts count as empty and have one empty line. Ids may be null or repeat; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if spans_col:
        columns += [F.transform(spans_col, lambda s: s["begin"].cast("int")).alias("lo"), F.transform(spans_col, lambda s: s["end"].cast("int")).alias("hi")]
    chosen = docs.select(*columns)
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, section int, begin_char long, end_char long, n_tokens long, n_crossing long, token_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                yield sections(whole.slice(at, BATCH), encode)

    def sections(batch: pa.RecordBatch, encode) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        spans = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) if spans_col else [None] * len(texts)
        rows, parts = [], []
        for row, (text, ids, span) in enumerate(zip(texts, encode(texts), spans, strict=True)):
            data = text.encode("utf-8", "surrogatepass")
            ends = np.cumsum(encode.lengths[np.frombuffer(ids, "<u4")])
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            # chars[i]: code points that begin before byte i
            chars = None if len(data) == len(text) else np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
            if span is None:
                lo, hi = line_bounds(data)
                begin, end = (lo, hi) if chars is None else (chars[lo], chars[hi])
            else:
                if span[0] is None or not len(span[0]):
                    continue
                begin = np.clip(np.array([x or 0 for x in span[0]]), 0, len(text))
                end = np.clip(np.array([x or 0 for x in span[1]]), 0, len(text))
                lo, hi = begin, end
                if chars is not None:
                    first = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
                    lo, hi = first[begin], first[end]
            rows.append(np.full(len(lo), row))
            parts.append((np.arange(len(lo)), begin, end, *attribute(starts, ends, lo, hi, rule)))
        names = ["doc_id", "section", "begin_char", "end_char", "n_tokens", "n_crossing", "token_share"]
        types = [pa.int32(), *[pa.int64()] * 4, pa.float64()]
        ids = batch.column(0).take(pa.array(np.concatenate(rows) if rows else [], pa.int64()))
        data = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0), t, safe=False) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([ids, *data], names=names)

    return chosen.mapInArrow(run, schema)


def query(spark, sf_dir):
    """op1: the lines of all ``documents``."""
    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
