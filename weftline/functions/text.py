"""Text columns: cleaning, tokens, sentences, places."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spaces that become U+0020, and the white space that can end a line once tabs and controls are gone.
UNICODE_SPACES = "\u00a0\u2009\u2006\u2002\u2003"
LINE_SPACE = r" \r\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CONTROL = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]"
#: All white space that Python strips.
ANY_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same, one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]+"
#: A sentence is a run up to and with its closing marks; a documented approximation without statistics.
SENTENCE = r"[^.!?]+[.!?]*"
MIN_SENTENCE = 10


_LINE_SPACES = "".join(c for c in SPACES if c not in "\t\n\x0b\x0c\x1c\x1d\x1e\x1f\xa0")
#: Texts of a slice of a batch.
HELD = 256
#: Texts whose code points are looked at together, so that they stay in the processor's cache.
FEW = 16


def cleaned(text: str) -> str:
    """Normalised spaces and line breaks, no control characters, no white space at the ends of lines."""
    for space in UNICODE_SPACES:  # each a search for one character: much faster than translating every character
        text = text.replace(space, " ")
    t = re.sub(" {3,}", "  ", re.sub("\n{3,}", "\n\n", text))
    t = re.sub(CONTROL, "", t).replace("\t", " ")
    return "\n".join(line.rstrip(_LINE_SPACES) for line in t.split("\n")).strip(_LINE_SPACES + "\n")


def per_text(make: Callable[[str | None], object], kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A column function by a Python function of one text; a worker holds ``HELD`` texts as strings at a time."""

    @F.arrow_udf(kind)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = (texts.slice(at, HELD).to_pylist() for at in range(0, len(texts), HELD))
            yield pa.concat_arrays([pa.array(map(make, part), arrow) for part in parts] or [pa.array([], arrow)])

    return made


def clean_text(text: Column) -> Column:
    """``cleaned`` texts; null is empty."""
    return per_text(lambda t: cleaned(t or ""), "string", pa.string())(text)


def stripped(text: Column) -> Column:
    """``text`` without white space at either end."""
    return F.trim(text, F.lit(SPACES))


def tokens(text: Column) -> Column:
    """Lower-case words in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


@functools.cache
def _of_words() -> np.ndarray:
    """For each code point whether it belongs to words: letters, numbers and the underscore."""
    points = (unicodedata.category(chr(i))[0] in "LN" or chr(i) == "_" for i in range(sys.maxunicode + 1))
    return np.fromiter(points, bool, sys.maxunicode + 1)


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of lower-case texts as ``tokens`` has them, a list for each text; null texts have none. For functions inside tasks."""
    parts = [_word_lists(texts.slice(at, FEW)) for at in range(0, len(texts), FEW)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def _word_lists(texts: pa.Array) -> pa.ListArray:
    """The same, all texts as one array of code points."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = bytes(memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]) if offsets[-1] > offsets[0] else b""
    byte, ends = np.frombuffer(data, np.uint8), (offsets[1:] - offsets[0]).astype(np.int64)
    if data.isascii():
        held, size = _of_words()[byte], None
    else:
        try:
            points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        except UnicodeDecodeError:  # bytes that are no text
            return _word_lists(pa.array([data[a:b].decode(errors="replace") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.string()))
        held, size = _of_words()[points], (points >= 0x80).view(np.uint8)
        size = size + (points >= 0x800) + (points >= 0x10000) + np.uint8(1)
        ends = np.searchsorted(np.cumsum(size, dtype=np.int32), ends, "right")  # in code points
        ends[-1:] = len(points)
    first = np.zeros(len(held) + 1, bool)
    first[0] = first[ends] = True
    start = held & first[:-1]
    start[1:] |= held[1:] > held[:-1]
    starts = np.flatnonzero(start)
    wide = np.cumsum(held if size is None else held * size, dtype=np.int32)
    kept = byte[held if size is None else np.repeat(held, size)]
    bounds = np.append(wide[starts] - (1 if size is None else size[starts]), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(starts, ends)).astype(np.int32)), words)


def sentences(text: Column) -> Column:
    """Stripped sentences of more than ten characters."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), stripped), lambda s: F.length(s) > MIN_SENTENCE)


def line_number(text: Column, position: Column) -> Column:
    """The line, from 1, of a position from 0; 1 where the position is outside the text."""
    before = F.substring(text, F.lit(1), position)
    counted = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when((position >= 0) & (position < F.length(text)), counted).otherwise(F.lit(1))


def text_key(text: Column) -> Column:
    """The key under which an embedding of the text is kept."""
    return F.sha2(text, 256)
