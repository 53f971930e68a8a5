"""Byte-level BPE ids of whole texts, with a bounded memory of words.

A byte-level pre-tokenizer of this family always starts a piece at a space that stands before a non-space. So a text in
which no two spaces are adjacent may be cut at its spaces, each cut keeping its leading space, and the ids of the cuts
joined are the ids of the text; the strings of special tokens, which the library finds in texts too, hold no space. Texts
with adjacent spaces are encoded whole. A piece also ends where a letter stands before what is no letter, and on both sides
of a single line break between visible characters, so texts are cut there too (``CUTS``); these cuts have no leading space.
Arrow cuts a batch, gives the distinct cuts, and gathers their ids in the end.
Frequent cuts are encoded once per worker process. Either way every id comes from the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers in each of two generations; about 250 bytes each.
MEMO_WORDS = 300_000
#: Longer words are encoded each time and not remembered.
MEMO_LENGTH = 64
#: Bytes of texts that are cut at a time.
SLICE = 4_000_000
#: Stands at the begin of a cut that has no leading space; texts that have this character themselves are encoded whole.
TAIL = "\x01"
#: Letters up to this one are letters of every version of Unicode.
LAST_LETTER = "\u017f"
_LETTER = f"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-{LAST_LETTER}"
#: Where texts are cut besides their spaces: patterns, and what takes their place.
CUTS = [(rf"([{_LETTER}])([!-/:-@\[-`{{-~])", f"\\1 {TAIL}\\2"), (rf"([!-~{_LETTER}])\n([!-~{_LETTER}])", f"\\1 {TAIL}\n {TAIL}\\2")]


def _parts(texts: list[str], size: int = 4_000_000) -> Iterator[list[str]]:
    """``texts`` in order, in lists of about ``size`` characters."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


class Memory:
    """Values of words, computed together when they are new, kept in two generations of bounded size.

    ``fixed`` words are always known. Words of more than ``MEMO_LENGTH`` characters are computed each time.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], fixed: dict[str, bytes], size: int):
        self.compute, self.fixed, self.size = compute, fixed, size
        self.now, self.older = {}, {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """For each list of words, their values end to end. Each distinct word is looked up once, and the rest in a small dictionary."""
        own = self.values(set().union(*texts))
        return [b"".join(map(own.__getitem__, words)) for words in texts]

    def values(self, distinct: set[str]) -> dict[str, bytes]:
        """The value of each of these words."""
        if len(self.now) > self.size:
            self.older, self.now = self.now, {}
        now, older, fixed = self.now, self.older, self.fixed
        unknown = distinct.difference(fixed, now)
        now.update([(w, older[w]) for w in unknown if w in older])
        fresh = list(unknown.difference(older))
        now.update(zip(fresh, self.compute(fresh), strict=True))
        own = {w: fixed[w] if w in fixed else now[w] for w in distinct}
        for w in fresh:
            if len(w) > MEMO_LENGTH:
                del now[w]
        return own


class WordEncoder:
    """Encodes batches of texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without normalisation, cut by the usual pattern")
        if any(t["lstrip"] or t["rstrip"] or t["normalized"] and " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError("a special token takes in the spaces beside it")
        self.by_line = Tokenizer(self.tokenizer.model)  # the same model, held once
        self.by_line.pre_tokenizer = Sequence([CharDelimiterSplit("\n"), ByteLevel(add_prefix_space=False, use_regex=False)])  # a line is a piece
        self._lengths: np.ndarray | None = None
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.memory = Memory(self._encode_cuts, {"": self._encode([" "])[0]}, memo_words)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for part in _parts(texts):  # a few MB at a time, as encodings are far larger than their texts
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str], by_line: bool) -> list[bytes]:
        """The ids of words with a leading space each, none of them empty: many are encoded as one text and cut by length.

        ``by_line`` is for words of letters alone: each is one piece, so the library need not search for pieces.
        """
        tokenizer, space = (self.by_line, "\n ") if by_line else (self.tokenizer, " ")
        out: list[bytes] = []
        for part in _parts(words):
            ids = np.array(tokenizer.encode_batch_fast([" " + space.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter((1 + len(w.encode()) for w in part), np.int64, len(part)))
            bounds = np.append(0, np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1).tolist()
            data = memoryview(ids.tobytes())
            out += [bytes(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def _encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of cuts: words with a leading space each, and tails."""
        kinds = [2 if w[0] == TAIL else w.isalpha() and max(w) <= LAST_LETTER for w in cuts]
        tails, letters, others = ([w for w, kind in zip(cuts, kinds, strict=True) if kind == k] for k in (2, 1, 0))
        ids = map(iter, (self._encode_words(others, False), self._encode_words(letters, True), self._encode([w[1:] for w in tails])))
        of_kind = [next_id.__next__ for next_id in ids]
        return [of_kind[kind]() for kind in kinds]

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = functools.reduce(pc.or_, [pc.match_substring(texts, x) for x in ("  ", TAIL, *self.specials)])
        marked = pc.if_else(whole, "", texts)
        for pattern, by in CUTS:
            marked = pc.replace_substring_regex(marked, pattern, by)
        cuts = pc.split_pattern(marked, " ")
        ends = np.cumsum(pc.list_value_length(cuts).to_numpy())
        begins = np.append(0, ends[:-1])
        words = cuts.flatten()
        later = np.ones(len(words), bool)  # the first word of a text has no space before it; a text that stays whole stands there
        later[begins] = False
        firsts = self._encode(pc.if_else(whole, texts, words.take(pa.array(begins))).to_pylist())
        coded = words.filter(pa.array(later)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist()
        values = [*firsts, *map(self.memory.values(set(distinct)).__getitem__, distinct)]
        which = np.empty(len(words), np.int64)
        which[begins] = np.arange(len(firsts))
        which[later] = coded.indices.to_numpy() + len(firsts)
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))) // 4
        table = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(values), "<u4")))
        sizes = np.diff(bounds)[which]
        return table.take(pa.array(which)).flatten().to_numpy(), np.cumsum(sizes)[ends - 1]

    def arrays(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of ``texts``, in order: the ids of their texts end to end, and where those of each text end."""
        texts = texts.cast(pa.string())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            past = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
            yield self._ids(texts.slice(at, past - at))
            at = past

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none."""
        out: list[bytes] = []
        for ids, ends in self.arrays(pa.array(texts, pa.string())):
            out += [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    @property
    def lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        if self._lengths is None:
            self._lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            special = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            for token, i in self.tokenizer.get_vocab().items():
                self._lengths[i] = special.get(i, len(token))  # one character of the vocabulary for each byte
        return self._lengths


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    key = (path, memo_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, memo_words)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """The place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
