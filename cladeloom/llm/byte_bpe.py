"""Ids of a byte-level tokenizer file, encoded once per distinct pre-token of a task.

The library splits a text into pre-tokens and encodes each by itself, so the ids
of a text are those of its pre-tokens. Texts of Latin letters, ASCII digits and
common punctuation are split here, many at a time and as arrays, by the pattern of
the file in terms of those characters:

    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|blanks(?!\\S)|blanks

Their pre-tokens are cuts of one buffer, which Arrow tells apart and puts the ids
to; only pre-tokens not met before go to the library. Texts with any other
character, whose class may depend on the version of Unicode, go there whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PLAIN = re.compile("[\t-\r -~¡-±´-¸º»¿-ɏ‐-‧]*")
CACHE = 3 << 25  # characters kept, each entry counted as ENTRY more
ENTRY = 128
BLOCK = 1 << 19  # characters split together, and one text more
FRESH = 1 << 12  # pre-tokens the library gets at once

BLANK, LETTER, DIGIT, OTHER = range(4)
_KINDS = np.array([BLANK if c in " \t\n\v\f\r" else LETTER if re.match(r"[^\W\d_]", c) else DIGIT if c.isdigit() else OTHER
                   for c in map(chr, range(0x250))], np.uint8)
_OF_BYTE = np.concatenate([_KINDS[:128], np.full(128, OTHER, np.uint8)])
_QUOTE, _SPACE = b"' "
_SHORT, _LONG = [np.frombuffer(b, np.uint8) for b in (b"stmd", b"revell")]


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        added = self._library.get_added_tokens_decoder()
        self._special = {token.content.encode(): _packed([k]) for k, token in added.items()}
        self._at_special = re.compile("(" + "|".join(re.escape(token.content) for token in added.values()) + ")")
        self._known: dict[bytes, bytes] = dict(self._special)
        self._held, self._cache = 0, cache

    @property
    def size(self) -> int:
        return self._library.get_vocab_size()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text])).tobytes()

    def encode_whole(self, text: str) -> bytes:
        return _packed(self._library.encode(text, add_special_tokens=False).ids)

    def encode_all(self, texts: Iterable[str], block: int = BLOCK) -> Iterator[np.ndarray]:
        """The ids of each text in turn, as views of what its block has."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= block:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        plain = [PLAIN.fullmatch(text) is not None for text in texts]
        parts, ends = [], []  # texts between special tokens, and these, in turn
        for text, own in zip(texts, plain):
            if own:
                parts.extend(self._at_special.split(text) if self._special else [text])
                parts.extend([""] * (len(parts) % 2))
            ends.append(len(parts))
        ids, starts = self._pieces([part.encode() for part in parts], np.array([0, *ends]))
        return [ids[a:b] if own else np.frombuffer(self.encode_whole(text), "<u4")
                for text, own, a, b in zip(texts, plain, starts, starts[1:])]

    def _pieces(self, parts: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Ids of all parts, and where those of the parts from ``bounds`` on begin. Parts of odd number are special."""
        data = np.frombuffer(b"".join(parts) + b"\0\0\0", np.uint8)  # so that two bytes after any can be read
        at = np.cumsum([0, *map(len, parts)])
        begins = cuts(data, at)
        for k in range(1, len(parts), 2):
            if parts[k]:
                begins[at[k] + 1:at[k + 1]] = False
        places = np.flatnonzero(begins[:at[-1]])
        edges = np.append(places, at[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        if not len(words):
            return np.empty(0, "<u4"), [0] * len(bounds)
        words = words.dictionary_encode()
        _, offsets, distinct = words.dictionary.buffers()
        distinct, offsets = distinct.to_pybytes(), np.frombuffer(offsets, np.int64, len(words.dictionary) + 1).tolist()
        distinct = [distinct[a:b] for a, b in zip(offsets, offsets[1:])]
        ids = pa.array(self._ids(distinct), pa.large_binary()).take(words.indices)
        _, offsets, packed = ids.buffers()
        before = np.frombuffer(offsets, np.int64, len(ids) + 1)[np.searchsorted(places, at[bounds])]
        return np.frombuffer(packed, "<u4", before[-1] // 4), (before // 4).tolist()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        ids = list(map(self._known.get, words))
        fresh = [k for k, known in enumerate(ids) if known is None]
        for at in range(0, len(fresh), FRESH):
            part = [words[k] for k in fresh[at:at + FRESH]]
            found = self._library.encode_batch_fast([word.decode() for word in part], add_special_tokens=False)
            for k, word, encoding in zip(fresh[at:], part, found):
                ids[k] = self._known[word] = _packed(encoding.ids)
            self._held += sum(map(len, part)) + ENTRY * len(part)
        if self._held > self._cache:
            self._known, self._held = dict(self._special), 0
        return ids


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at a byte of plain UTF-8 texts that start ``at`` bytes; the last three bytes are padding."""
    kind = _OF_BYTE[data]
    lead = np.flatnonzero((data >= 0xC0) & (data < 0xE0))  # of two bytes; all plain characters of three are others
    kind[lead] = kind[lead + 1] = _KINDS[(data[lead] & 0x1F).astype(np.intp) << 6 | data[lead + 1] & 0x3F]
    first = np.zeros(len(data), bool)
    first[at] = True
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    last = blank[:-1] & ~blank[1:] & ~first[1:]  # blanks before a word of their text are by themselves,
    begins[:-1] |= last
    begins[1:] &= ~(last & (data[:-1] == _SPACE))  # spaces there a part of it
    quote = np.flatnonzero(begins & (data == _QUOTE))
    quote = quote[~first[quote + 1]]
    short = quote[np.isin(data[quote + 1], _SHORT)]
    begins[short + 1], begins[short + 2] = False, True
    quote = quote[~first[quote + 2]]
    pairs = data[quote + 1].astype(np.uint16) << 8 | data[quote + 2]
    long = quote[np.isin(pairs, _LONG[::2].astype(np.uint16) << 8 | _LONG[1::2])]
    begins[long + 1], begins[long + 3] = False, True
    return begins


_encoder = lru_cache(1)(Encoder)


def encoder_of(path: str, cache: int = CACHE) -> Encoder:
    """One for all tasks of a worker process, with what it has met so far."""
    return _encoder(path, cache)


def encoded(batch: pa.RecordBatch, path: str, end_id: int, cache: int = CACHE) -> Iterator[tuple[int | None, np.ndarray]]:
    """Of rows (doc_id, text): the id, and the ids of the text with ``end_id`` behind them."""
    end = np.array([end_id], "<u4")
    texts = (text.as_py() for text in batch.column(1))
    for doc_id, ids in zip(batch.column(0).to_pylist(), encoder_of(path, cache).encode_all(texts)):
        yield doc_id, np.append(ids, end)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()
