"""Ids of a lower-casing word BPE for whole texts, a batch of texts at a time.

The tokenizer drops white space and never merges across it, so a text's ids are
those of its words. A batch's distinct words are cut into the parts that the
tokenizer's pattern gives, and each distinct part is merged once, by the
library's BPE model. That holds for words of printable ASCII and composed Latin-1
letters, which are normalised here; any other word, or one with an apostrophe,
goes through the library whole. Texts that hold a string of an added token go
through the library too, which finds such strings as is its default.
"""

from __future__ import annotations

import codecs
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, DIGIT, MARK, OTHER = range(4)
LEAD = 0xC3  # the first byte of composed Latin-1 letters


@lru_cache(maxsize=1)
def _byte_letters() -> str:
    """The printable stand-in of each byte in byte-level BPE: itself if printable Latin-1, else the next letter from 256 up; line feeds stay."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)} | {10: "\n"}
    return "".join([table[b] for b in range(256)])


@lru_cache(maxsize=1)
def _kinds_of_bytes() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and of each byte after ``LEAD``."""
    ascii_ = np.full(256, OTHER, np.uint8)
    ascii_[0x21:0x7F] = MARK
    ascii_[ord("'")] = OTHER
    ascii_[ord("0") : ord("9") + 1] = DIGIT
    ascii_[ord("a") : ord("z") + 1] = ascii_[ord("A") : ord("Z") + 1] = LETTER
    after = np.full(256, OTHER, np.uint8)
    after[0x80:0xC0] = LETTER
    after[[0x97, 0xB7]] = OTHER  # the signs of multiplication and division
    return ascii_, after


def _kinds(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte, where the bytes ``LEAD`` are, and which words are odd."""
    of_ascii, after_lead = _kinds_of_bytes()
    kind = of_ascii[data]
    lead = np.flatnonzero(data[:-1] == LEAD)
    kind[lead] = kind[lead + 1] = after_lead[data[lead + 1]]
    held = begins[:-1] < begins[1:]
    odd = np.zeros(len(held), bool)
    odd[held] = np.maximum.reduceat(kind, begins[:-1][held]) == OTHER
    return kind, lead, odd


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large binary array and where each value begins (one more entry than values)."""
    begins = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[begins[0] : begins[-1]], begins - begins[0]


def _binary(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


class Lists:
    """Lists of ids, one after another in ``ids``; list k starts at ``begins[k]``."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray):
        self.ids, self.begins = ids, begins

    @classmethod
    def of(cls, lists: list[list[int]]) -> Lists:
        begins = np.cumsum([0, *map(len, lists)])
        return cls(np.fromiter(chain.from_iterable(lists), np.uint32, begins[-1]), begins)

    def __add__(self, more: Lists) -> Lists:
        return Lists(np.concatenate([self.ids, more.ids]), np.concatenate([self.begins, more.begins[1:] + self.begins[-1]]))

    def first(self, n: int) -> Lists:
        return Lists(self.ids[: self.begins[n]], self.begins[: n + 1])

    def take(self, index: np.ndarray) -> Lists:
        start = self.begins[index]
        lengths = self.begins[index + 1] - start
        begins = np.zeros(len(index) + 1, np.int64)
        np.cumsum(lengths, out=begins[1:])
        at = np.arange(begins[-1], dtype=np.int32 if max(begins[-1], len(self.ids)) < 1 << 31 else np.int64)
        at += np.repeat((start - begins[:-1]).astype(at.dtype), lengths)
        return Lists(self.ids[at], begins)

    def joined(self, begins: np.ndarray) -> Lists:
        """Runs of lists in one: run k holds the lists from ``begins[k]`` on."""
        return Lists(self.ids, self.begins[begins])


class WordTokenizer:
    """Remembers the ids of at most ``cap`` parts and unusual words; beyond it those that were met last go, as frequent ones are met first."""

    def __init__(self, path: str, cap: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cap = cap
        self.merge = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.keys, self.known = pa.array([], pa.large_binary()), Lists.of([])

    def lists(self, texts: pa.Array) -> Lists:
        """The ids of each text (null: none)."""
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        own = texts.filter(pa.array(whole)).to_pylist()
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts) if own else texts)
        begins = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        ids = self._words(coded.dictionary.cast(pa.large_binary()))
        if own:
            # each stands for the one empty word that its text has become
            index = index.copy()
            index[begins[:-1][whole]] = len(coded.dictionary) + np.arange(len(own))
            ids += Lists.of([self._whole(t) for t in own])
        return ids.take(index).joined(begins)

    def _words(self, words: pa.Array) -> Lists:
        """The ids of distinct words: those of their parts."""
        data, begins = _bytes(words)
        kind, lead, odd = _kinds(data, begins)
        odd = np.repeat(odd, np.diff(begins))
        low = data.copy()
        low[(data >= ord("A")) & (data <= ord("Z")) & ~odd] += 32
        low[lead + 1] += 32 * ((data[lead + 1] < 0x9F) & ~odd[lead]).astype(np.uint8)
        # a part is a run of letters or of marks, a digit, or an odd word
        starts = np.ones(len(data), bool)
        starts[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & ~odd[1:]
        starts[begins[:-1][begins[:-1] < begins[1:]]] = True
        starts = np.flatnonzero(starts)
        parts = _binary(low, np.append(starts, len(data))).dictionary_encode()
        ids = self._parts(parts.dictionary).take(parts.indices.to_numpy())
        return ids.joined(np.searchsorted(starts, begins))

    def _parts(self, parts: pa.Array) -> Lists:
        """The ids of distinct lower-cased parts and odd words."""
        at = pc.index_in(parts, value_set=self.keys).fill_null(-1).to_numpy()
        new = np.flatnonzero(at < 0)
        keys = parts.take(pa.array(new))
        known = self.known + self._merged(keys)
        at = at.copy()
        at[new] = len(self.keys) + np.arange(len(new))
        self.keys, self.known = pa.concat_arrays([self.keys, keys]), known
        if len(self.keys) > self.cap:
            self.keys, self.known = self.keys[: self.cap // 2], known.first(self.cap // 2)
        return known.take(at)

    def _merged(self, parts: pa.Array) -> Lists:
        """The ids of parts by the library's BPE model, of odd words by the whole library."""
        _, _, odd = _kinds(*_bytes(parts))
        parts, merge = parts.to_pylist(), self.merge
        # line feeds are white space, so no part holds one
        letters, _ = codecs.charmap_decode(b"\n".join(parts), "strict", _byte_letters())
        ids: list[int] = []
        ends = [0]
        for part, x, other in zip(parts, letters.split("\n"), odd.tolist()):
            ids += self._whole(part.decode()) if other else [t.id for t in merge(x)]
            ends.append(len(ids))
        return Lists(np.array(ids, np.uint32), np.array(ends, np.int64))

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: bytes) -> bytes:
        """The ids of one text as little-endian 32-bit integers."""
        return self.lists(pa.array([text], pa.binary()).cast(pa.string())).ids.astype("<u4").tobytes()


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    return WordTokenizer(path)
