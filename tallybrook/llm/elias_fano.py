"""Elias-Fano sequences in one memory-mapped file, and a two-level n-gram trie on them."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np


class LevelFile:
    """Arrays written one after another to a temporary file and mapped back; removed on exit."""

    def __enter__(self) -> LevelFile:
        handle, self.path = tempfile.mkstemp(suffix=".levels")
        self.out = os.fdopen(handle, "wb")
        self.parts: list[tuple[str, int, int]] = []
        return self

    def add(self, values: np.ndarray) -> int:
        self.out.write(b"\0" * (-self.out.tell() % 8))
        self.parts.append((values.dtype.str, self.out.tell(), len(values)))
        values.tofile(self.out)
        self.out.flush()
        return len(self.parts) - 1

    def __getitem__(self, part: int) -> np.ndarray:
        kind, at, size = self.parts[part]
        return np.memmap(self.path, kind, "r", at, (size,)) if size else np.zeros(0, kind)

    def __exit__(self, *_: object) -> None:
        self.out.close()
        os.unlink(self.path)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary."""

    def __init__(self, file: LevelFile, values: np.ndarray, universe: int):
        values, self.size = values.astype(np.uint64), len(values)
        self.bits = min(max((universe // max(self.size, 1)).bit_length() - 1, 0), 63)
        shift, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        self.mask = mask
        place = np.arange(self.size, dtype=np.uint64) * shift
        word, offset = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        low = values & mask
        packed = np.zeros((self.size * self.bits >> 6) + 2, np.uint64)
        if self.size:
            some = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            packed[word[some]] = np.bitwise_or.reduceat(low << offset, some)
            over = offset + shift > 64
            packed[word[over] + 1] |= low[over] >> (np.uint64(64) - offset[over])
        high = (values >> shift).astype(np.int64)
        unary = np.zeros(self.size + (int(high[-1]) if self.size else 0) + 2, bool)
        unary[high + np.arange(self.size)] = True
        self._low, self._high, self._unary = file.add(packed), file.add(np.packbits(unary)), len(unary)
        self.file = file

    def open(self) -> EliasFano:
        """Map the level, and expand where its buckets begin and its elements' high bits end."""
        self.low = self.file[self._low]
        unary = np.unpackbits(self.file[self._high], count=self._unary).view(bool)
        zeros = np.flatnonzero(~unary)
        self.buckets = np.append(0, zeros - np.arange(len(zeros)))
        self.ones = np.flatnonzero(unary)
        return self

    def _lows(self, index: np.ndarray) -> np.ndarray:
        place = index.astype(np.uint64) * np.uint64(self.bits)
        word, offset = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        over = np.where(offset > 0, self.low[word + 1] << ((np.uint64(64) - offset) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> offset) | over) & self.mask

    def access(self, index: np.ndarray) -> np.ndarray:
        high = (self.ones[index] - index).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._lows(index)

    def successor(self, values: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element from `begin` on, before `end`, that is not below each value, if
        it lies in the value's bucket; and whether it equals the value."""
        bucket = np.minimum(values >> np.uint64(self.bits), np.uint64(len(self.buckets) - 2)).astype(np.int64)
        low = np.maximum(self.buckets[bucket], begin)
        top = np.minimum(self.buckets[bucket + 1], self.size if end is None else end)
        wanted, stop = values & self.mask, top.copy()
        live = np.flatnonzero(low < stop)
        while len(live):
            middle = (low[live] + stop[live]) >> 1
            less = self._lows(middle) < wanted[live]
            low[live[less]] = middle[less] + 1
            stop[live[~less]] = middle[~less]
            live = live[low[live] < stop[live]]
        equal = low < top
        equal[equal] = self.access(low[equal]) == values[equal]
        return low, equal


def quantised(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A code of one byte for each value and the codebook: means of bins of equal width."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    low, high = values.min(), values.max()
    code = np.minimum((values - low) * (levels / max(high - low, 1e-12)), levels - 1).astype(np.int64)
    count = np.bincount(code, minlength=levels)
    return code.astype(np.uint8), np.bincount(code, values, levels) / np.maximum(count, 1)


@dataclass
class Trie:
    """Words (64-bit) at the first level; below each, the words (32-bit) seen before it.

    A child is stored relative to its context, as context number * 2^32 + child, so that the whole
    second level is one monotone sequence; pointers delimit the children of each context.
    """

    words: EliasFano
    pointers: EliasFano
    children: EliasFano
    codes: int
    book: np.ndarray
    file: LevelFile

    @classmethod
    def build(cls, file: LevelFile, words: np.ndarray, context: np.ndarray, child: np.ndarray, value: np.ndarray) -> Trie:
        """words: ascending; context (a word's number), child: ascending pairs with their values."""
        code, book = quantised(value)
        pointer = np.searchsorted(context, np.arange(len(words) + 1))
        keys = (context.astype(np.uint64) << np.uint64(32)) | child.astype(np.uint64)
        return cls(
            EliasFano(file, words, 1 << 64), EliasFano(file, pointer, len(keys) + 1), EliasFano(file, keys, max(len(words), 1) << 32), file.add(code), book, file,
        )

    def open(self) -> Trie:
        for level in (self.words, self.pointers, self.children):
            level.open()
        return self

    def find(self, word: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs: whether the trie has them, and the values of those that it has."""
        context, seen = self.words.successor(word)
        context = context[seen]
        begin, end = self.pointers.access(context).astype(np.int64), self.pointers.access(context + 1).astype(np.int64)
        key = (context.astype(np.uint64) << np.uint64(32)) | child[seen].astype(np.uint64)
        at, equal = self.children.successor(key, begin, end)
        seen[seen] = equal
        return seen, self.book[self.file[self.codes][at[equal]]]
