"""Texts as numpy arrays: one byte buffer for a batch, spans of words, hashes of spans and n-grams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 18
_powers = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, _BLOCK), base, np.uint64)
        factors[0] = 1
        _powers[base] = known = np.multiply.accumulate(factors)
    return known[:n]


def joined(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A buffer with white space around every text, and where each text starts and ends in it."""
    parts = [(t or "").encode() for t in texts]
    buffer = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(parts) else sizes
    return buffer, starts, starts + sizes


def word_spans(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's first word (with the number of words at the end)."""
    space = IS_SPACE[buffer]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return begin, end, np.append(np.searchsorted(begin, starts), len(begin))


def span_hashes(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span; `begin` and `end` ascend.

    Sums are formed block by block and kept at the ends of spans only, so that the memory is that of
    the buffer and the spans.
    """
    low, high = np.zeros(len(begin), np.uint64), np.zeros(len(end), np.uint64)
    total, scale = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for start in range(0, len(buffer) + 1, _BLOCK):
            part = buffer[start : start + _BLOCK]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * _power(_BASE, len(part)), out=sums[1:])
            sums = sums * scale + total
            for places, found in ((begin, low), (end, high)):
                own = slice(*np.searchsorted(places, (start, start + _BLOCK)))
                found[own] = sums[places[own] - start]
            total, scale = sums[-1], np.uint64(pow(int(_BASE), start + _BLOCK, 1 << 64))
        blocks = len(buffer) // _BLOCK + 1
        far = np.array([pow(int(_INVERSE), k * _BLOCK, 1 << 64) for k in range(blocks)], np.uint64)
        return mixed((high - low) * _power(_INVERSE, _BLOCK)[begin % _BLOCK] * far[begin // _BLOCK])


def gram_buckets(buffer: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n bytes (up to 8) that begin at each position; none for the last n - 1."""
    size = len(buffer) - n + 1
    packed = np.zeros(max(size, 0), np.uint64)
    for k in range(n):
        packed |= buffer[k : k + size].astype(np.uint64) << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        packed *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
        packed ^= packed >> np.uint64(32)
        packed *= _BASE
    return (packed >> np.uint64(64 - bits)).astype(np.int64)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] numbers), then the same for each further pair."""
    total = np.cumsum(count)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(begin - (total - count), count)


def segment_sums(values: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of segments that follow each other without gaps, the empty ones included."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, firsts[some], axis=0)
    return out


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of these lengths in bytes, which follow each other in `data`."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
