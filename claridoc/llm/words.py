"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes, many documents at a time.

A word is a run of bytes other than space and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``; UTF-8 never uses these
bytes inside a character. All arrays are bounded by the chunk of texts that is looked at (``chunks``), so memory
follows the longest single text and not the batch or the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
BYTE_BASE, GRAM_BASE, GRAM_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class _Cache(dict):
    """Kept in a worker between calls; never travels with a pickled function."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the usual xor-shift-multiply finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to the size of a chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base % 2**64, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[starts:ends] for many spans at once, by one running sum."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    back = powers(pow(base, -1, 2**64), len(values) + 1)
    return (sums[ends] - sums[starts]) * back[starts]


@dataclass
class Words:
    """Words of consecutive texts. ``first[d]:first[d+1]`` are the words of text d; start and end are byte positions in data."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, n: int, base: int = GRAM_BASE) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of n words inside one text."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        last = self.first[1:][self.text[: len(at)]]
        at = at[at + n <= last]
        return at, mix(span_hash(self.hash, at, at + n, base))

    def whole(self, base: int = GRAM_BASE) -> np.ndarray:
        """Hash of the whole word sequence of each text, its length included."""
        return mix(span_hash(self.hash, self.first[:-1], self.first[1:], base) + self.counts.astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the text limits in them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, limits, data = texts.buffers()
    limits = np.frombuffer(limits, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if limits is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, limits - limits[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, one row at least."""
    _, limits = text_bytes(texts)
    row, rows = 0, len(limits) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(limits, limits[row] + most, side="right")) - 1)
        yield row, min(to, rows)
        row = to


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text, A-Z lower-cased when asked."""
    data, limits = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    joined = np.zeros(len(data) + 1, bool)  # a word goes on from the byte before
    joined[1:-1] = inside[1:] & inside[:-1] if len(data) else False
    joined[limits] = False
    start = np.flatnonzero(inside & ~joined[:-1])
    end = np.flatnonzero(inside & ~joined[1:]) + 1
    first = np.searchsorted(start, limits)
    values = _BYTE_VALUE[data]
    hashes = mix(span_hash(values, start, end, BYTE_BASE) + (end - start).astype(np.uint64))
    return Words(data, start, end, first, hashes)


def text_digest(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every whole text, byte for byte."""
    data, limits = text_bytes(texts)
    values, size = _BYTE_VALUE[data], np.diff(limits).astype(np.uint64)
    one = span_hash(values, limits[:-1], limits[1:], BYTE_BASE)
    two = span_hash(values, limits[:-1], limits[1:], GRAM_BASE_2)
    return mix(one + size), mix(two ^ size * _U(0x9E3779B97F4A7C15))
