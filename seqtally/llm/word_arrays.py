"""Words of a column of texts as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

WORD, GAP, BREAK = 0, 1, 2


def byte_kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """Kind of every byte: part of a word, a gap between words, or the end of a piece of text."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


@dataclass
class Words:
    """Word i is `array[i]`, stands in row `row[i]` and in piece `piece[i]` of it.

    Words are in text order; neighbours are in one piece where their piece numbers are equal.
    """

    array: object
    row: np.ndarray
    piece: np.ndarray
    rows: int

    @cached_property
    def _coded(self):
        return self.array.dictionary_encode()

    @property
    def dictionary(self):
        """The distinct words."""
        return self._coded.dictionary

    @cached_property
    def code(self) -> np.ndarray:
        """Place of every word in the dictionary."""
        return self._coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word; equal words have equal ones."""
        return hashes_of(self.array)


def hashes_of(words) -> np.ndarray:
    """64-bit hashes of an Arrow array of large binaries, none of them empty or null."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(offsets)
    if not len(size):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    starts = offsets[:-1] - offsets[0]
    data *= powers[np.arange(len(data)) - np.repeat(starts, size)]
    return np.add.reduceat(data, starts)


def split_words(texts, kinds: np.ndarray, lower: np.ndarray | None = None, cuts: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words of an Arrow string column; a null text has none. `lower` maps bytes first.

    `cuts` (class of every byte, whether to cut between two classes) ends words inside runs too.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if lower is not None:
        data = lower[data]
    kind = kinds[data]
    inside = kind == WORD
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if cuts:
        group = cuts[0][data]
        first[1:] |= inside[1:] & cuts[1][group[:-1], group[1:]]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    kept = data[inside]
    # a word ends with its run, or where the next one begins in that run
    stops = np.flatnonzero(inside & np.append(~inside[1:], True)) + 1 if len(data) else starts
    ends = np.minimum(stops[np.searchsorted(stops, starts, "right")], np.append(starts[1:], len(data))) if len(starts) else starts
    offsets = np.append(0, np.cumsum(ends - starts, dtype=np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    row = np.searchsorted(at, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts) + row
    return Words(words, row, piece, len(texts))


def slices(texts, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most_bytes` of text each, or of one longer text."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most_bytes, "right")))
        yield lo, hi
        lo = hi
