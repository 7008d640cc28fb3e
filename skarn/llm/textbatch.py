"""Whole-batch tokenisation with numpy: words, lines and their 64-bit hashes for a column of texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, so it never crosses two texts.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def running(flags: np.ndarray) -> np.ndarray:
    """Running sums of a flag per byte, from 0; as narrow as they fit, as they are as long as the text."""
    sums = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums


@dataclass
class Texts:
    """The bytes of a column of texts, one after the other; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @staticmethod
    def of(column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def per_text(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """How many of the byte positions (or the sum of their weights) lie in each text."""
        return np.bincount(self.owner(at), weights, len(self))

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def total(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        sums = running(flags)
        return (sums[self.offsets[1:]] - sums[self.offsets[:-1]]).astype(np.int64)

    def runs(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that are no gap, cut where a text ends."""
        inside = np.concatenate(([False], ~gap, [False]))
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        return starts, ends

    def words(self, fold: bool = False) -> Words:
        gap = SPACE[self.data]
        starts, ends = self.runs(gap)
        return Words(starts, ends, self.owner(starts), run_hashes(self.data[~gap], ends - starts, fold))


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each window of so many words inside one text."""
        n = len(self.doc) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * _BASE + self.hashes[k : k + n]
        return first, mix(h[first])


def run_hashes(kept: np.ndarray, lengths: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash for each run of bytes; kept has the runs' bytes alone, one run after the other. fold: A-Z count as a-z."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(begin, lengths)
    values = _BYTE[FOLD[kept] if fold else kept] * powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64))


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each, or one row."""
    at, sizes = 0, pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
