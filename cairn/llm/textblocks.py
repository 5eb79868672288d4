"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of Arrow batches.

A word is a run of bytes other than space and \\x09-\\x0D, as ``[^\\x20\\x09-\\x0D]+`` finds it.
A word's digest is a 64-bit polynomial hash over its bytes, with A-Z read as a-z if asked. Work is
done in blocks of a few megabytes, whatever the sizes of the batches; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_SEED = 0x5EED
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(_SEED))
    if lower:
        values[65:91] = values[97:123]
    return values


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Hasher:
    """Digests of words; keeps the powers it needs between blocks, of ``size`` bytes at first."""

    def __init__(self, lower: bool = True, size: int = BLOCK_BYTES):
        self.values = _byte_values(lower)
        self.up = _powers(_BASE, size)
        self.down = _powers(_INVERSE, size)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Block:
    """Some rows of a batch: their bytes, where each text begins and ends, and its words."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return self.rows.num_rows

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null reads as empty."""
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_, offsets


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; no word runs over the end of a text."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = solid[edges]
    stops[edges - 1] = solid[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            part = data[offsets[at] : offsets[to]]
            own = offsets[at : to + 1] - offsets[at]
            starts, ends = word_bounds(part, own)
            yield Block(batch.slice(at, to - at), part, own, starts, ends, np.searchsorted(starts, own))
            at = to


_PLACES = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def window_digests(words: np.ndarray, n: int) -> np.ndarray:
    """Digest of every run of ``n`` consecutive words (``n`` up to 8); runs may cross texts."""
    many = len(words) - n + 1
    if many <= 0:
        return np.empty(0, np.uint64)
    total = np.full(many, n, np.uint64)
    for k in range(n):
        total += words[k : k + many] * np.uint64(_PLACES[k])
    return mixed(total)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct ``n``-word shingles; a shorter text is one shingle, an empty one none."""
    runs = window_digests(words, n)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield window_digests(words[a:b], int(b - a))
        else:
            yield np.empty(0, np.uint64)
