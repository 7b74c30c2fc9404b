"""Numpy helpers over UTF-8 bytes, used inside Arrow tasks.

Hashes are 64-bit polynomial sums over random byte values, finished with a mixer. Equal byte
strings always get equal hashes, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one vector step; a longer document is a step of its own.
STEP_BYTES = 512 << 10

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and where each row starts; null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay under the limit, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def powers(n: int, inverse: bool = False) -> np.ndarray:
    name, root = ("inverse", INVERSE) if inverse else ("plain", BASE)
    known = _powers.get(name)
    if known is None or len(known) < n:
        row = np.full(max(n, STEP_BYTES + 1), root, np.uint64)
        row[0] = 1
        known = _powers[name] = np.multiply.accumulate(row)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers; entry i covers the bytes before i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(sums), inverse=True)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space words of each row, and how many each row has."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def window_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a row, and the index of its first word."""
    total = len(words)
    if total < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.zeros(total - size + 1, np.uint64)
    for i in range(size):
        hashes += words[i:total - size + 1 + i] * np.uint64(pow(BASE, i + 1, 2**64))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)  # words of the row from this one on
    inside = left[:total - size + 1] >= size
    return mix(hashes[inside]), np.flatnonzero(inside)


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())
