"""Word shingle sets of Arrow text batches, vectorised over the bytes of many texts at once.

Words are runs of other bytes than space, tab, LF, VT, FF and CR, with A-Z lower-cased; shingles
are five words, or all words of a shorter text. Each shingle is a 64-bit value: a polynomial hash
over random byte values per word, mixed, then a mixed linear form over the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .lean import pieces

SIZE = 5
#: Texts are hashed together up to this many bytes; a longer text is a chunk of its own.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(seed))
    lower = np.arange(256)
    lower[65:91] += 32
    return random.integers(0, 1 << 64, 256, np.uint64)[lower], random.integers(0, 1 << 63, SIZE, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(_BASE, -1, 1 << 64)
    rows = []
    for base in (_BASE, back):
        row = np.full(n + 1, base, np.uint64)
        row[0] = 1
        rows.append(np.multiply.accumulate(row))
    return rows[0], rows[1]


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _chunk(data: np.ndarray, offsets: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text; ``offsets`` bound the texts in ``data``."""
    n = len(data)
    size = CHUNK if n <= CHUNK else 1 << (n - 1).bit_length()
    power, back = _powers(size)
    value, factor = _tables(seed)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~_BLANK[data]
    starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1])) if n else np.empty(0, np.int64)
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | edge[1:])) + 1 if n else np.empty(0, np.int64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[data] * power[:n], dtype=np.uint64)))
    word = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
    if len(word) >= SIZE:
        rolled = word[: len(word) - SIZE + 1] * factor[0]
        for k in range(1, SIZE):
            rolled += word[k : len(word) - SIZE + 1 + k] * factor[k]
        rolled = mix(rolled).view(np.int64)
    first = np.searchsorted(starts, offsets)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SIZE:
            yield np.unique(rolled[a : b - SIZE + 1])
        elif b > a:
            yield mix((word[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a)).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def sets(texts: pa.Array, seed: int = 1) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text of the array; null and blank texts have none."""
    for part in pieces(texts, CHUNK):
        part = part.cast(pa.large_string()).fill_null("")
        _, offset_buffer, value_buffer = part.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(value_buffer, np.uint8) if value_buffer else np.empty(0, np.uint8)
        yield from _chunk(data[offsets[0] : offsets[-1]], offsets - offsets[0], seed)


def fingerprint(shingles: np.ndarray, seed: int = 1) -> tuple[int, int]:
    """128 bits that identify the set."""
    x = shingles.view(np.uint64)
    pair = [int(mix(x + np.uint64(k * seed)).sum(dtype=np.uint64)) for k in (0x1F3D, 0x2E5B)]
    return tuple(p - (1 << 64) if p >> 63 else p for p in pair)  # type: ignore[return-value]
