"""Vectorised helpers over the bytes of Arrow text columns; they run inside Spark tasks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def lean() -> None:
    """From now on this worker gives back the memory of Arrow batches when they are done with, instead of keeping it for the next ones."""
    pa.set_memory_pool(pa.system_memory_pool())


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CODE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``n`` of each."""

    def row(b: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(b, done, 1 << 64))
            done += more
        return out

    return row(BASE), row(pow(BASE, -1, 1 << 64))


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums P with which a substring's hash is ``(P[stop] - P[start]) * inverse[start]``, and the inverses."""
    n = len(data)
    size = PIECE if n < PIECE else 1 << int(n + 1).bit_length()
    up, down = powers(size + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(CODE[data] * up[:n], out=sums[1:])
    return sums, down


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets; null rows are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, at


def groups_of_rows(at: np.ndarray, most_bytes: int = PIECE, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most ``most_bytes`` bytes (one row at least) and ``most_rows`` rows."""
    k, n = 0, len(at) - 1
    while k < n:
        stop = int(np.searchsorted(at, at[k] + most_bytes, side="right")) - 1
        stop = min(max(stop, k + 1), k + most_rows, n)
        yield k, stop
        k = stop


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive rows, A to Z lower-cased, and the row of each word.

    ``data`` holds the rows' bytes, ``at`` where each starts, from 0.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[data]
    solid = ~SPACE[low]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edges[edges > 0] - 1] = False
    stops = np.flatnonzero(solid & ~after) + 1
    sums, down = prefix_hashes(low)
    return mixed((sums[stops] - sums[starts]) * down[starts]), np.searchsorted(at, starts, side="right") - 1
