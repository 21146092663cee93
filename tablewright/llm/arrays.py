"""Array helpers used inside Arrow batches: word bounds and hashes over whole buffers, no loop per word.

Hashes are polynomials modulo 2**64 with a final mix. Tables come from a rule (a counter through the same mix), so every
executor computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = bytes([0x20, *range(0x09, 0x0E)])
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit value for every byte; with lower, A-Z share the values of a-z."""
    with np.errstate(over="ignore"):
        table = mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed + 1000)) * BASE)
    if lower:
        table[65:91] = table[97:123]
    return table


def inside_table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = int(mix(np.array([7777 + seed], np.uint64))[0]) | 1
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(p))
        have = _POWERS[seed] = (made[0], made[1])
        if size > 1 << 24:
            _POWERS.pop(seed)  # a very long text: not worth keeping
    return have


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes, a longer row alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (one entry more than rows). Words never cross rows."""
    n = len(data)
    mask = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = mask
    starts = np.flatnonzero(mask & (~before[:-1] | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word's bytes."""
    up, down = powers(len(data) + 1, seed)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * BASE)


def window_hashes(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of `size` consecutive values (row borders ignored)."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1, seed)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=total[1:])
        return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def valid_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a window of `size` values stays in its row; first: first value of each row, and the total."""
    ends = np.repeat(first[1:], np.diff(first))
    at = np.arange(first[-1])
    return at[at + size <= ends]


def cut(sorted_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of equal values: their values and their bounds (one more)."""
    if not len(sorted_groups):
        return sorted_groups, np.zeros(1, np.int64)
    new = np.flatnonzero(np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1])))
    return sorted_groups[new], np.append(new, len(sorted_groups))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
