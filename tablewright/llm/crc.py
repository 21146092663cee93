"""CRC-32 of many byte spans at once.

The checksum is linear over XOR but for a constant that the length alone sets: it is the XOR of what every byte contributes, and
that depends on the byte and on its distance from the span's end only. A table holds the contributions for REACH distances, so
the sums of a batch are one gather and one bitwise_xor.reduceat. Longer spans are cut into blocks of REACH bytes from their end;
the sums of neighbouring blocks are folded pairwise, the earlier one moved on by the length of the later one.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: The reflected generator polynomial of CRC-32, a fixed value.
POLYNOMIAL = 0xEDB88320
#: Distances the table holds, a power of two.
REACH = 64
#: Blocks that are gathered at once: REACH times as many bytes at most.
BLOCKS_AT_ONCE = 1 << 15


def moved(step: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Contributions seen from as many bytes further on as the step stands for."""
    return step[0][values & 255] ^ step[1][values >> 8 & 255] ^ step[2][values >> 16 & 255] ^ step[3][values >> 24]


@cache
def steps() -> list[np.ndarray]:
    """Steps over 1, 2, 4, ... zero bytes: of each, tables for the four bytes of a value."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, first >> 1 ^ np.uint32(POLYNOMIAL), first >> 1).astype(np.uint32)
    low = np.arange(256, dtype=np.uint32)
    made = [np.stack([first, low, low << 8, low << 16])]
    while len(made) < 40:
        made.append(moved(made[-1], made[-1]))
    return made


@cache
def positions() -> np.ndarray:
    """Contribution of every byte at every distance from the end: row by distance, 256 entries each."""
    made = [steps()[0][0]]
    while len(made) < REACH:
        made.append(moved(steps()[0], made[-1]))
    return np.concatenate(made)


def constants(lengths: np.ndarray) -> np.ndarray:
    """What the length alone contributes."""
    kinds, at = np.unique(lengths, return_inverse=True)
    state = np.full(len(kinds), 0xFFFFFFFF, np.uint32)
    for k, step in enumerate(steps()):
        state = np.where(kinds >> k & 1, moved(step, state), state)
    return ~state[at]


def _block_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions in spans of 1 to REACH bytes."""
    out, table = np.empty(len(starts), np.uint32), positions()
    for lo in range(0, len(starts), BLOCKS_AT_ONCE):
        first, last = starts[lo : lo + BLOCKS_AT_ONCE], ends[lo : lo + BLOCKS_AT_ONCE]
        sizes = last - first
        bounds = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.arange(int(sizes.sum())) + np.repeat(first - bounds, sizes)
        away = np.repeat(last - 1, sizes) - at
        out[lo : lo + len(first)] = np.bitwise_xor.reduceat(table[away * 256 + data[at]], bounds)
    return out


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for every pair; spans may overlap and may be empty."""
    lengths = ends - starts
    blocks = -(-lengths // REACH)
    owner = np.repeat(np.arange(len(starts)), blocks)
    # number of every block, counted from its span's end
    number = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(owner))
    last = ends[owner] - number * REACH
    sums = _block_sums(data, np.maximum(starts[owner], last - REACH), last)
    level = REACH.bit_length() - 1
    while len(number) and number.max():
        sums = np.where(number & 1, moved(steps()[level], sums), sums)
        number >>= 1
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (number[1:] != number[:-1]))))
        sums, owner, number = np.bitwise_xor.reduceat(sums, new), owner[new], number[new]
        level += 1
    out = np.zeros(len(starts), np.uint32)
    out[owner] = sums
    return out ^ constants(lengths)
