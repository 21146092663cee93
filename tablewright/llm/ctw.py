"""Context-tree weighting over bytes, in arrays.

A byte is eight binary decisions, most significant bit first; a node is a context of up to DEPTH preceding bytes together with the
bits already decided (1..255, heap order). Every node has Krichevsky-Trofimov counts; the weighted probability of a node is half
its own estimate plus half the product over its longer contexts. Predictions mix the estimates of all depths by these weights.

A gram is the contexts' bytes, the latest first, then the byte: sorted grams keep the subtrees of a context together.
"""

from __future__ import annotations

import math

import numpy as np

DEPTH = 5
#: Contexts of fewer bytes are the top of the tree, of bounded size; a subtree is one context of TOP bytes.
TOP = 2
_SMALL = np.array([math.lgamma(max(i, 1) / 2) for i in range(513)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive multiples of one half."""
    large = np.maximum(x, 64.0)
    series = (large - 0.5) * np.log(large) - large + 0.5 * math.log(2 * math.pi) + 1 / (12 * large) - 1 / (360 * large**3)
    return np.where(x <= 256, _SMALL[(2 * np.minimum(x, 256.0)).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows' bytes, each row closed by a NUL and opened by DEPTH of them: distinct grams in order, the gram's number of
    each position (in the order of `order`), and the row of each position in that order."""
    n_rows = len(offsets) - 1
    rows = np.repeat(np.arange(n_rows), np.diff(offsets))
    padded = np.zeros(len(data) + n_rows * (DEPTH + 1), np.uint8)
    padded[np.arange(len(data)) + rows * (DEPTH + 1) + DEPTH] = data
    lengths = np.diff(offsets) + 1
    heads = np.cumsum(lengths + DEPTH) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(heads - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    row = np.repeat(np.arange(n_rows, dtype=np.int64), lengths)
    used = np.flatnonzero(np.bincount(padded, minlength=256))
    width = max(1, int(len(used) - 1).bit_length())
    place = max(1, int(len(at) - 1).bit_length())
    if width * (DEPTH + 1) + place <= 64:  # symbols renumbered in order, so that gram and position share one sortable number
        number = np.zeros(256, np.uint64)
        number[used] = np.arange(len(used), dtype=np.uint64)
        codes = number[padded]
        packed = _joined(codes, at, width) << np.uint64(place) | np.arange(len(at), dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << place) - 1)).astype(np.int64)
        short = packed >> np.uint64(place)
        new = np.concatenate(([True], short[1:] != short[:-1])) if len(short) else np.zeros(0, bool)
        entry = np.cumsum(new) - 1
        values, mask = np.zeros(int(new.sum()), np.uint64), np.uint64((1 << width) - 1)
        for k in range(DEPTH + 1):
            symbol = used[((short[new] >> np.uint64(width * k)) & mask).astype(np.int64)].astype(np.uint64)
            values |= symbol << np.uint64(8 * k)
        return values, entry, row[order]
    values, entry = np.unique(_joined(padded.astype(np.uint64), at, 8), return_inverse=True)
    return values, entry, row


def _joined(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    made = codes[at - 1].copy()
    for k in range(2, DEPTH + 1):
        made = made << np.uint64(width) | codes[at - k]
    return made << np.uint64(width) | codes[at]


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def nodes(grams_: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context, decided bits) in order with counts of zeros and ones, for the decision at `bit` (0 first)."""
    shift = np.uint64(8 - bit)
    keys = (grams_ >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << bit) | ((grams_ & np.uint64(255)) >> shift)
    heads = _runs(keys)
    if not len(heads):
        return keys, counts, counts
    ones = np.where((grams_ >> np.uint64(7 - bit)) & np.uint64(1), counts, 0)
    ones, total = np.add.reduceat(ones, heads), np.add.reduceat(counts, heads)
    return keys[heads], (total - ones).astype(float), ones.astype(float)


def shorter(grams_: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams without their earliest byte, with summed counts."""
    keys = (grams_ >> np.uint64(16) << np.uint64(8)) | (grams_ & np.uint64(255))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = _runs(keys)
    return (keys[heads], np.add.reduceat(counts, heads)) if len(heads) else (keys, counts)


class Subtrees:
    """The trees below contexts of TOP bytes, from distinct grams in order and their counts."""

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        values, counts = values[counts > 0], counts[counts > 0]
        by_depth = {DEPTH: (values, counts)}
        for d in range(DEPTH - 1, TOP - 1, -1):
            by_depth[d] = shorter(*by_depth[d + 1])
        #: For bit and depth: node keys, probability of a one, share of the node's own estimate.
        self.levels: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: For each bit: nodes of depth TOP with counts and log weighted probability.
        self.roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for bit in range(8):
            below = None
            for d in range(DEPTH, TOP - 1, -1):
                keys, zeros, ones = nodes(*by_depth[d], bit)
                own = log_kt(zeros, ones)
                weighted, share = own, np.ones(len(own))
                if below is not None:
                    parent = np.searchsorted(keys, below[0] >> np.uint64(16) << np.uint64(8) | (below[0] & np.uint64(255)))
                    longer = np.bincount(parent, below[1], len(keys))
                    weighted, share = mixed(own, longer)
                self.levels[bit, d] = (keys, (ones + 0.5) / (zeros + ones + 1.0), share)
                below = (keys, weighted)
            self.roots.append((keys, zeros, ones, weighted))

    def ones(self, values: np.ndarray, bit: int) -> np.ndarray:
        """Probability of a one at `bit` of each gram, mixed over depths from TOP on."""
        p = np.full(len(values), 0.5)
        decided = np.uint64(1 << bit) | ((values & np.uint64(255)) >> np.uint64(8 - bit))
        for d in range(DEPTH, TOP - 1, -1):
            keys, one, share = self.levels[bit, d]
            if len(keys):
                wanted = (values >> np.uint64(8 * (1 + DEPTH - d)) << np.uint64(8)) | decided
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                p = np.where(keys[at] == wanted, share[at] * one[at] + (1 - share[at]) * p, 0.5)
        return p


def mixed(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of inner nodes, and the share of their own estimate in it."""
    weighted = np.logaddexp(own, longer) + math.log(0.5)
    return weighted, np.exp(own + math.log(0.5) - weighted)


class Top:
    """Depths 0 and 1, from the roots of all subtrees summed by (last byte, decided bits)."""

    def __init__(self, last: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray) -> None:
        n0, n1, below, seen = (np.zeros((256, 256)) for _ in range(4))
        n0[last, node], n1[last, node], below[last, node], seen[last, node] = zeros, ones, longer, 1
        weighted, self.share1 = mixed(log_kt(n0, n1), below)
        self.seen1 = seen > 0
        self.one1 = (n1 + 0.5) / (n0 + n1 + 1.0)
        n0, n1 = n0.sum(0), n1.sum(0)
        _, self.share0 = mixed(log_kt(n0, n1), np.where(self.seen1, weighted, 0.0).sum(0))
        self.one0 = (n1 + 0.5) / (n0 + n1 + 1.0)

    def log10(self, values: np.ndarray, subtrees: Subtrees) -> np.ndarray:
        """Log10 probability of each gram's byte in its context."""
        total = np.zeros(len(values))
        last = (values >> np.uint64(8 * DEPTH)).astype(np.int64)
        for bit in range(8):
            node = (1 << bit) | ((values & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)
            p = subtrees.ones(values, bit)
            p = np.where(self.seen1[last, node], self.share1[last, node] * self.one1[last, node] + (1 - self.share1[last, node]) * p, 0.5)
            p = self.share0[node] * self.one0[node] + (1 - self.share0[node]) * p
            total += np.log10(np.where((values >> np.uint64(7 - bit)) & np.uint64(1), p, 1 - p))
        return total
