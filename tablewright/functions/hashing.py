"""Keyed draws: deterministic pseudo-random integers from a row key and a seed.

A draw is the first 60 bits of the md5 of key and seed, so it is equal on every partitioning, on task retries and in any SQL
engine with md5, seeds are independent of each other, and keys do not repeat in practice (two of a billion keys share a draw with
probability one half).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws lie in [0, RANGE).
RANGE = 1 << 60
#: Draws share a cell of their upper bits: at most a million cells, however many rows.
CELL_BITS = 40


def draw(key: Column, seed: int) -> Column:
    """Integer in [0, RANGE) from an integer key."""
    text = F.concat(key.cast("bigint").cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def cell(value: Column) -> Column:
    """The cell of a draw; cells are in the order of draws."""
    return F.shiftright(value, CELL_BITS)


def unit(key: Column, seed: int) -> Column:
    """Draw scaled to [0, 1)."""
    return draw(key, seed) / F.lit(float(RANGE))


def chosen(key: Column, seed: int, rate: float) -> Column:
    """True for about `rate` of the keys."""
    return draw(key, seed) < F.lit(int(round(rate * RANGE)))


def pick(key: Column, seed: int, options: list) -> Column:
    """One of `options` by keyed draw."""
    values = F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options])
    return F.element_at(values, (F.pmod(draw(key, seed), F.lit(len(options)).cast("bigint")) + 1).cast("int"))


def poisson_cuts(mean: float) -> list[int]:
    """Draws from which a Poisson count is at least 1, 2, …; the tail left out is below one draw in RANGE."""
    cuts, below, p, k = [], 0.0, 2.718281828459045**-mean, 0
    while k <= mean or p > 1e-18:
        below += p
        cuts.append(int(round(below * RANGE)))
        k += 1
        p *= mean / k
    return cuts
