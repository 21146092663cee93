"""Exact quantiles with linear interpolation, all columns and ranks at once.

The built-in exact percentile keeps every distinct value of a column in one task. It is used only
up to SMALL_COLUMN values. Above that, one pass of sketches brackets the wanted order statistics of
all columns, one pass counts around all brackets, and one grouped pass resolves what lies in
them (at most SMALL_COLUMN values each; larger ones are bracketed again). The number of jobs does
not depend on the number of columns or ranks.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL_COLUMN = 1_000_000
SKETCH_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], small: int = SMALL_COLUMN) -> dict[str, dict[float, float | None]]:
    """Scalar quantiles per column: {column: {p: value}}; NULL and NaN are ignored."""
    columns = list(wanted)
    if not columns:
        return {}
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    counts = clean.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    result: dict[str, dict[float, float | None]] = {c: {} for c in columns}
    light = [c for c in columns if 0 < counts[c] <= small]
    if light:
        row = clean.agg(*[F.percentile(c, [float(p) for p in wanted[c]]).alias(c) for c in light]).first()
        for c in light:
            result[c] = dict(zip(wanted[c], row[c]))
    ranks = {c: sorted({r for p in wanted[c] for r in (math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1)))}) for c in columns if counts[c] > small}
    found = _order_statistics(clean, ranks, counts, small)
    for c in columns:
        if counts[c] == 0:
            result[c] = {p: None for p in wanted[c]}
        elif c in ranks:
            for p in wanted[c]:
                exact = p * (counts[c] - 1)
                low, high = found[c, math.floor(exact)], found[c, math.ceil(exact)]
                result[c][p] = low + (high - low) * (exact - math.floor(exact))
    return result


class _Bracket(NamedTuple):
    """Values of a column between two bounds, both left out, that hold some wanted ranks; skipped values come before them."""

    column: str
    low: float | None
    high: float | None
    skipped: int
    total: int
    ranks: list[int]

    def cell(self) -> Column:
        """The value where it lies inside."""
        value, inside = F.col(self.column), F.col(self.column).isNotNull()
        if self.low is not None:
            inside = inside & (value > self.low)
        if self.high is not None:
            inside = inside & (value < self.high)
        return F.when(inside, value)

    def around(self) -> list[float]:
        """Shares whose sketched values stand on both sides of every wanted rank."""
        margin = 3.0 / SKETCH_ACCURACY
        shares = [(r - self.skipped) / self.total for r in self.ranks]
        return sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-margin, margin)})

    def split(self, cuts: list[float], below: list[int], at: list[int]) -> tuple[dict[int, float], list[_Bracket]]:
        """Ranks that are cuts, and the brackets between cuts that hold the others."""
        found, inner = {}, {}
        edges = [(self.low, 0), *((c, b + a) for c, b, a in zip(cuts, below, at, strict=True))]
        for rank in self.ranks:
            place = rank - self.skipped
            k = sum(b + a <= place for b, a in zip(below, at, strict=True))
            if k < len(cuts) and place >= below[k]:
                found[rank] = cuts[k]
            else:
                high, end = (cuts[k], below[k]) if k < len(cuts) else (self.high, self.total)
                low, start = edges[k]
                inner.setdefault(k, _Bracket(self.column, low, high, self.skipped + start, end - start, [])).ranks.append(rank)
        return found, list(inner.values())


def _order_statistics(df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int], small: int) -> dict[tuple[str, int], float]:
    """Values at zero-based ranks of several columns."""
    found: dict[tuple[str, int], float] = {}
    brackets = [_Bracket(c, None, None, 0, counts[c], r) for c, r in ranks.items()]
    while large := [b for b in brackets if b.total > small]:
        rows = df.agg(*[F.percentile_approx(b.cell(), b.around(), SKETCH_ACCURACY).alias(f"c{k}") for k, b in enumerate(large)]).first()
        cuts = [sorted(set(row)) for row in rows]
        counted = df.agg(*[
            F.array(*[n for c in own for n in (F.count_if(b.cell() < c), F.count_if(b.cell() == c))]).alias(f"c{k}") for k, (b, own) in enumerate(zip(large, cuts, strict=True))
        ]).first()
        brackets = [b for b in brackets if b.total <= small]
        for b, own, row in zip(large, cuts, counted, strict=True):
            known, inner = b.split(own, row[::2], row[1::2])
            found.update({(b.column, r): v for r, v in known.items()})
            brackets += inner
    if brackets:
        cells = F.array(*[F.struct(F.lit(k).alias("k"), b.cell().alias("v")) for k, b in enumerate(brackets)])
        held = df.select(F.inline(cells)).where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
        # at most `small` values a bracket
        placed = held.withColumn("end", F.sum("n").over(Window.partitionBy("k").orderBy("v")))
        hit = F.lit(False)
        for k, b in enumerate(brackets):
            for r in b.ranks:
                hit = hit | ((F.col("k") == k) & (F.col("end") > r - b.skipped) & (F.col("end") - F.col("n") <= r - b.skipped))
        for row in placed.where(hit).collect():
            b = brackets[row["k"]]
            found.update({(b.column, r): row["v"] for r in b.ranks if row["end"] - row["n"] <= r - b.skipped < row["end"]})
    return found


def most_frequent(df: DataFrame, column: str):
    """Smallest of the most frequent non-NULL values, or None. Counts combine map-side; the driver gets one row."""
    top = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.desc("count"), F.asc(column))
        .limit(1)
        .first()
    )
    return None if top is None else top[column]


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent text per column (smallest on ties); all columns in one shuffle, one driver row per column."""
    from tablewright.operators.frames import long_cells

    result: dict[str, str | None] = {c: None for c in columns}
    if columns:
        counts = long_cells(df, columns, []).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("top"))
        result.update({r["column"]: r["top"]["value"] for r in best.collect()})
    return result


def quantile_grid(df: DataFrame, column: str, steps: int, small: int = SMALL_COLUMN) -> list[float]:
    """Exact quantiles at 0, 1/steps, …, 1. Large columns: counts per value and a distributed prefix sum."""
    from tablewright.operators.ordered import prefix_sums

    value = F.col(column).cast("double")
    clean = df.select(F.when(~F.isnan(value), value).alias("v")).where(F.col("v").isNotNull())
    total = clean.count()
    if total == 0:
        return []
    if total <= small:
        shares = F.from_json(F.lit(json.dumps([i / steps for i in range(steps + 1)])), "array<double>")
        return clean.agg(F.percentile("v", shares)).first()[0]
    placed = prefix_sums(clean.groupBy("v").agg(F.count("*").alias("n")), "v", {"before": F.col("n")})
    first = F.greatest(F.lit(0), F.floor((F.col("before") - 1) / (total - 1) * steps) - 1)
    last = F.least(F.lit(steps), F.ceil((F.col("before") + F.col("n")) / (total - 1) * steps) + 1)
    near = placed.withColumn("i", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    exact = F.col("i") * F.lit(total - 1) / F.lit(float(steps))
    for_low = (F.floor(exact) >= F.col("before")) & (F.floor(exact) < F.col("before") + F.col("n"))
    for_high = (F.ceil(exact) >= F.col("before")) & (F.ceil(exact) < F.col("before") + F.col("n"))
    rows = (
        near.where(for_low | for_high).groupBy("i")
        .agg(F.max(F.when(for_low, F.col("v"))).alias("low"), F.max(F.when(for_high, F.col("v"))).alias("high"), F.first(exact).alias("at"))
        .orderBy("i").collect()  # steps + 1 rows
    )
    return [r["low"] + (r["high"] - r["low"]) * (r["at"] - math.floor(r["at"])) for r in rows]
