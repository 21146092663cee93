"""Outlier rules, robust scaling and multivariate anomaly flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.frames import field
from tablewright.operators.quantiles import exact_quantiles

# Thresholds of the adaptive rule.
SMALL_SAMPLE = 15
SKEW_LIMIT = 1.5
IQR_FACTOR = 1.5
MAD_SCALE = 0.6745


@dataclass(frozen=True)
class OutlierRule:
    """Which test applies to a column, as scalars."""

    method: str
    low: float | None = None
    high: float | None = None
    centre: float | None = None
    scale: float | None = None
    threshold: float = 3.0

    def flag(self, col: Column) -> Column:
        if self.method in ("percentile", "iqr"):
            test = (col < self.low) | (col > self.high)
        elif self.method == "mad":
            test = F.abs((col - self.centre) * MAD_SCALE / self.scale) > self.threshold
        elif self.method == "zscore":
            test = F.abs((col - self.centre) / self.scale) > self.threshold
        else:
            test = F.lit(False)
        return F.coalesce(test & ~F.isnan(col.cast("double")), F.lit(False))


def sample_skew(n: int, population_skew: float | None) -> float:
    """Bias-corrected skewness from the population value."""
    if population_skew is None or n < 3 or population_skew != population_skew:
        return 0.0
    return population_skew * (n * (n - 1)) ** 0.5 / (n - 2)


def adaptive_rules(df: DataFrame, columns: list[str], threshold: float = 3.0) -> dict[str, OutlierRule]:
    """Percentiles under 15 values, IQR when skewed, else MAD, else standard score when MAD is zero.

    All columns share the passes: moments, quantiles, deviations.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    row = df.agg(*[F.struct(F.count(value[c]), F.skewness(value[c]), F.avg(value[c]), F.stddev_samp(value[c])).alias(c) for c in columns]).first()
    moments = {c: tuple(row[c]) for c in columns}
    cuts = exact_quantiles(df, {c: [0.01, 0.25, 0.5, 0.75, 0.99] for c in columns})
    rules: dict[str, OutlierRule] = {}
    symmetric = []
    for c in columns:
        n, skew, _, _ = moments[c]
        q = cuts[c]
        if n == 0:
            rules[c] = OutlierRule("none")
        elif n < SMALL_SAMPLE:
            rules[c] = OutlierRule("percentile", q[0.01], q[0.99])
        elif abs(sample_skew(n, skew)) > SKEW_LIMIT:
            spread = IQR_FACTOR * (q[0.75] - q[0.25])
            rules[c] = OutlierRule("iqr", q[0.25] - spread, q[0.75] + spread)
        else:
            symmetric.append(c)
    if symmetric:
        deviations = df.select(*[F.abs(F.col(c).cast("double") - cuts[c][0.5]).alias(c) for c in symmetric])
        mad = exact_quantiles(deviations, {c: [0.5] for c in symmetric})
        for c in symmetric:
            _, _, mean, std = moments[c]
            if mad[c][0.5]:
                rules[c] = OutlierRule("mad", centre=cuts[c][0.5], scale=mad[c][0.5], threshold=threshold)
            elif std:
                rules[c] = OutlierRule("zscore", centre=mean, scale=std, threshold=threshold)
            else:
                rules[c] = OutlierRule("none")
    return rules


def null_outliers(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Replace outliers by NULL."""
    rules = adaptive_rules(df, columns, threshold)
    return df.withColumns({c: F.when(~rules[c].flag(F.col(c)), F.col(c)).cast(field(df, c)) for c in columns})


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x − median) / IQR; a zero IQR divides by one."""
    cuts = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    return df.withColumns({
        c: (F.col(c) - (cuts[c][0.5] or 0.0)) / (((cuts[c][0.75] or 0.0) - (cuts[c][0.25] or 0.0)) or 1.0) for c in columns
    })
