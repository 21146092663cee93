"""Small helpers shared by the operators: column kinds, unpivoting, row ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def field(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row id for tables without a key; stable for a fixed file layout, assign once right after the scan."""
    return df.select(F.monotonically_increasing_id().alias(name), "*")


def melt(df: DataFrame, entries: list[tuple[str, dict[str, Column]]], keep: list[str] = ()) -> DataFrame:
    """One output row per entry and input row: the label in `column` plus the named expressions."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("column"), *[expr.alias(name) for name, expr in values.items()])
        for label, values in entries
    ])
    return df.select(*keep, F.explode(rows).alias("entry")).select(*keep, "entry.*")


def cell_text(df: DataFrame, name: str) -> Column:
    """Text form of a cell, NaN as NULL, so cells of several types fit one column."""
    kind = field(df, name)
    cell = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        cell = F.when(~F.isnan(cell), cell)
    return cell.cast("string")


def long_cells(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep…, column, value) with one row per cell."""
    return melt(df, [(c, {"value": cell_text(df, c)}) for c in columns], keep)


def cell_shares(df: DataFrame, columns: list[str], test) -> dict[str, float]:
    """Of every column, the share of all its filled cells that pass a test; one aggregate over the whole table."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), test(F.col(c)).cast("int"))).alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def with_few(df: DataFrame, limit: int) -> DataFrame:
    """Sent to all tasks if it has at most `limit` rows, else left to a shuffle. Counts, so give it a written or small frame."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a key, for costly steps on tables of few files. The width is explicit: adaptive coalescing judges bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Put expensive columns behind a one-row generator.

    Filters on them stay above it. Without that, a filter would be pushed below a stack of
    projections by inlining every step, which multiplies the work and the plan.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)
