"""Duplicates, unions by key, schema comparison and catalog upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that do not count when rows are compared, and the deletion limit in percent.
IDENTITY_NAMES = ["id", "name", "identifier", "index"]
MAX_DELETION_PCT = 5.0


def drop_duplicates_first(df: DataFrame, row_id: str, ignore: list[str] = ()) -> DataFrame:
    """Keep the row with the lowest id among equal rows.

    One hash aggregation, combined map-side, so a value shared by a third of all rows costs one
    partial row per task. Columns in `ignore` (and the row id) do not take part in the comparison
    and come from the kept row.
    """
    free = [c for c in df.columns if c in ignore and c != row_id]
    keys = [c for c in df.columns if c != row_id and c not in free]
    if not free:
        kept = df.groupBy(*keys).agg(F.min(row_id).alias(row_id))
    else:
        kept = df.groupBy(*keys).agg(F.min(F.struct(row_id, *free)).alias("__row")).select(*keys, "__row.*")
    return kept.select(*df.columns)


def drop_duplicates_ignoring_ids(df: DataFrame, row_id: str) -> DataFrame:
    """Duplicates by every column except id-like names."""
    ignore = [c for c in df.columns if c.lower() in IDENTITY_NAMES and c != row_id]
    if len(ignore) + 1 >= len(df.columns):
        ignore = []
    return drop_duplicates_first(df, row_id, ignore)


def duplicate_counts(df: DataFrame, row_id: str, ignore: list[str] = ()) -> DataFrame:
    """One row: rows before, distinct rows, rows to remove."""
    keys = [c for c in df.columns if c != row_id and c not in ignore]
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def deletion_guard(counts: DataFrame, limit_pct: float = MAX_DELETION_PCT) -> DataFrame:
    """Share of removed rows and a warning flag above the limit."""
    pct = F.when(F.col("rows_before") > 0, F.col("removed") / F.col("rows_before") * 100).otherwise(F.lit(0.0))
    return counts.withColumn("removed_pct", pct).withColumn("exceeds_limit", F.col("removed_pct") > limit_pct)


def union_by_key(lists: list[DataFrame], key: Column, priority: str = "source_rank", order: str = "position") -> DataFrame:
    """Union candidate lists and keep, per key, the entry seen first (lowest list number, then lowest position)."""
    tagged = None
    for rank, frame in enumerate(lists):
        part = frame.withColumn(priority, F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (priority, order)]
    best = tagged.groupBy(key.alias("key")).agg(F.min(F.struct(priority, order, *rest)).alias("__best"))
    return best.select("key", "__best.*")


def schema_table(df: DataFrame, side: str) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, f"column string, {side}_type string")


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """PRESERVED, MUTATED, DROPPED or ADDED for every column of either side."""
    joined = schema_table(before, "before").join(schema_table(after, "after"), "column", "full_outer")
    status = (
        F.when(F.col("after_type").isNull(), "DROPPED")
        .when(F.col("before_type").isNull(), "ADDED")
        .when(F.col("before_type") != F.col("after_type"), "MUTATED")
        .otherwise("PRESERVED")
    )
    return joined.select(
        "column", F.coalesce("before_type", F.lit("N/A")).alias("before_type"), F.coalesce("after_type", F.lit("N/A")).alias("after_type"),
        status.alias("status"),
    )


def upsert(catalog: DataFrame, incoming: DataFrame, key: str, replace: list[str], maximum: list[str]) -> DataFrame:
    """Merge new metadata into a catalog: replaced when present, numeric maxima kept, unknown keys inserted."""
    old = catalog.select(key, *[F.col(c).alias(f"__old_{c}") for c in catalog.columns if c != key])
    new = incoming.select(key, *[F.col(c).alias(f"__new_{c}") for c in catalog.columns if c != key and c in incoming.columns])
    joined = old.join(new, key, "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c not in incoming.columns:
            return F.col(f"__old_{c}").alias(c)
        if c in maximum:
            return F.greatest(f"__new_{c}", f"__old_{c}").alias(c)
        blank = F.lit("") if isinstance(catalog.schema[c].dataType, T.StringType) else F.lit(0)
        plain = isinstance(catalog.schema[c].dataType, (T.StringType, T.NumericType))
        fresh = F.nullif(F.col(f"__new_{c}"), blank) if plain else F.col(f"__new_{c}")
        order = [fresh, F.col(f"__old_{c}")] if c in replace else [F.col(f"__old_{c}"), F.col(f"__new_{c}")]
        return F.coalesce(*order).alias(c)

    return joined.select(*[value(c) for c in catalog.columns])
