"""Projections, filters and type coercion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.numbers import clip_logical
from tablewright.functions.tokens import AUDIT_TOKENS, CLEANER_TOKENS, is_dirty, tokens_to_null
from tablewright.operators.frames import field, melt, string_columns

# Bounds checked on people tables.
AGE_RANGE = (0, 120)
SALARY_FLOOR = 0


def drop_columns(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Drop the columns whose planned action is `drop`."""
    return df.drop(*[c for c, action in plan.items() if action == "drop"])


def without_blacklist(df: DataFrame, blacklist: list[str], target: str) -> DataFrame:
    """Project away blacklisted columns, never the target."""
    banned = {sanitize_name(c) for c in blacklist} | set(blacklist)
    return df.select(*[c for c in df.columns if c == target or c not in banned])


def replace_tokens(df: DataFrame, tokens: list[str] = CLEANER_TOKENS) -> DataFrame:
    return df.withColumns({c: tokens_to_null(F.col(c), tokens) for c in string_columns(df)}) if string_columns(df) else df


def dirty_flags(df: DataFrame, columns: list[str], tokens: list[str] = AUDIT_TOKENS) -> DataFrame:
    """Add `<c>_dirty` for every column."""
    return df.withColumns({f"{c}_dirty": is_dirty(F.col(c), field(df, c), tokens) for c in columns})


def _castable_ratio(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    ratios = df.agg(*[
        (F.count(F.trim(F.col(c)).try_cast("double")) / F.nullif(F.count(c), F.lit(0))).alias(c) for c in columns
    ]).first()
    return ratios.asDict()


def coerce_hidden_numbers(df: DataFrame, threshold: float = 0.70, force: list[str] = (), strictly_above: bool = False) -> tuple[DataFrame, list[str]]:
    """Cast string columns whose non-NULL cells mostly parse as numbers; returns the frame and the cast columns."""
    texts = string_columns(df)
    candidates = [c for c in texts if c not in force]
    ratios = _castable_ratio(df, candidates) if candidates else {}
    passed = [c for c in candidates if ratios[c] is not None and (ratios[c] > threshold if strictly_above else ratios[c] >= threshold)]
    chosen = [c for c in texts if c in force or c in passed]
    if chosen:
        df = df.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in chosen})
    return df, chosen


def coercion_report(df: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Per string column: non-NULL cells, castable ratio, cells whose text changes or is lost by the cast, and the decision."""
    texts = string_columns(df)
    number = {c: F.trim(F.col(c)).try_cast("double") for c in texts}
    stats = df.agg(*[
        F.struct(
            F.count(c).alias("non_null"),
            F.count(number[c]).alias("parsed"),
            F.count_if(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(number[c].cast("string"))).alias("changed"),
        ).alias(c) for c in texts
    ])
    rows = melt(stats, [(c, {"non_null": F.col(f"`{c}`.non_null"), "parsed": F.col(f"`{c}`.parsed"), "changed": F.col(f"`{c}`.changed")}) for c in texts])
    ratio = F.col("parsed") / F.nullif(F.col("non_null"), F.lit(0))
    return rows.select(
        "column", "non_null", F.coalesce(ratio, F.lit(0.0)).alias("ratio"), F.coalesce(ratio > threshold, F.lit(False)).alias("coerced"),
        F.when(ratio > threshold, F.col("changed")).otherwise(F.lit(0)).alias("changed_cells"),
    )


def enforce_bounds(df: DataFrame) -> DataFrame:
    """Clip every numeric column whose name means a non-negative quantity."""
    return df.withColumns({
        f.name: clip_logical(F.col(f.name), f.name).cast(f.dataType) for f in df.schema if isinstance(f.dataType, T.NumericType)
    })


def align_schema(df: DataFrame, schema: T.StructType, required: list[str] = ()) -> DataFrame:
    """Select exactly the schema's columns in order; missing ones become NULL, missing required ones raise."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("duplicate columns in input")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema
    ])


def sanitize_name(name: str) -> str:
    """Letters, digits and underscore only; `feat_` before a leading digit."""
    plain = re.sub(r"['\"\[\](){}]", "", str(name))
    plain = re.sub(r"[^a-zA-Z0-9_]+", "_", plain)
    plain = re.sub(r"_{2,}", "_", plain).strip("_")
    if not plain:
        return "feat"
    return plain if not plain[0].isdigit() else "feat_" + plain


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename all columns to safe names; collisions get `_1`, `_2`, …"""
    taken: dict[str, int] = {}
    names = []
    for column in df.columns:
        safe = sanitize_name(column)
        n = taken.get(safe, -1) + 1
        taken[safe] = n
        names.append(safe if n == 0 else f"{safe}_{n}")
    return df.toDF(*names)


def bounds_violations(df: DataFrame, row_id: str, age: str | None = "age", salary: str | None = "salary") -> DataFrame:
    """(row_id, rule) for rows outside the logical bounds."""
    rules = []
    if age in df.columns:
        value = F.col(age).cast("double")
        rules.append(F.when((value < AGE_RANGE[0]) | (value > AGE_RANGE[1]), "age_bounds"))
    if salary in df.columns:
        value = F.col(salary).try_cast("double")
        rules.append(F.when(value < SALARY_FLOOR, "salary_bounds"))
    return df.select(row_id, F.explode(F.array(*rules)).alias("rule")).where(F.col("rule").isNotNull())
