"""Differences between two versions of a table, recovery against ground truth, drift and temporal checks.

Versions are matched on an explicit row id, so removed rows do not shift the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import standardize_date
from tablewright.functions.text import canonical, same
from tablewright.functions.tokens import AUDIT_TOKENS, DIFF_TOKENS, is_dirty
from tablewright.operators.frames import TEMPORAL, field, melt
from tablewright.operators.profile import distinct_counts
from tablewright.operators.quantiles import exact_quantiles, quantile_grid
from tablewright.operators.shape import AGE_RANGE, SALARY_FLOOR

# Operation family of each planned action, and name pairs that run in time order.
OPERATION_FAMILY = {
    "smart_impute": "Null Handling",
    "impute_mean": "Null Handling",
    "impute_mode": "Null Handling",
    "remove_outliers": "Outlier Removal",
    "standardize_date": "Standardization",
    "fuzzy_fix": "Standardization",
    "clean_pattern": "Pattern Cleaning",
    "drop": "Column Drop",
}
REPORTED_FAMILIES = ["Null Handling", "Outlier Removal", "Standardization", "Type Casting", "Deduplication", "Pattern Cleaning", "General Cleaning"]
TIME_PAIRS = [("start", "end"), ("join", "exit"), ("hire", "resign"), ("create", "update")]


def shared_columns(before: DataFrame, after: DataFrame, row_id: str) -> list[str]:
    return [c for c in before.columns if c in after.columns and c != row_id]


def _paired(before: DataFrame, after: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    left = before.select(row_id, *[F.col(c).alias(f"b_{c}") for c in columns])
    right = after.select(row_id, *[F.col(c).alias(f"a_{c}") for c in columns])
    return left.join(right, row_id)


def _comparable(col: Column, kind: T.DataType, other: T.DataType) -> Column:
    if type(kind) is type(other):
        return col
    if isinstance(kind, T.NumericType) and isinstance(other, T.NumericType):
        return col.cast("double")
    return col.cast("string")


def _changed(before: DataFrame, after: DataFrame, c: str, tokens: list[str]) -> Column:
    old, new = F.col(f"b_{c}"), F.col(f"a_{c}")
    kind, other = field(before, c), field(after, c)
    was_dirty, is_now = is_dirty(old, kind, tokens), is_dirty(new, other, tokens)
    differs = ~_comparable(old, kind, other).eqNullSafe(_comparable(new, other, kind))
    return (was_dirty & ~is_now) | (~was_dirty & ~is_now & differs)


def changed_cells(before: DataFrame, after: DataFrame, row_id: str, tokens: list[str] = DIFF_TOKENS) -> DataFrame:
    """(column, row_id) of every filled or altered cell."""
    columns = shared_columns(before, after, row_id)
    names = F.array_compact(F.array(*[F.when(_changed(before, after, c, tokens), F.lit(c)) for c in columns]))
    return _paired(before, after, row_id, columns).select(F.explode(names).alias("column"), F.col(row_id).alias("row_id"))


def dirty_cells(df: DataFrame, row_id: str, tokens: list[str] = DIFF_TOKENS) -> DataFrame:
    """(column, row_id) of every NULL, NaN or token cell."""
    names = F.array_compact(F.array(*[F.when(is_dirty(F.col(c), field(df, c), tokens), F.lit(c)) for c in df.columns if c != row_id]))
    return df.select(F.explode(names).alias("column"), F.col(row_id).alias("row_id"))


def _changed_counts(before: DataFrame, after: DataFrame, row_id: str, tokens: list[str]) -> DataFrame:
    columns = shared_columns(before, after, row_id)
    counts = _paired(before, after, row_id, columns).agg(*[F.count_if(_changed(before, after, c, tokens)).alias(c) for c in columns])
    return melt(counts, [(c, {"cells_changed": F.col(c)}) for c in columns])


def audit_totals(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    """One row: rows and missing cells on each side, changed cells and percent, removed rows, compliance rate."""
    columns = [c for c in before.columns if c != row_id]
    kept = [c for c in after.columns if c != row_id]

    def nulls(df: DataFrame, names: list[str]) -> list[Column]:
        return [(F.count("*") - F.count(F.when(~_nan(df, c), F.col(c)))).alias(c) for c in names]

    old = before.agg(F.count("*").alias("__rows"), *nulls(before, columns)).first()
    new = after.agg(F.count("*").alias("__rows"), *nulls(after, kept)).first()
    rates = [(1 - new[c] / max(new["__rows"], 1)) * 100 for c in kept]
    cells = old["__rows"] * len(columns)
    changed = _changed_counts(before, after, row_id, AUDIT_TOKENS).agg(F.coalesce(F.sum("cells_changed"), F.lit(0)).alias("cells_changed"))
    return changed.select(
        F.lit(old["__rows"]).alias("rows_before"), F.lit(new["__rows"]).alias("rows_after"), F.lit(len(columns)).alias("columns"),
        F.lit(cells).alias("total_cells"), "cells_changed",
        F.bround(F.col("cells_changed") / float(max(cells, 1)) * 100, 2).alias("pct_corrected"),
        F.lit(max(0, old["__rows"] - new["__rows"])).alias("duplicates_removed"),
        F.lit(sum(old[c] for c in columns)).alias("missing_before"), F.lit(sum(new[c] for c in kept)).alias("missing_after"),
        F.bround(F.lit(sum(rates) / len(rates) if rates else 100.0), 2).alias("compliance_rate"),
    )


def _nan(df: DataFrame, c: str) -> Column:
    return F.isnan(F.col(c)) if isinstance(field(df, c), (T.DoubleType, T.FloatType)) else F.lit(False)


def status_label(missing_before: Column, missing_after: Column, changed: Column) -> Column:
    return (
        F.when((changed > 0) & (missing_after == 0), "FIXED")
        .when((changed > 0) & (missing_after > 0), "PARTIALLY FIXED")
        .when((changed == 0) & (missing_before == 0), "CLEAN")
        .when((changed == 0) & (missing_after > 0), "ISSUE REMAINS")
        .otherwise("MODIFIED")
    )


def _side_stats(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    aggregates, entries, distinct = [], [], distinct_counts(df, columns)
    for c in columns:
        number = isinstance(field(df, c), T.NumericType)
        value = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) if number else F.lit(None).cast("double")
        aggregates.append(F.struct(
            F.count_if(is_dirty(F.col(c), field(df, c))).alias("missing"), F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")).alias(f"s_{c}"))
        entries.append((c, {
            f"missing_{side}": F.col(f"s_{c}.missing"), f"unique_{side}": F.lit(distinct[c]).cast("bigint"),
            **{f"{k}_{side}": F.bround(F.col(f"s_{c}.{k}"), 4) for k in ("mean", "std", "min", "max")},
        }))
    return melt(df.agg(*aggregates), entries)


def column_audit(before: DataFrame, after: DataFrame, row_id: str, plan: dict[str, str] | None = None) -> DataFrame:
    """One row per shared column: operation, changed cells, dirty cells and statistics on each side, status."""
    columns = shared_columns(before, after, row_id)
    joined = (
        _changed_counts(before, after, row_id, AUDIT_TOKENS)
        .join(_side_stats(before, columns, "before"), "column").join(_side_stats(after, columns, "after"), "column")
    )
    family = F.lit("General Cleaning")
    for column, action in (plan or {}).items():
        family = F.when(F.col("column") == column, OPERATION_FAMILY.get(action, "General Cleaning")).otherwise(family)
    return joined.withColumn("operation", family).withColumn(
        "status", status_label(F.col("missing_before"), F.col("missing_after"), F.col("cells_changed"))
    )


def operation_breakdown(audit: DataFrame, duplicates_removed: int = 0) -> DataFrame:
    """Changed cells per operation family; removed duplicates count under Deduplication."""
    families = audit.sparkSession.createDataFrame([(f,) for f in REPORTED_FAMILIES], "operation string")
    sums = audit.groupBy("operation").agg(F.sum("cells_changed").alias("cells"))
    extra = F.when(F.col("operation") == "Deduplication", F.lit(duplicates_removed)).otherwise(F.lit(0))
    return families.join(sums, "operation", "left").select("operation", (F.coalesce("cells", F.lit(0)) + extra).alias("cells"))


def null_comparison(before: DataFrame, after: DataFrame, row_id: str, top: int = 15) -> DataFrame:
    """Missing cells per column on each side and cells fixed, most fixed first."""
    columns = shared_columns(before, after, row_id)

    def side(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(F.count("*").alias("__rows"), *[F.count(F.when(~_nan(df, c), F.col(c))).alias(c) for c in columns])
        return melt(counts, [(c, {name: F.col("__rows") - F.col(c)}) for c in columns])

    joined = side(before, "nulls_before").join(side(after, "nulls_after"), "column")
    fixed = F.greatest(F.lit(0), F.col("nulls_before") - F.col("nulls_after"))
    shown = joined.where((F.col("nulls_before") > 0) | (F.col("nulls_after") > 0)).withColumn("cells_fixed", fixed)
    return shown.orderBy(F.desc("cells_fixed"), "column").limit(top)


def histogram_drift(before: DataFrame, after: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """(column, side, bin, density) over shared equal-width bins."""
    ends = [f.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double"), F.count(c)).alias(c) for c in columns]).first() for f in (before, after)]
    result = None
    for side, df, own in (("before", before, ends[0]), ("after", after, ends[1])):
        cells = []
        for c in columns:
            lows, highs = [e[c][0] for e in ends if e[c][0] is not None], [e[c][1] for e in ends if e[c][1] is not None]
            if not lows or own[c][2] == 0:
                continue
            width = (max(highs) - min(lows)) / bins or 1.0
            index = F.least(F.floor((F.col(c) - min(lows)) / width), F.lit(bins - 1)).cast("int")
            cells.append((c, {"bin": index, "unit": F.lit(1.0 / (own[c][2] * width))}))
        part = melt(df, cells).where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(
            (F.count("*") * F.max("unit")).alias("density")).select("column", F.lit(side).alias("side"), "bin", "density")
        result = part if result is None else result.unionByName(part)
    return result


def box_statistics(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """min, quartiles, max per numeric column and side."""
    rows = []
    for side, df in (("before", before), ("after", after)):
        cuts = exact_quantiles(df, {c: [0.0, 0.25, 0.5, 0.75, 1.0] for c in columns})
        rows += [(c, side, *[cuts[c][p] for p in (0.0, 0.25, 0.5, 0.75, 1.0)]) for c in columns]
    return before.sparkSession.createDataFrame(rows, "column string, side string, lowest double, p25 double, p50 double, p75 double, highest double")


def drift_report(before: DataFrame, after: DataFrame, columns: list[str], steps: int = 1000) -> DataFrame:
    """Earth-mover distance on a quantile grid, median shift, variance collapse and alert per column."""
    rows = []

    def numeric(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).try_cast("double").alias(c) if isinstance(field(df, c), T.StringType) else F.col(c).cast("double").alias(c) for c in columns])

    old, new = numeric(before), numeric(after)
    spread = [f.agg(*[F.struct(F.count(c), F.stddev_pop(c), F.var_pop(c)).alias(c) for c in columns]).first() for f in (old, new)]
    for c in columns:
        if not spread[0][c][0] or not spread[1][c][0]:
            continue
        one, two = quantile_grid(old, c, steps), quantile_grid(new, c, steps)
        distance = sum(abs(a - b) for a, b in zip(one[:-1], two[:-1])) / steps
        std, var, var_after = spread[0][c][1], spread[0][c][2], spread[1][c][2]
        middle = [g[steps // 2] if steps % 2 == 0 else (g[steps // 2] + g[steps // 2 + 1]) / 2 for g in (one, two)]
        normal = distance / std if std > 0 else 0.0
        shift = abs(middle[0] - middle[1]) / middle[0] * 100 if middle[0] > 0 else 0.0
        collapse = (var - var_after) / var if var > 0 else 0.0
        rows.append((c, distance, normal, shift, collapse * 100, normal > 0.25 or collapse > 0.50))
    return before.sparkSession.createDataFrame(
        rows, "column string, wasserstein double, normalized double, median_shift_pct double, variance_collapse_pct double, alert boolean"
    )


def correlation_shift(before: DataFrame, after: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of two columns on each side, its absolute shift, and OK / DRIFT_DETECTED / INSUFFICIENT_DATA."""

    def side(df: DataFrame, name: str) -> DataFrame:
        a, b = F.col(x).try_cast("double"), F.col(y).try_cast("double")
        both = a.isNotNull() & b.isNotNull()
        return df.agg(F.corr(a, b).alias(f"{name}_r"), F.count_if(both).alias(f"{name}_n")).withColumn("k", F.lit(1))

    joined = side(before, "before").join(side(after, "after"), "k")
    enough = (F.col("before_n") >= 5) & (F.col("after_n") >= 5)
    shift = F.coalesce(F.abs(F.nanvl("before_r", F.lit(None).cast("double")) - F.nanvl("after_r", F.lit(None).cast("double"))), F.lit(0.0))
    shift = F.when(enough, shift).otherwise(F.lit(0.0))
    status = F.when(~enough, "INSUFFICIENT_DATA").when(shift < 0.2, "OK").otherwise("DRIFT_DETECTED")
    return joined.select("before_r", "after_r", shift.alias("shift"), status.alias("status"))


def semantic_scores(before: DataFrame, after: DataFrame, age: str, salary: str) -> DataFrame:
    """One row: share of rows inside the logical bounds, and realism after drift and correlation penalties."""
    age_value, pay = F.col(age).cast("double"), F.col(salary).try_cast("double")
    bad = (age_value < AGE_RANGE[0]) | (age_value > AGE_RANGE[1]) | (pay < SALARY_FLOOR)
    integrity = F.when(F.count("*") > 0, F.count_if(~F.coalesce(bad, F.lit(False))) / F.count("*") * 100).otherwise(F.lit(100.0))
    realism = 100.0
    for row in drift_report(before, after, [age, salary]).collect():  # two rows
        realism -= (10.0 if row["alert"] else 0.0) + (15.0 if row["normalized"] > 0.5 else 0.0)
    if correlation_shift(before, after, age, salary).first()["shift"] > 0.2:
        realism -= 10.0
    return after.agg(integrity.alias("integrity_score")).withColumn("realism_score", F.lit(max(0.0, realism)))


def identifier_check(before: DataFrame, after: DataFrame, row_id: str, identifiers: list[str]) -> DataFrame:
    """OK, DROPPED, MUTATED (with count) or INDEX_CORRUPTED per identifier column."""
    present = [c for c in identifiers if c in after.columns]
    joined = _paired(before, after, row_id, present)
    changed = joined.agg(F.count("*").alias("__rows"), *[F.count_if(~F.col(f"b_{c}").cast("string").eqNullSafe(F.col(f"a_{c}").cast("string"))).alias(c) for c in present])
    entries = []
    for c in identifiers:
        if c in present:
            status = F.when(F.col("__rows") == 0, "INDEX_CORRUPTED").when(F.col(c) > 0, "MUTATED").otherwise("OK")
            entries.append((c, {"status": status, "mutated": F.col(c)}))
        else:
            entries.append((c, {"status": F.lit("DROPPED"), "mutated": F.lit(0).cast("bigint")}))
    return melt(changed, entries)


def _canonical_side(df: DataFrame, side: str, row_id: str, columns: list[str], arabic: list[str]) -> DataFrame:
    return df.select(row_id, *[canonical(F.col(c), c in arabic).alias(f"{side}_{c}") for c in columns])


def _triple(truth: DataFrame, corrupted: DataFrame, cleaned: DataFrame, row_id: str, columns: list[str], arabic: list[str]) -> DataFrame:
    frames = [_canonical_side(d, p, row_id, columns, arabic) for p, d in (("t", truth), ("r", corrupted), ("c", cleaned))]
    return frames[0].join(frames[1], row_id).join(frames[2], row_id)


def recovery_metrics(truth: DataFrame, corrupted: DataFrame, cleaned: DataFrame, row_id: str, arabic: list[str] = ()) -> DataFrame:
    """One row: exact-match recovery, over-cleaning rate and corruption rate in percent, with the cell counts."""
    columns = [c for c in truth.columns if c in cleaned.columns and c != row_id]
    joined = _triple(truth, corrupted, cleaned, row_id, columns, list(arabic))
    sums: dict[str, list[Column]] = {"corrupted": [], "restored": [], "safe": [], "over": [], "invalid": []}
    for c in columns:
        t, r, k = F.col(f"t_{c}"), F.col(f"r_{c}"), F.col(f"c_{c}")
        broken = ~same(r, t)
        sums["corrupted"].append(broken)
        sums["restored"].append(broken & same(k, t))
        sums["safe"].append(~broken)
        sums["over"].append(~broken & ~same(k, r))
        sums["invalid"].append((k["text"].isNull() & t["text"].isNotNull()) | F.coalesce(k["text"].isin("NaT", "nan", "NaN", "ERROR", "error"), F.lit(False)))

    def total(parts: list[Column]) -> Column:
        count = F.lit(0)
        for p in parts:
            count = count + p.cast("int")
        return F.coalesce(F.sum(count), F.lit(0))

    stats = joined.agg(F.count("*").alias("rows"), *[total(v).alias(k) for k, v in sums.items()])
    return stats.select(
        F.col("corrupted").alias("corrupted_cells"), F.col("restored").alias("restored_cells"), F.col("safe").alias("safe_cells"),
        F.col("over").alias("over_cleaned_cells"), F.col("invalid").alias("invalid_cells"),
        F.when(F.col("corrupted") > 0, F.col("restored") / F.col("corrupted") * 100).otherwise(F.lit(100.0)).alias("exact_match_accuracy"),
        F.when(F.col("safe") > 0, F.col("over") / F.col("safe") * 100).otherwise(F.lit(0.0)).alias("over_cleaning_rate"),
        F.when(F.col("rows") > 0, F.col("invalid") / (F.col("rows") * len(columns)) * 100).otherwise(F.lit(0.0)).alias("corruption_rate"),
    )


def recovery_by_kind(
    truth: DataFrame, cleaned: DataFrame, injected: DataFrame, row_id: str, groups: dict[str, tuple[list[str], list[str]]], arabic: list[str] = ()
) -> DataFrame:
    """Share of recovered cells per corruption group; `groups` maps a name to (injected kinds, judged columns)."""
    columns = sorted({c for _, judged in groups.values() for c in judged})
    joined = _canonical_side(truth, "b", row_id, columns, list(arabic)).join(_canonical_side(cleaned, "a", row_id, columns, list(arabic)), row_id)
    good = joined.select(row_id, *[same(F.col(f"b_{c}"), F.col(f"a_{c}")).cast("int").alias(c) for c in columns])
    name = F.lit(None).cast("string")
    names = F.array_compact(F.array(*[F.when(F.col("kind").isin(kinds), F.lit(g)) for g, (kinds, _) in groups.items()], name))
    touched = injected.select(F.col("row_id").alias(row_id), F.explode(names).alias("group")).distinct()
    matched, judged = F.lit(0), F.lit(0)
    for g, (_, cols) in groups.items():
        hits = F.lit(0)
        for c in cols:
            hits = hits + F.col(c)
        matched = F.when(F.col("group") == g, hits).otherwise(matched)
        judged = F.when(F.col("group") == g, F.lit(len(cols))).otherwise(judged)
    found = touched.join(good, row_id).groupBy("group").agg(F.sum(matched).alias("matched"), F.sum(judged).alias("judged"))
    every = truth.sparkSession.createDataFrame([(g,) for g in groups], "group string")
    return every.join(found, "group", "left").select(
        "group", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("judged", F.lit(0)).alias("judged"),
        F.when(F.col("judged") > 0, F.col("matched") / F.col("judged") * 100).otherwise(F.lit(100.0)).alias("recovered_pct"),
    )


def temporal_checks(df: DataFrame, now: Column) -> DataFrame:
    """(check, column, other, violations): future dates per date column, and end-before-start for named pairs."""
    dates: dict[str, Column] = {}
    for f in df.schema:
        if isinstance(f.dataType, TEMPORAL):
            dates[f.name] = F.col(f.name).cast("timestamp")
        elif isinstance(f.dataType, T.StringType) and ("date" in f.name.lower() or "time" in f.name.lower()):
            dates[f.name] = standardize_date(F.col(f.name))
    pairs = [
        (a, b) for a in dates for b in dates for first, second in TIME_PAIRS if a != b and first in a.lower() and second in b.lower()
    ]
    pairs = list(dict.fromkeys(pairs))
    stats = df.agg(
        *[F.count_if(v > now).alias(f"f_{c}") for c, v in dates.items()], *[F.count_if(dates[b] < dates[a]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = [F.struct(F.lit("future_date").alias("check"), F.lit(c).alias("column"), F.lit("").alias("other"), F.col(f"f_{c}").alias("violations")) for c in dates]
    rows += [F.struct(F.lit("end_before_start").alias("check"), F.lit(b).alias("column"), F.lit(a).alias("other"), F.col(f"p{i}").alias("violations")) for i, (a, b) in enumerate(pairs)]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
