"""The cleaning plan: which action runs on which column, compiled to lazy projections between statistics jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import standardize_date
from tablewright.functions.numbers import clip_logical, parse_numbers
from tablewright.functions.patterns import clean_email, clean_phone
from tablewright.functions.tokens import CLEANER_TOKENS
from tablewright.operators.dedup import drop_duplicates_ignoring_ids
from tablewright.operators.frames import field as field_type
from tablewright.operators.frames import numeric_columns, string_columns
from tablewright.operators.forest import anomaly_flags
from tablewright.operators.fuzzy import apply_map, consolidation_map, merge_typos
from tablewright.operators.impute import (advanced_impute, downgrade_columns, expand_date_text, fill_by_model, fill_ordered, fill_simple, is_time_series)
from tablewright.operators.outliers import null_outliers, robust_scale
from tablewright.operators.dedup import drop_duplicates_first
from tablewright.operators.shape import coerce_hidden_numbers, replace_tokens
from tablewright.plans.policy import Policy
from tablewright.session import checkpointed

# Name hints of the plan levels.
ID_HINTS = ["id", "phone", "mobile", "code", "zip", "year"]
NUMBER_TEXT_HINTS = ["salary", "price", "amount", "cost", "budget", "revenue", "income"]
LABEL_HINTS = ["city", "job", "title", "country", "name", "governorate", "department", "status", "category"]
NUMERIC_ACTIONS = ["smart_impute", "remove_outliers", "impute_mean", "impute_mode"]
DERIVED_SUFFIXES = ("_year", "_month", "_day", "_is_weekend")


@dataclass
class CleaningPlan:
    actions: dict[str, str]
    remove_duplicates: bool = False
    model_fill: bool = True


@dataclass
class CleaningResult:
    table: DataFrame
    policy: Policy
    log: list[str] = field(default_factory=list)

    @property
    def confidence(self) -> float:
        return self.policy.confidence()


def plan_for(df: DataFrame, row_id: str, level: str = "beta", sensitive: tuple[str, ...] = ()) -> CleaningPlan:
    """Actions by level (alpha, beta, gamma) from types, names and one null count."""
    if level not in ("alpha", "beta", "gamma"):
        raise ValueError("level must be alpha, beta or gamma")
    columns = [f for f in df.schema if f.name != row_id]
    gaps = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in columns]).first()
    actions: dict[str, str] = {}
    for f in columns:
        low, missing = f.name.lower(), gaps[f.name] > 0

        def has(hints: list[str]) -> bool:
            return any(h in low for h in hints)

        if f.name in sensitive and level == "gamma":
            action = "smart_impute" if missing else None
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or "date" in low:
            action = "standardize_date"
        elif isinstance(f.dataType, T.NumericType):
            if has(ID_HINTS) or level == "alpha":
                action = "smart_impute" if missing else None
            else:
                action = "remove_outliers"
        elif isinstance(f.dataType, T.StringType):
            action = "remove_outliers" if has(NUMBER_TEXT_HINTS) else "fuzzy_fix" if has(LABEL_HINTS) else "smart_impute" if missing else None
        else:
            action = None
        if action:
            actions[f.name] = action
    return CleaningPlan(actions, remove_duplicates=level in ("beta", "gamma"))


def execute(df: DataFrame, row_id: str, plan: CleaningPlan, policy: Policy | None = None) -> CleaningResult:
    """Dedup → parse numbers and bounds → tokens to NULL → column actions → patterns by name → dedup → fill what is left."""
    policy = policy or Policy()
    result = CleaningResult(df, policy)
    allowed = {c: policy.allows(a, c) for c, a in plan.actions.items()}
    dedup = plan.remove_duplicates and policy.allows("remove_duplicates", "all")
    rows = df.count() if dedup else 0
    if dedup:
        df = drop_duplicates_ignoring_ids(df, row_id)
    parse = [c for c, a in plan.actions.items() if a in NUMERIC_ACTIONS and allowed[c] and c in df.columns]
    texts = [c for c in parse if isinstance(field_type(df, c), T.StringType)]
    parsed = parse_numbers(df.select(*texts), texts).agg(*[F.count(c).alias(c) for c in texts]).first() if texts else {}
    df = parse_numbers(df, [c for c in texts if parsed[c]])
    bounded = {c: clip_logical(F.col(c), c).cast(field_type(df, c)) for c in parse if isinstance(field_type(df, c), T.NumericType)}
    df = df.withColumns(bounded) if bounded else df
    df = checkpointed(replace_tokens(df, CLEANER_TOKENS))  # the statistics jobs below read this table, not the source again

    by_action: dict[str, list[str]] = {}
    for c, action in plan.actions.items():
        if c in df.columns and allowed[c]:
            by_action.setdefault(action, []).append(c)
    df = df.drop(*by_action.get("drop", []))
    dates = {c: standardize_date(F.col(c)) for c in by_action.get("standardize_date", []) if isinstance(field_type(df, c), T.StringType)}
    df = df.withColumns(dates) if dates else df
    for c in by_action.get("fuzzy_fix", []):
        if isinstance(field_type(df, c), T.StringType):
            df = merge_typos(df, c)
            result.log.append(f"merged spellings in {c}")
    trimmed = [c for c in by_action.get("remove_outliers", []) if isinstance(field_type(df, c), T.NumericType)]
    if trimmed:
        df = null_outliers(df, trimmed)
        result.log.append(f"nulled outliers in {', '.join(trimmed)}")
    patterns = {}
    for c in string_columns(df, [row_id]):
        low = c.lower()
        if "mail" in low:
            patterns[c] = clean_email(F.col(c))
        elif "phone" in low or "mobile" in low:
            patterns[c] = clean_phone(F.col(c))
    df = df.withColumns(patterns) if patterns else df
    if dedup:
        df = drop_duplicates_ignoring_ids(df, row_id)
    df = _fill_rest(df, row_id, plan, allowed, result)
    if dedup:
        policy.check_deletion(rows - df.count(), rows)
    result.table = df
    return result


def _fill_rest(df: DataFrame, row_id: str, plan: CleaningPlan, allowed: dict[str, bool], result: CleaningResult) -> DataFrame:
    columns = [c for c in df.columns if c != row_id and allowed.get(c, True)]
    df = checkpointed(df)  # statistics of every fill read this once-computed table
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    needed = [c for c in columns if gaps[c]]
    if not plan.model_fill:
        return fill_simple(df, needed, "mean") if needed else df
    for c in needed:
        df = checkpointed(fill_by_model(df, c, row_id))
        result.log.append(f"filled {c}")
    return df


def fast_clean(df: DataFrame, row_id: str) -> DataFrame:
    """Exact duplicates, number texts, fills (interpolation for time series, else median / mode), date features."""
    df = checkpointed(drop_duplicates_first(df, row_id))  # the checks below read this table, not the source again
    ordered = is_time_series(df, row_id)
    df, _ = coerce_hidden_numbers(df, 0.80, strictly_above=True)
    columns = [c for c in df.columns if c != row_id]
    if ordered:
        df = fill_ordered(df, row_id, columns)
    else:
        df = fill_simple(df, columns)
    df = checkpointed(df)  # dates are looked at in two passes and filled in a third
    return expand_date_text(df, row_id)


def deep_clean(df: DataFrame, row_id: str, scaling: bool = False, contamination: float = 0.05) -> DataFrame:
    """fast_clean, then model or neighbour fills, spelling consolidation, anomaly flags and optional robust scaling."""
    df = checkpointed(fast_clean(df, row_id))
    if is_time_series(df, row_id):
        df = fill_ordered(df, row_id, numeric_columns(df, [row_id]))
    else:
        sparse = downgrade_columns(df)
        df = fill_simple(df, sparse) if sparse else df
        df = advanced_impute(df, row_id)
    for c in string_columns(df, [row_id]):
        df = apply_map(df, c, consolidation_map(df, c))
    features = [c for c in numeric_columns(df, [row_id]) if not c.endswith(DERIVED_SUFFIXES)]
    df = anomaly_flags(df, row_id, features, contamination).drop("anomaly_score")
    return robust_scale(df, features) if scaling and features else df


def clean_column_outliers(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """Null the outliers of one column and fill its gaps with a model."""
    return fill_by_model(null_outliers(df, [column]), column, row_id)


def smart_impute_column(df: DataFrame, row_id: str, column: str) -> DataFrame:
    return fill_by_model(df, column, row_id)


def standardize_column_date(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, standardize_date(F.col(column)))
