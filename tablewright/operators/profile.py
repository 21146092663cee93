"""Column profiles, quality scores and rankings.

Statistics of one pass share one aggregation; results are long tables with one row per column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.patterns import EMAIL_LOOSE, PHONE_E164, shape
from tablewright.functions.tokens import AUDIT_TOKENS, is_dirty
from tablewright.operators.frames import TEMPORAL, cell_shares, cell_text, field, is_integer, long_cells, melt, numeric_columns, string_columns
from tablewright.operators.quantiles import exact_quantiles

# Keyword lists and thresholds of the typing rules.
MEANINGFUL_NULL_NAMES = ["exit", "terminate", "resign", "end_date", "leave", "spouse", "children"]
SENSITIVE_NAMES = ["name", "email", "phone", "address", "ssn", "اسم", "بريد", "هاتف", "عنوان"]
NON_HUMAN_NAMES = ["kepler", "kepoi", "product", "file", "dataset", "class", "category", "model", "type", "country", "city", "state",
                   "town", "planet", "star", "galaxy", "hash", "id", "code", "key", "symbol", "system", "object", "app", "application",
                   "device", "host", "domain", "site", "url", "path", "dir", "directory", "table", "column", "field", "row", "index",
                   "status", "group", "team", "role", "permission", "action", "event", "log", "error", "warn", "info", "debug", "trace",
                   "version", "tag", "label", "title", "subject", "topic", "level", "rank", "grade", "score", "value", "format", "ext",
                   "extension"]
TARGET_NAME = r"(?i)target|label|class|y|status|output|sale_price|price|revenue|income|clicked|survived|churn|fraud|default"
IDENTIFIER_NAME = r"(?i)id|name|idx|uuid|guid|row|index|key|serial|code|phone|email"
FEATURE_ID_NAME = r"(?i)(id|uuid|key|code|index|hash)"
KEY_NAME_PARTS = ["id", "key", "code", "num", "serial", "ref", "hash", "pk", "fk"]
DATE_TEXT = r"^\d{4}[-/]\d{2}[-/]\d{2}"


def cell_key(df: DataFrame, column: str) -> Column:
    """Text that is equal for equal cells of a column only; NULL stays NULL."""
    kind, value = field(df, column), F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0).cast(kind)  # negative zero is zero
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)  # clock times repeat when summer time ends
    elif isinstance(kind, T.BinaryType):
        value = F.hex(value)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value)))
    return value.cast("string")


def distinct_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(place, whole, number, text, n): how often each value stands in each column; place is the column's number in the list, and
    the value is in the one column of its kind, in none for NULL.

    One narrow row a cell, summed before the shuffle; nulls, distinct counts, tops and modes of all columns are aggregates of it.
    """
    cells = []
    for k, c in enumerate(columns):
        kind, value = field(df, c), F.col(c)
        whole, number, text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            whole = value.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            number = value.cast("double")
        else:
            text = cell_key(df, c)
        cells.append(F.struct(F.lit(k).alias("place"), whole.alias("whole"), number.alias("number"), text.alias("text")))
    return df.select(F.inline(F.array(*cells))).groupBy("place", "whole", "number", "text").agg(F.count("*").alias("n"))


#: True for cells of distinct_cells that are not NULL.
IS_VALUE = "whole is not null or number is not null or text is not null"


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> dict[str, int]:
    """Driver scalars: distinct non-NULL values of every column. With approx, from one sketch a column that combines before any shuffle."""
    if not columns:
        return {}
    if approx:
        return df.agg(*[F.approx_count_distinct(c).alias(f"d_{k}") for k, c in enumerate(columns)]).toDF(*columns).first().asDict()
    found = distinct_cells(df, columns).groupBy("place").agg(F.count_if(F.expr(IS_VALUE)).alias("d"))
    counts = {r["place"]: r["d"] for r in found.collect()}  # one row a column
    return {c: counts.get(k, 0) for k, c in enumerate(columns)}


def distinct_sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, sketch): mergeable sketches of the distinct values, for tables that grow by parts: see merged_distinct."""
    row = df.agg(*[F.hll_sketch_agg(cell_key(df, c)).alias(f"s_{k}") for k, c in enumerate(columns)])
    return melt(row, [(c, {"sketch": F.col(f"s_{k}")}) for k, c in enumerate(columns)])


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """(column, distinct) of all parts together, from their sketches, with an error of some percent."""
    return sketches.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def column_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> dict[str, dict[str, int]]:
    """Driver scalars {column: {nulls, distinct}, "*": {rows}}."""
    columns = columns or df.columns
    if approx:
        distinct = distinct_counts(df, columns, approx=True)
        row = df.agg(F.count("*").alias("__rows"), *[F.count(c).alias(f"n_{c}") for c in columns]).first()
        counts = {c: {"nulls": row["__rows"] - row[f"n_{c}"], "distinct": distinct[c]} for c in columns}
        return counts | {"*": {"rows": row["__rows"]}}
    found = distinct_cells(df, columns).groupBy("place").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.expr(IS_VALUE), 0).otherwise(F.col("n"))).alias("nulls"), F.count_if(F.expr(IS_VALUE)).alias("d")
    )
    rows = {r["place"]: r for r in found.collect()}  # one row a column
    counts = {c: {"nulls": rows[k]["nulls"] if k in rows else 0, "distinct": rows[k]["d"] if k in rows else 0} for k, c in enumerate(columns)}
    return counts | {"*": {"rows": rows[0]["rows"] if rows else 0}}


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: types, missing count and percent, unique values (NULL counts as one), min and max of numerics."""
    columns = df.columns
    numeric = set(numeric_columns(df))
    distinct = distinct_counts(df, columns, approx)
    stats = df.agg(
        F.count("*").alias("__rows"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in numeric],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in numeric],
    )
    entries = []
    for c in columns:
        kind = field(df, c)
        missing = F.col("__rows") - F.col(f"n_{c}")
        unique = F.lit(distinct[c]).cast("bigint") + (missing > 0).cast("bigint")
        if c in numeric:
            semantic = F.when(unique == 2, "Binary").otherwise("Numeric")
        elif isinstance(kind, TEMPORAL):
            semantic = F.lit("DateTime")
        else:
            semantic = F.when((unique < 20) & (F.col("__rows") > 20), "Categorical").otherwise("Text")
        entries.append((c, {
            "physical_type": F.lit(kind.simpleString()),
            "semantic_type": semantic,
            "missing_count": missing,
            "missing_pct": F.when(F.col("__rows") > 0, F.bround(missing / F.col("__rows") * 100, 2)).otherwise(F.lit(0.0)),
            "unique_values": unique,
            "min_value": F.col(f"lo_{c}") if c in numeric else F.lit(None).cast("double"),
            "max_value": F.col(f"hi_{c}") if c in numeric else F.lit(None).cast("double"),
        }))
    return melt(stats, entries).withColumn("is_target_candidate", F.col("semantic_type").isin("Binary", "Categorical", "Numeric"))


def first_values(df: DataFrame, row_id: str, columns: list[str], k: int) -> DataFrame:
    """(column, rank, value): the first k non-NULL cells per column in row order. Each part is a bounded top-k."""
    parts = None
    for c in columns:
        part = (
            df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(row_id).alias("row_id"), cell_text(df, c).alias("value"))
            .orderBy("row_id").limit(k)
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def logical_types(df: DataFrame, row_id: str) -> dict[str, str]:
    """datetime, numerical or categorical per column, plus low-cardinality integers as categorical."""
    columns = [c for c in df.columns if c != row_id]
    texts = string_columns(df, [row_id])
    dated = {c for c, share in cell_shares(df, texts, lambda v: v.rlike(DATE_TEXT)).items() if share >= 0.8}
    integers = [c for c in columns if is_integer(field(df, c))]
    distinct = column_counts(df, integers) if integers else {}
    kinds = {}
    for c in columns:
        kind = field(df, c)
        if isinstance(kind, TEMPORAL) or c in dated:
            kinds[c] = "datetime"
        elif isinstance(kind, T.NumericType):
            kinds[c] = "categorical" if c in distinct and distinct[c]["distinct"] <= 10 else "numerical"
        else:
            kinds[c] = "categorical"
    return kinds


def typed_profile(df: DataFrame, row_id: str, samples: int = 5) -> DataFrame:
    """One row per column: inferred type, missing count and percent, unique values, first sample values joined by `|`."""
    kinds = logical_types(df, row_id)
    columns = [c for c in df.columns if c != row_id]
    labels = {
        c: "Datetime" if kinds[c] == "datetime" else "Numerical" if kinds[c] == "numerical"
        else "Categorical (Low Cardinality Numeric)" if isinstance(field(df, c), T.NumericType) else "Categorical"
        for c in columns
    }
    distinct = distinct_counts(df, columns)
    stats = df.agg(F.count("*").alias("__rows"), *[F.count(c).alias(f"n_{c}") for c in columns])
    rows = melt(stats, [(c, {
        "inferred_type": F.lit(labels[c]),
        "missing_count": F.col("__rows") - F.col(f"n_{c}"),
        "missing_pct": (F.col("__rows") - F.col(f"n_{c}")) / F.col("__rows") * 100,
        "unique_count": F.lit(distinct[c]).cast("bigint"),
    }) for c in columns])
    picked = first_values(df, row_id, columns, samples).groupBy("column").agg(  # at most `samples` rows per column
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "value"))), lambda s: s["value"]), "|").alias("sample_values")
    )
    return rows.join(picked, "column", "left")


def dataset_signature(df: DataFrame, row_id: str) -> DataFrame:
    """Type name, unique values, null percent (1 dp) and five sample values per column."""
    base = typed_profile(df, row_id)
    types = melt(df.limit(0).groupBy().agg(F.count("*")), [(f.name, {"dtype": F.lit(f.dataType.simpleString())}) for f in df.schema])
    return base.join(types, "column").select(
        "column", "dtype", "unique_count", F.bround("missing_pct", 1).alias("null_pct"), "sample_values"
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count, ratio) over non-NULL cells, all columns in one shuffle."""
    cells = long_cells(df, columns, []).where(F.col("value").isNotNull())
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("count"))
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(  # one row per column
        "column", "value", "count", (F.col("count") / F.col("total")).alias("ratio")
    )


def describe_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    columns = columns or numeric_columns(df)
    cuts = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    stats = df.agg(*[
        F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                 F.max(c).cast("double").alias("max")).alias(f"s_{c}") for c in columns
    ])
    return melt(stats, [(c, {
        **{k: F.col(f"s_{c}.{k}") for k in ("count", "mean", "std", "min")},
        "p25": F.lit(cuts[c][0.25]).cast("double"), "p50": F.lit(cuts[c][0.5]).cast("double"), "p75": F.lit(cuts[c][0.75]).cast("double"),
        "max": F.col(f"s_{c}.max"),
    }) for c in columns])


def schema_summary(df: DataFrame, row_id: str) -> DataFrame:
    """Type, null count and percent per column, with the row count and the number of duplicate rows of the table."""
    columns = [c for c in df.columns if c != row_id]
    groups = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    stats = groups.agg(
        F.sum("__n").alias("__rows"),
        (F.sum("__n") - F.count("*")).alias("__dups"),
        *[F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("__n"))), F.lit(0)).alias(f"n_{c}") for c in columns],
    )
    return melt(stats, [(c, {
        "dtype": F.lit(field(df, c).simpleString()),
        "null_count": F.col(f"n_{c}"),
        "null_pct": F.bround(F.col(f"n_{c}") / F.col("__rows") * 100, 1),
        "total_rows": F.col("__rows"),
        "duplicate_rows": F.col("__dups"),
    }) for c in columns])


def supervised_profile(df: DataFrame, target: str) -> DataFrame:
    """(section, item, value): scale, feature mix, target anatomy, class balance, missing rates, population skew of 20 numerics."""
    features = [c for c in df.columns if c != target]
    numeric = [c for c in features if isinstance(field(df, c), T.NumericType)]
    counts = column_counts(df)
    rows = counts["*"]["rows"]
    classes = counts[target]["distinct"]
    regression = isinstance(field(df, target), T.NumericType) and classes > 20
    categorical = len(features) - len(numeric)
    facts = [
        ("scale", "n_rows", rows), ("scale", "n_cols", len(df.columns)), ("scale", "n_feature_cols", len(features)),
        ("features", "n_numerical", len(numeric)), ("features", "n_categorical", categorical),
        ("features", "n_binary", sum(counts[c]["distinct"] == 2 for c in features)),
        ("features", "cat_to_num_ratio", round(categorical / max(len(numeric), 1), 4)),
        ("target", "n_unique_values", classes),
        ("target", "Regression" if regression else "Binary Classification" if classes == 2 else "Multi-class Classification", 1),
        ("health", "overall_missing_pct", round(sum(counts[c]["nulls"] for c in df.columns) / (rows * len(df.columns)) * 100, 4)),
        *[("missing_rate", c, round(counts[c]["nulls"] / rows, 4)) for c in df.columns],
    ]
    base = df.sparkSession.createDataFrame([(s, i, float(v)) for s, i, v in facts], "section string, item string, value double")
    if numeric:
        skew = melt(df.agg(*[F.skewness(c).alias(c) for c in numeric]), [(c, {"value": F.col(c)}) for c in numeric])
        base = base.unionByName(skew.select(F.lit("skewness").alias("section"), F.col("column").alias("item"), F.round("value", 4).alias("value")))
    if not regression:
        balance = value_counts(df, [target])
        base = base.unionByName(balance.select(
            F.lit("class_balance").alias("section"), F.col("value").alias("item"), F.round("ratio", 4).alias("value")))
    return base


def sensitive_types(df: DataFrame, row_id: str) -> DataFrame:
    """(column, kind): numerical, categorical or sensitive_*; a name column with digits in over 5 % of its cells is categorical."""
    rules: dict[str, str] = {}
    undecided: list[str] = []
    for f in df.schema:
        if f.name == row_id:
            continue
        low = f.name.lower()
        if isinstance(f.dataType, T.NumericType):
            rules[f.name] = "numerical"
        elif not any(k in low for k in SENSITIVE_NAMES):
            rules[f.name] = "categorical"
        elif "email" in low or "بريد" in low:
            rules[f.name] = "sensitive_email"
        elif "phone" in low or "هاتف" in low:
            rules[f.name] = "sensitive_phone"
        elif "address" in low or "عنوان" in low:
            rules[f.name] = "sensitive_address"
        elif "ssn" in low:
            rules[f.name] = "sensitive_id"
        elif any(k in low for k in NON_HUMAN_NAMES):
            rules[f.name] = "categorical"
        else:
            undecided.append(f.name)
    spark = df.sparkSession
    table = spark.createDataFrame(list(rules.items()), "column string, kind string")
    if undecided:
        digits = cell_shares(df, undecided, lambda v: v.cast("string").rlike(r"\d"))
        table = table.unionByName(spark.createDataFrame([(c, "categorical" if digits[c] > 0.05 else "sensitive_name") for c in undecided], "column string, kind string"))
    return table


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, chunk: int = 200) -> DataFrame:
    """(x, y, r) for every ordered pair; pairwise complete, undefined values become 0."""
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    result = None
    for start in range(0, len(pairs), chunk):  # bounded expression count per aggregation
        part = pairs[start:start + chunk]
        row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(part)])
        cells = []
        for i, (a, b) in enumerate(part):
            r = F.when(F.isnan(F.col(f"r{i}")), F.lit(0.0)).otherwise(F.coalesce(F.col(f"r{i}"), F.lit(0.0)))
            cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("r")))
            if a != b:
                cells.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), r.alias("r")))
        frame = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        result = frame if result is None else result.unionByName(frame)
    return result


def group_moments(df: DataFrame, key: str, target: str) -> DataFrame:
    """Sample variance and mean of a numeric per key; partial aggregation keeps a heavy key cheap."""
    return df.groupBy(key).agg(F.var_samp(target).alias("variance"), F.avg(target).alias("mean"), F.count(target).alias("n"))


def missingness_class(df: DataFrame, column: str) -> DataFrame:
    """Why cells of a column are missing: None, MNAR by name, sparse, MAR by correlation of the null flag, else MCAR."""
    others = numeric_columns(df, [column])
    flag = F.col(column).isNull().cast("double")
    correlations = [F.abs(F.corr(flag, F.col(c).cast("double"))) for c in others]
    # greatest() ignores NULL but ranks NaN highest, so NaN is turned to 0 first
    cleaned = [F.when(F.isnan(r), F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0))) for r in correlations] + [F.lit(0.0), F.lit(0.0)]
    stats = df.agg(
        (F.count("*") - F.count(column)).alias("missing"), F.count("*").alias("rows"), F.greatest(*cleaned).alias("max_corr")
    )
    pct = F.col("missing") / F.col("rows") * 100
    by_name = any(k in column.lower() for k in MEANINGFUL_NULL_NAMES)
    kind = (
        F.when(F.col("missing") == 0, "None")
        .when(F.lit(by_name), "MNAR (Meaningful NULLs)")
        .when(pct > 60, "MNAR / Sparse")
        .when(F.col("max_corr") > 0.15, "MAR (Missing At Random)")
        .otherwise("MCAR (Missing Completely At Random)")
    )
    return stats.select(
        F.lit(column).alias("column"), kind.alias("kind"), pct.alias("missing_pct"), "max_corr", (~kind.startswith("MNAR")).alias("should_impute")
    )


def three_sigma(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """Driver scalars (count, mean, std) per numeric column; NaN cells count as missing."""
    if not columns:
        return {}
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    row = df.agg(*[F.struct(F.count(value[c]), F.avg(value[c]), F.stddev_samp(value[c])).alias(c) for c in columns]).first()
    return {c: tuple(row[c]) for c in columns}


def outlier_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of cells beyond three standard deviations per numeric column; 0 under four values or at zero spread."""
    columns = columns or numeric_columns(df)
    moments = three_sigma(df, columns)
    counted = df.agg(*[_beyond(c, moments[c]).alias(c) for c in columns])
    return melt(counted, [(c, {
        "n": F.lit(moments[c][0]),
        "outliers": F.col(c),
        "ratio": F.bround(F.col(c) / float(max(moments[c][0], 1)), 4),
    }) for c in columns])


def _beyond(column: str, moments: tuple) -> Column:
    n, mean, std = moments
    if n < 4 or not std:
        return F.sum(F.lit(0).cast("bigint"))
    return F.count_if(F.abs(F.col(column).cast("double") - mean) > 3 * std)


def quality_score(df: DataFrame, tokens: list[str] = AUDIT_TOKENS) -> DataFrame:
    """One row: completeness, outlier safety, consistency and the 50/30/20 weighted overall score, as ratios and as 0–100."""
    columns = df.columns
    numeric = numeric_columns(df)
    moments = three_sigma(df, numeric)
    stats = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_dirty(F.col(c), field(df, c), tokens)).alias(f"dirty_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[_beyond(c, moments[c]).alias(f"out_{c}") for c in numeric],
        *[(F.min(c) == F.max(c)).alias(f"const_{c}") for c in numeric],
    )
    ratios = [F.bround(F.col(f"out_{c}") / float(max(moments[c][0], 1)), 4) for c in numeric]
    consistency = []
    for c in columns:
        if c in numeric:
            spread = (moments[c][2] or 0.0) > 0
            consistency.append(F.lit(1.0) if spread else F.when(F.coalesce(F.col(f"const_{c}"), F.lit(True)), 1.0).otherwise(0.7))
        elif isinstance(field(df, c), T.StringType):
            nulls = F.col("rows") - F.col(f"n_{c}")
            consistency.append(F.when(F.col(f"n_{c}") == 0, 1.0).otherwise(1.0 - (F.col(f"dirty_{c}") - nulls) / F.col(f"n_{c}")))
        else:
            consistency.append(F.lit(1.0))
    completeness = F.lit(1.0) - _total([F.col(f"dirty_{c}") for c in columns]) / (F.col("rows") * len(columns))
    safety = F.lit(1.0) - (_total(ratios) / float(len(numeric)) if numeric else F.lit(0.0))
    result = stats.select(
        completeness.alias("completeness"), safety.alias("outlier_safety"), (_total(consistency) / float(len(columns))).alias("consistency")
    ).withColumn("overall", 0.5 * F.col("completeness") + 0.3 * F.col("outlier_safety") + 0.2 * F.col("consistency"))
    return result.withColumns({
        f"{c}_score": F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col(c) * 100, 0).cast("int")))
        for c in ("completeness", "outlier_safety", "consistency", "overall")
    })


def _total(parts: list[Column]) -> Column:
    result = F.lit(0)
    for part in parts:
        result = result + part
    return result


def health_score(df: DataFrame, row_id: str) -> DataFrame:
    """One row: dirty cells, duplicate penalty (at most 20), score and band."""
    columns = [c for c in df.columns if c != row_id]
    groups = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    dirty = _total([is_dirty(F.col(c), field(df, c)).cast("int") for c in columns])
    stats = groups.agg(
        F.sum("__n").alias("total_rows"), (F.sum("__n") - F.count("*")).alias("duplicate_rows"), F.sum(dirty * F.col("__n")).alias("dirty_cells")
    )
    penalty = F.bround(F.col("duplicate_rows") / F.col("total_rows") * 20, 0)
    base = F.bround(F.lit(100) - F.col("dirty_cells") / (F.col("total_rows") * len(columns)) * 100, 0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - penalty)).cast("int")
    return stats.withColumn("score", score).withColumn(
        "band", F.when(F.col("score") >= 80, "Healthy").when(F.col("score") >= 50, "Needs Attention").otherwise("Critically Dirty")
    )


def missing_by_column(df: DataFrame, row_id: str | None = None, top: int = 10) -> DataFrame:
    """Dirty cells per column, worst first, columns without any left out."""
    columns = [c for c in df.columns if c != row_id]
    stats = df.agg(F.count("*").alias("rows"), *[F.count_if(is_dirty(F.col(c), field(df, c))).alias(f"d_{c}") for c in columns])
    rows = melt(stats, [(c, {"missing_count": F.col(f"d_{c}"), "missing_pct": F.bround(F.col(f"d_{c}") / F.col("rows") * 100, 1)}) for c in columns])
    return rows.where("missing_count > 0").orderBy(F.desc("missing_pct"), F.desc("missing_count"), "column").limit(top)


def type_distribution(df: DataFrame) -> DataFrame:
    """Number of columns per semantic type (Numeric, DateTime, Categorical, Text)."""
    kinds = F.when(F.col("semantic_type") == "Binary", "Numeric").otherwise(F.col("semantic_type"))
    return column_profile(df).groupBy(kinds.alias("semantic_type")).agg(F.count("*").alias("columns"))


def constraint_compliance(df: DataFrame) -> DataFrame:
    """Rule, compliance rate and PASS / WARNING / FAIL per column."""
    numeric = numeric_columns(df)
    moments = three_sigma(df, numeric)
    aggregates = [F.count("*").alias("rows")]
    entries = []
    for c in df.columns:
        aggregates.append(F.count(c).alias(f"n_{c}"))
        filled = F.col(f"n_{c}")
        rule, rate = "Not Null", F.bround(filled / F.col("rows") * 100, 2)
        low = c.lower()
        if c in numeric:
            n, _, std = moments[c]
            if n > 3 and std:
                aggregates.append(_beyond(c, moments[c]).alias(f"x_{c}"))
                rule, rate = "Outlier Range [±3σ]", F.bround((F.lit(n) - F.col(f"x_{c}")) / float(n) * 100, 2)
        elif "mail" in low or "phone" in low or "mobile" in low:
            text = F.col(c).cast("string")
            if "mail" in low:
                rule, good = "Email Format Match", F.trim(text).rlike(EMAIL_LOOSE)
            else:
                rule, good = "Phone Format E.164", F.regexp_replace(text, r"[\s()-]", "").rlike(PHONE_E164)
            aggregates.append(F.count_if(good).alias(f"x_{c}"))
            rate = F.when(filled > 0, F.bround(F.col(f"x_{c}") / filled * 100, 2)).otherwise(F.lit(100.0))
        entries.append((c, {"rule": F.lit(rule), "compliance_rate": rate}))
    rows = melt(df.agg(*aggregates), entries)
    return rows.withColumn(
        "status", F.when(F.col("compliance_rate") >= 95, "PASS").when(F.col("compliance_rate") >= 80, "WARNING").otherwise("FAIL")
    )


def rank_targets(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Suitability of every column as a prediction target, best first."""
    probe = df if row_id else df.withColumn("__row", F.monotonically_increasing_id())
    kinds = logical_types(probe, row_id or "__row")
    columns = [c for c in df.columns if c != row_id]
    counts = column_counts(df, columns)
    spark = df.sparkSession
    facts = spark.createDataFrame(
        [(c, i, kinds[c], counts[c]["distinct"], counts[c]["nulls"], counts["*"]["rows"]) for i, c in enumerate(columns)],
        "column string, place int, kind string, distinct bigint, nulls bigint, rows bigint",
    )
    id_named = F.col("column").rlike(IDENTIFIER_NAME)
    unique = F.col("distinct")
    parts = [
        F.when(unique == F.col("rows"), -10.0).when(id_named & (unique > F.col("rows") * 0.5), -5.0),
        F.when(unique <= 1, -20.0),
        F.when(F.col("nulls") == F.col("rows"), -20.0),
        F.when(F.col("column").rlike(TARGET_NAME), 8.0),
        F.when(F.col("place") == len(columns) - 1, 4.0).when(F.col("place") == 0, -2.0),
        F.when((F.col("kind") == "categorical") & (unique == 2), 5.0)
        .when((F.col("kind") == "categorical") & unique.between(3, 10), 4.0)
        .when((F.col("kind") == "categorical") & (unique > 50) & ~id_named, -3.0)
        .when((F.col("kind") == "numerical") & ~id_named & (unique > 10), 3.0),
        F.when(F.col("nulls") > 0, -(F.col("nulls") / F.col("rows") * 10.0)),
    ]
    score = _total([F.coalesce(p, F.lit(0.0)) for p in parts])
    kind = F.when(unique == 2, "binary").when((F.col("kind") == "categorical") | (unique <= 10), "categorical").otherwise("continuous")
    return facts.select("column", F.bround(score, 2).alias("score"), kind.alias("inferred_type"), "place").orderBy(F.desc("score"), "place")


def infer_task(df: DataFrame, target: str, kinds: dict[str, str]) -> str:
    """binary, multiclass or regression."""
    distinct = df.agg(F.count_distinct(target)).first()[0]
    if distinct == 2:
        return "binary"
    if kinds.get(target) == "categorical" or not isinstance(field(df, target), T.NumericType) or distinct <= 10:
        return "multiclass"
    return "regression"


def feature_screen(df: DataFrame, target: str, kinds: dict[str, str]) -> DataFrame:
    """(column, n_unique, top_share, verdict): constant, near-constant and id-like columns are dropped; the rest split at 15 values."""
    features = [c for c in df.columns if c != target and kinds.get(c) in ("numerical", "categorical")]
    counts = value_counts(df, features).groupBy("column").agg(F.count("*").alias("n_unique"), F.max("ratio").alias("top_share"))
    kind_rows = df.sparkSession.createDataFrame(
        [(c, kinds[c], bool(re.search(FEATURE_ID_NAME, c))) for c in features], "column string, kind string, id_named boolean")
    total = df.count()
    share = F.col("n_unique") / float(max(total, 1))
    verdict = (
        F.when(F.col("n_unique") <= 1, "constant")
        .when(F.col("top_share") > 0.995, "near_constant")
        .when((share > 0.90) & ((F.col("kind") == "categorical") | F.col("id_named")), "id_like")
        .when(F.col("id_named") & (share > 0.50), "id_like")
        .when(F.col("kind") == "numerical", "numeric")
        .when(F.col("n_unique") <= 15, "low_cardinality")
        .otherwise("high_cardinality")
    )
    rows = kind_rows.join(counts, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    return rows.select("column", "n_unique", "top_share", verdict.alias("verdict"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count, null counts and an order-free content hash, with a SHA-256 over all of them.

    The sum of row hashes does not depend on row order or partitioning, so it identifies content.
    """
    columns = sorted(df.columns)
    schema = "|".join(f"{c}:{field(df, c).simpleString()}" for c in columns)
    content = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    stats = df.agg(F.count("*").alias("rows"), content.alias("content"), *[F.count(c).alias(f"n_{c}") for c in columns])
    nulls = F.concat_ws("|", *[F.concat(F.lit(f"{c}:"), F.col("rows") - F.col(f"n_{c}")) for c in columns])
    summary = F.concat_ws("#", F.lit(schema), nulls, F.col("rows").cast("string"), F.coalesce(F.col("content").cast("string"), F.lit("")))
    return stats.select("rows", nulls.alias("null_profile"), F.sha2(summary, 256).alias("fingerprint"))


def is_mutated(before: DataFrame, after: DataFrame) -> bool:
    """True when two tables differ in schema or content."""
    return fingerprint(before).first()["fingerprint"] != fingerprint(after).first()["fingerprint"]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class, imbalance ratio, and whether balancing is active (ratio over 1.5)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    row = counts.agg(F.sum("n"), F.count("*"), F.max("n"), F.min("n")).first()
    total, classes, most, least = row
    ratio = most / least if least else 1.0
    return counts.select(
        label, "n", (F.lit(float(total or 0)) / (F.lit(classes) * F.col("n"))).alias("weight"),
        F.lit(float(ratio)).alias("imbalance_ratio"), F.lit(ratio > 1.5).alias("active"),
    )


def feature_ranges(df: DataFrame, numeric: list[str], categorical: list[str], limit: int | None = 50) -> DataFrame:
    """min / max / median of numerics and the first `limit` options of categoricals (all without a limit), as input-form hints.

    more_options says how many options a limit has left out.
    """
    cuts = exact_quantiles(df, {c: [0.5] for c in numeric})
    ranges = melt(df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in numeric]), [(c, {
        "kind": F.lit("numerical"),
        "min": F.coalesce(F.col(f"{c}.lo").cast("double"), F.lit(0.0)),
        "max": F.coalesce(F.col(f"{c}.hi").cast("double"), F.lit(100.0)),
        "median": F.lit(cuts[c][0.5] if cuts[c][0.5] is not None else 0.0),
        "options": F.lit(None).cast("string"),
        "more_options": F.lit(0).cast("bigint"),
    }) for c in numeric])
    distinct = distinct_counts(df, categorical)
    for c in categorical:
        values = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().orderBy("v")
        values = values if limit is None else values.limit(limit)
        options = values.agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("options"))  # the options a form shows
        left_out = 0 if limit is None else max(0, distinct[c] - limit)
        ranges = ranges.unionByName(options.select(
            F.lit(c).alias("column"), F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("min"),
            F.lit(None).cast("double").alias("max"), F.lit(None).cast("double").alias("median"), "options", F.lit(left_out).cast("bigint").alias("more_options")))
    return ranges


def training_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, numeric and other columns, overall missing percent, minority-class percent, wide categoricals."""
    numeric = numeric_columns(df)
    others = [c for c in df.columns if c not in numeric]
    wide = [c for c in others if c != target]
    distinct = distinct_counts(df, wide)
    stats = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in df.columns])
    counts = df.where(F.col(target).isNotNull()).groupBy(target).count().agg(F.min("count").alias("least"), F.sum("count").alias("all"))
    least, total = counts.first()
    cells = F.col("n_rows") * len(df.columns)
    filled = _total([F.col(f"n_{c}") for c in df.columns])
    return stats.select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(len(numeric)).alias("n_numeric"), F.lit(len(others)).alias("n_text"),
        F.bround((cells - filled) / cells * 100, 2).alias("missing_pct"),
        F.bround(F.lit((least or 0) / total * 100 if total else 0.0), 2).alias("minority_pct"),
        F.lit(sum(distinct[c] > 50 for c in wide)).alias("wide_columns"),
    )


def pattern_template(df: DataFrame, column: str) -> DataFrame:
    """One row: common prefix + most frequent shape of the middle + common suffix, over all values.

    The smallest and largest value bound the common prefix of all values; reversing gives the suffix.
    """
    value = F.col(column).cast("string")
    ends = df.where(value.isNotNull()).agg(
        F.min(value), F.max(value), F.min(F.reverse(value)), F.max(F.reverse(value)), F.min(F.length(value))
    ).first()
    spark = df.sparkSession
    if ends[0] is None:
        return spark.createDataFrame([("",)], "template string")
    prefix, suffix = _common(ends[0], ends[1]), _common(ends[2], ends[3])[::-1]
    if len(prefix) + len(suffix) >= ends[4]:
        suffix = ""
    middle = F.substring(value, F.lit(len(prefix) + 1), F.length(value) - len(prefix) - len(suffix))
    counted = df.where(value.isNotNull()).groupBy(shape(middle).alias("shape")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "shape").limit(1).select(F.concat(F.lit(prefix), F.col("shape"), F.lit(suffix)).alias("template"))


def _common(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def id_sequence(df: DataFrame, column: str) -> DataFrame:
    """One row: whether all values are unique and share one `prefix + digits` form, with prefix and start number."""
    value = F.col(column).cast("string")
    head, tail = F.regexp_extract(value, r"^([^0-9]*)(\d+)$", 1), F.regexp_extract(value, r"^([^0-9]*)(\d+)$", 2)
    stats = df.agg(
        F.count("*").alias("rows"), F.count_distinct(column).alias("distinct"), F.min(head).alias("prefix"), F.max(head).alias("__last"),
        F.min(F.length(tail)).alias("__digits"), F.min(tail.try_cast("bigint")).alias("start"),
    )
    ok = (F.col("rows") == F.col("distinct")) & (F.col("prefix") == F.col("__last")) & (F.col("__digits") > 0)
    return stats.select(
        F.lit(column).alias("column"), F.coalesce(ok, F.lit(False)).alias("is_sequence"), F.when(ok, F.col("prefix")).alias("prefix"),
        F.when(ok, F.col("start")).alias("start"),
    )


def key_like(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, is_key): by name part, or alphanumeric mix with over 70 % unique values."""
    text = {c: F.col(c).cast("string") for c in columns}
    distinct = distinct_counts(df, columns)
    stats = df.agg(*[
        F.struct(
            F.count(c).alias("n"), F.bool_and(text[c].rlike(r"^[A-Za-z0-9_-]+$")).alias("plain"),
            F.bool_or(text[c].rlike("[A-Za-z]")).alias("letters"), F.bool_or(text[c].rlike(r"\d")).alias("digits"),
        ).alias(f"s_{c}") for c in columns
    ])
    entries = []
    for c in columns:
        s = f"s_{c}"
        mixed = F.col(f"{s}.plain") & F.col(f"{s}.letters") & F.col(f"{s}.digits") & (F.lit(distinct[c]) / F.col(f"{s}.n") > 0.7)
        named = any(k in c.lower() for k in KEY_NAME_PARTS)
        entries.append((c, {"is_key": F.lit(True) if named else F.coalesce(mixed, F.lit(False))}))
    return melt(stats, entries)
