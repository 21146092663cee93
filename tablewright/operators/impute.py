"""Missing-value fills: statistics, group rules, ordered fills, models, neighbours, chained equations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.dates import standardize_date
from tablewright.functions.hashing import RANGE, draw, unit
from tablewright.operators.frames import TEMPORAL, cell_shares, field, is_integer, numeric_columns, string_columns
from tablewright.operators.neighbours import BLOCK_ROWS, CELL_ROWS, fill_search
from tablewright.operators.ordered import BUCKET, global_position, nearest_known, with_buckets
from tablewright.operators.profile import column_counts, distinct_counts
from tablewright.operators.quantiles import exact_quantiles, modes, most_frequent
from tablewright.session import checkpointed, partitions_hint

#: Numbers of all patterns' matrices together that the driver holds, 16 MB a round; tables of more patterns are filled in passes.
PATTERN_NUMBERS = 2_000_000
#: Text predictors of more values than this enter models by target statistics, not by codes: split finding keeps a bin a code.
CODED_CATEGORIES = 50

# Limits of the imputing rules, and names never used as predictors.
EXCLUDED_PREDICTORS = ["ID", "Name", "Email", "Phone", "Join_Date", "Date", "identifier"]
DATE_NAME_PARTS = ["date", "timestamp", "time", "datetime"]
GROUP_VARIANCE_LIMIT = 0.1


def _finite(c: str) -> Column:
    """Numeric cell with NaN and infinities as NULL."""
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def whole_majority(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """True where whole values outnumber fractional ones."""
    if not columns:
        return {}
    row = df.agg(*[F.struct(F.count_if(_finite(c) % 1 == 0), F.count_if(_finite(c) % 1 != 0)).alias(c) for c in columns]).first()
    return {c: row[c][0] > row[c][1] for c in columns}


def _rounded(value: float, whole: bool) -> float:
    return float(round(value)) if whole else round(value, 2)


def fill_values(df: DataFrame, columns: list[str], statistic: str = "median") -> dict[str, object]:
    """Fill value per column: rounded median or mean for numbers, mode for the rest, 0 or Unknown when empty."""
    numbers = [c for c in columns if isinstance(field(df, c), T.NumericType)]
    texts = [c for c in columns if isinstance(field(df, c), T.StringType)]
    others = [c for c in columns if c not in numbers and c not in texts]
    centre: dict[str, float | None] = {}
    if numbers and statistic == "median":
        finite = df.select(*[_finite(c).alias(c) for c in numbers])
        centre = {c: q[0.5] for c, q in exact_quantiles(finite, {c: [0.5] for c in numbers}).items()}
    elif numbers:
        centre = df.agg(*[F.avg(_finite(c)).alias(c) for c in numbers]).first().asDict()
    whole = whole_majority(df, numbers)
    fills: dict[str, object] = {c: 0.0 if centre[c] is None else _rounded(centre[c], whole[c]) for c in numbers}
    fills.update({c: v if v is not None else "Unknown" for c, v in modes(df, texts).items()})
    fills.update({c: most_frequent(df, c) for c in others})
    return fills


def fill_simple(df: DataFrame, columns: list[str] | None = None, statistic: str = "median", skip: list[str] = ()) -> DataFrame:
    """Fill NULL (and for numbers NaN / infinite) cells of the columns that have any."""
    columns = [c for c in (columns or df.columns) if c not in skip]
    gaps = df.agg(*[
        F.count_if(_finite(c).isNull() if isinstance(field(df, c), T.NumericType) else F.col(c).isNull()).alias(c) for c in columns
    ]).first()
    needed = [c for c in columns if gaps[c]]
    fills = fill_values(df, needed, statistic)
    changed = {}
    for c in needed:
        kind = field(df, c)
        current = _finite(c) if isinstance(kind, T.NumericType) else F.col(c)
        changed[c] = F.coalesce(current, F.lit(fills[c])).cast(kind)
    return df.withColumns(changed) if changed else df


def fill_by_group(df: DataFrame, target: str, keys: list[str] | None = None, skip: list[str] = ()) -> DataFrame:
    """Fill a numeric from group means of each string key whose groups are nearly constant in it, until no gap is left.

    Group means are aggregated before they meet the rows again, so no group is gathered whole.
    """
    keys = [k for k in (keys or string_columns(df, skip)) if k != target]
    if not keys or not isinstance(field(df, target), T.NumericType):
        return df
    counts = column_counts(df, [*keys, target])
    rows, gaps = counts["*"]["rows"], counts[target]["nulls"]
    for key in keys:
        if gaps == 0:
            break
        if counts[key]["distinct"] >= rows * 0.8:
            continue
        groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.var_samp(target).alias("v"), F.avg(target).alias("__mean"))
        mean_variance = groups.agg(F.avg("v")).first()[0]
        if mean_variance is None or mean_variance < GROUP_VARIANCE_LIMIT:
            df = df.join(groups.select(key, "__mean"), key, "left").withColumn(
                target, F.coalesce(F.col(target).cast("double"), "__mean")).select(*df.columns)
            gaps = df.where(F.col(target).isNull()).count()
    return df


def choose_method(df: DataFrame, skip: list[str] = ()) -> str:
    """simple, iterative or knn, from the missing share and the strongest correlation; the size of the table plays no part."""
    columns = [c for c in df.columns if c not in skip]
    numeric = numeric_columns(df, skip)
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    row = df.agg(
        F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.abs(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
    ).first()
    rows = row["rows"]
    if rows == 0 or len(columns) < 2:
        return "simple"
    missing = sum(rows - row[f"n_{c}"] for c in columns) / (rows * len(columns))
    if missing < 0.01:
        return "simple"
    known = [row[f"r{i}"] for i in range(len(pairs)) if row[f"r{i}"] is not None and row[f"r{i}"] == row[f"r{i}"]]
    return "iterative" if known and max(known) > 0.4 else "knn"


def method_facts(df: DataFrame, skip: list[str] = ()) -> DataFrame:
    return df.sparkSession.createDataFrame([(choose_method(df, skip),)], "method string")


def fill_ordered(df: DataFrame, order_col: str, columns: list[str], interpolate: bool = True) -> DataFrame:
    """Numbers by linear interpolation over row position, then forward / backward; other types forward then backward.

    Interpolation is by position in the order, not by the value of the order column.
    """
    placed = global_position(df, order_col, "__pos")
    known = nearest_known(placed, order_col, columns, "__pos")
    filled = {}
    for c in columns:
        before, after = F.col(f"{c}__prev"), F.col(f"{c}__next")
        if interpolate and isinstance(field(df, c), T.NumericType):
            span = after["pos"] - before["pos"]
            line = before["val"] + (after["val"] - before["val"]) * (F.col("__pos") - before["pos"]) / F.nullif(span, F.lit(0))
            filled[c] = F.coalesce(F.col(c).cast("double"), line, before["val"], after["val"])
        else:
            filled[c] = F.coalesce(c, before["val"], after["val"])
    return known.withColumns(filled).select(*df.columns)


def is_monotone(df: DataFrame, order_col: str, column: str) -> tuple[bool, bool]:
    """(non-decreasing, non-increasing) over the row order, NULLs skipped: per-bucket checks plus bucket borders."""
    rows = with_buckets(df.where(F.col(column).isNotNull()).select(order_col, column), order_col)
    step = rows.withColumn("__before", F.lag(column).over(Window.partitionBy(BUCKET).orderBy(order_col)))
    parts = step.groupBy(BUCKET).agg(
        F.bool_and(F.coalesce(F.col(column) >= F.col("__before"), F.lit(True))).alias("up"),
        F.bool_and(F.coalesce(F.col(column) <= F.col("__before"), F.lit(True))).alias("down"),
        F.min_by(column, order_col).alias("first"), F.max_by(column, order_col).alias("last"),
    ).orderBy(BUCKET).collect()  # one row per bucket
    up = all(p["up"] for p in parts) and all(a["last"] <= b["first"] for a, b in zip(parts, parts[1:]))
    down = all(p["down"] for p in parts) and all(a["last"] >= b["first"] for a, b in zip(parts, parts[1:]))
    return up and bool(parts), down and bool(parts)


def is_time_series(df: DataFrame, row_id: str) -> bool:
    """A monotone timestamp column, or a date-named text column of which over 70 % parse and run one way."""
    for f in df.schema:
        if isinstance(f.dataType, TEMPORAL) and f.name != row_id and any(is_monotone(df, row_id, f.name)):
            return True
    for f in df.schema:
        if isinstance(f.dataType, T.StringType) and any(k in f.name.lower() for k in DATE_NAME_PARTS):
            if cell_shares(df, [f.name], lambda v: standardize_date(v).isNotNull())[f.name] > 0.7:
                parsed = df.select(row_id, standardize_date(F.col(f.name)).alias(f.name)).where(F.col(f.name).isNotNull())
                if any(is_monotone(parsed, row_id, f.name)):
                    return True
    return False


def expand_date_text(df: DataFrame, row_id: str, threshold: float = 0.7) -> DataFrame:
    """Text columns whose filled cells mostly parse as dates become timestamps with year, month, day and weekend columns."""
    from tablewright.functions.dates import date_parts

    texts = string_columns(df, [row_id])
    if not texts:
        return df
    dates = cell_shares(df, texts, lambda v: standardize_date(v).isNotNull())
    shaped = cell_shares(df, texts, lambda v: v.rlike(r"[-/: ]|.{7}"))
    for c in [c for c in texts if dates[c] > threshold and shaped[c] > 0.5]:
        parsed = fill_ordered(df.withColumn(c, standardize_date(F.col(c))), row_id, [c])
        df = parsed.select("*", *date_parts(F.col(c), c))
    return df


def _model_features(df: DataFrame, target: str, skip: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Numeric predictors, text predictors with few values, and those with many."""
    usable = [c for c in df.columns if c != target and c not in skip and c not in EXCLUDED_PREDICTORS]
    numbers = [c for c in usable if isinstance(field(df, c), T.NumericType)]
    texts = [c for c in usable if isinstance(field(df, c), T.StringType)]
    distinct = distinct_counts(df, texts)
    return numbers, [c for c in texts if distinct[c] <= CODED_CATEGORIES], [c for c in texts if distinct[c] > CODED_CATEGORIES]


def target_statistics(df: DataFrame, texts: list[str], value: Column, known: Column, row_id: str, seed: int = 42, weight: float = 1.0) -> DataFrame:
    """Add `__t_<column>` for text columns of any number of values: the mean of `value` over the rows with the same text.

    Ordered statistics: a row whose value is known sees only the known rows of its text that come before it in a keyed random order,
    so a model trained on them does not read its own target; other rows see all known rows of their text. The overall mean
    counts as `weight` more rows. NULL is a text of its own. A text that most rows hold is dealt to ranges of the order.
    """
    if not texts:
        return df
    rows = checkpointed(df.withColumns({"__value": F.when(known, value.cast("double")), "__at": draw(F.col(row_id), seed)}))
    mean = rows.agg(F.avg("__value")).first()[0] or 0.0
    parts = partitions_hint(df.sparkSession)
    # keyed draws are even, so equal ranges of them hold equal shares of the rows of any text
    ranged = rows.withColumn("__range", F.least(F.floor(F.col("__at") / F.lit(RANGE / parts)), F.lit(parts - 1)).cast("int"))
    out = ranged
    for c in texts:
        sums = ranged.groupBy(c, "__range").agg(F.sum("__value").alias("__s"), F.count("__value").alias("__n"))
        across = Window.partitionBy(c).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(c)
        carried = sums.select(
            F.col(c).alias("__key"), F.col("__range").alias("__of"),
            F.coalesce(F.sum("__s").over(across), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__n0"),
            F.sum("__s").over(whole).alias("__s1"), F.sum("__n").over(whole).alias("__n1"))
        inside = Window.partitionBy(c, "__range").orderBy("__at", row_id).rowsBetween(Window.unboundedPreceding, -1)
        local = out.withColumns({"__sl": F.coalesce(F.sum("__value").over(inside), F.lit(0.0)), "__nl": F.count("__value").over(inside)})
        joined = local.join(carried, F.col(c).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__of")))
        own = F.col("__value").isNotNull()
        total = F.when(own, F.col("__s0") + F.col("__sl")).otherwise(F.coalesce("__s1", F.lit(0.0)))
        count = F.when(own, F.col("__n0") + F.col("__nl")).otherwise(F.col("__n1"))
        out = joined.withColumn(f"__t_{c}", (total + weight * mean) / (count + weight)).drop("__key", "__of", "__s0", "__n0", "__s1", "__n1", "__sl", "__nl")
    return checkpointed(out.drop("__value", "__at", "__range"))


def fill_by_model(df: DataFrame, target: str, row_id: str, iterations: int = 20, depth: int = 5, seed: int = 42, train_rows: int | None = None) -> DataFrame:
    """Group rule first, then boosted trees (numbers) or a random forest (text) trained on the known rows.

    Text predictors of many values enter by ordered target statistics (for a text target, of the share of its most frequent
    value's rows). The model is applied to the rows with a gap only. `train_rows` bounds the training rows of the
    classifier (text) by a keyed draw; without it, and for numbers always, all known rows train.
    """
    df = fill_by_group(df, target, skip=[row_id])
    kind = field(df, target)
    numeric = isinstance(kind, T.NumericType)
    missing = _finite(target).isNull() if numeric else F.col(target).isNull()
    known_rows, gap_rows = df.agg(F.count_if(~missing), F.count_if(missing)).first()
    if gap_rows == 0:
        return df
    numbers, texts, wide = _model_features(df, target, [row_id])
    if not numbers and not texts and not wide or known_rows == 0 or isinstance(kind, TEMPORAL):
        return fill_simple(df, [target], "mean")
    columns = df.columns
    if wide:
        top = None if numeric else most_frequent(df, target)
        df = target_statistics(df, wide, _finite(target) if numeric else (F.col(target) == F.lit(top)).cast("double"), ~missing, row_id, seed)

    def clean(frame: DataFrame) -> DataFrame:
        return frame.withColumns({f"__f_{c}": F.coalesce(_finite(c), F.lit(0.0)) for c in numbers})

    train = df.where(~missing)
    if train_rows and not numeric and known_rows > train_rows:
        train = train.where(unit(F.col(row_id), seed) < train_rows / known_rows)
    indexers = [StringIndexer(inputCol=c, outputCol=f"__f_{c}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df.where(F.col(c).isNotNull())) for c in texts]
    assembler = VectorAssembler(inputCols=[*[f"__f_{c}" for c in (*numbers, *texts)], *[f"__t_{c}" for c in wide]], outputCol="__x", handleInvalid="keep")

    def prepare(frame: DataFrame) -> DataFrame:
        frame = clean(frame)
        for model in indexers:
            frame = model.transform(frame)
        return assembler.transform(frame)

    if numeric:
        ready = prepare(train).withColumn("__y", F.col(target).cast("double"))
        model = GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="__p", maxIter=iterations, maxDepth=depth, maxBins=64, seed=seed).fit(ready)
        whole = whole_majority(df, [target])[target]
        value = F.bround("__p", 0 if whole else 2).cast(kind)
        filled = model.transform(prepare(df.where(missing)))
    else:
        labels = StringIndexer(inputCol=target, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
        if len(labels.labels) < 2:
            return fill_simple(df.select(*columns), [target])
        forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", predictionCol="__p", numTrees=40, maxDepth=8, maxBins=64, seed=seed)
        model = forest.fit(labels.transform(prepare(train)))
        filled = IndexToString(inputCol="__p", outputCol="__v", labels=labels.labels).transform(model.transform(prepare(df.where(missing))))
        value = F.col("__v")
    return df.where(~missing).select(*columns).unionByName(filled.withColumn(target, value).select(*columns))


def encode_ordinal(df: DataFrame, texts: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Text to sorted codes (NULL kept) and the code lists."""
    models = {
        c: StringIndexer(inputCol=c, outputCol=f"__code_{c}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df.where(F.col(c).isNotNull()))
        for c in texts
    }
    for c, model in models.items():
        df = model.transform(df).withColumn(c, F.when(F.col(c).isNotNull(), F.col(f"__code_{c}"))).drop(f"__code_{c}")
    return df, {c: list(m.labels) for c, m in models.items()}


def fill_by_neighbours(
    df: DataFrame, row_id: str, k: int = 5, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, met: list[DataFrame] | None = None
) -> DataFrame:
    """Average of the k nearest rows that know the cell; distance over the coordinates both rows know.

    Text columns take part as sorted codes and are decoded and clipped. Exact at any size: incomplete
    rows meet the cells of rows that can hold one of the k donors of a missing cell.
    """
    numbers, texts = numeric_columns(df, [row_id]), string_columns(df, [row_id])
    columns = [*numbers, *texts]
    coded, labels = encode_ordinal(df, texts)
    points = coded.select(row_id, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    schema = f"query {dict(df.dtypes)[row_id]}, column string, distance double, candidate {dict(df.dtypes)[row_id]}, value double"

    def kernel(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "column", "distance", "candidate", "value"]
        if q.empty or d.empty:
            return pd.DataFrame(columns=names)
        d = d.sort_values(row_id)
        rows, donors = q[columns].to_numpy(float), d[columns].to_numpy(float)
        ids, known = d[row_id].to_numpy(), ~np.isnan(donors)
        filled = np.where(known, donors, 0.0)
        parts = []
        for start in range(0, len(rows), 256):
            chunk = rows[start:start + 256]
            seen = ~np.isnan(chunk)
            value = np.where(seen, chunk, 0.0)
            shared = seen.astype(float) @ known.astype(float).T
            squared = (value ** 2) @ known.T.astype(float) + seen.astype(float) @ (filled ** 2).T - 2 * value @ filled.T
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = np.where(shared > 0, np.sqrt(np.maximum(squared, 0) * len(columns) / shared), np.inf)
            queries = q[row_id].to_numpy()[start:start + 256]
            for j, c in enumerate(columns):
                needy = np.flatnonzero(~seen[:, j])
                usable = np.flatnonzero(known[:, j])
                if len(needy) == 0 or len(usable) == 0:
                    continue
                apart = distance[np.ix_(needy, usable)]
                last = min(k, len(usable)) - 1
                # all donors that tie with the last one stay until ids, the order of the columns, decide
                row, near = np.nonzero(apart <= np.partition(apart, last, axis=1)[:, last, None])
                order = np.lexsort((near, apart[row, near], row))
                order = order[np.arange(len(row)) - np.searchsorted(row, row) <= last]
                row, donor = row[order], usable[near[order]]
                parts.append(pd.DataFrame({
                    "query": queries[needy[row]], "column": c, "distance": distance[needy[row], donor], "candidate": ids[donor], "value": donors[donor, j],
                }))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)

    points = checkpointed(points)  # read by every search
    found = fill_search(points.where(gap), points, row_id, row_id, columns, kernel, schema, k, block_rows=block_rows, cell_rows=cell_rows, met=met)
    best = Window.partitionBy("query", "column").orderBy("distance", "candidate")
    means = (
        found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
        .groupBy("query").pivot("column", columns).agg(F.avg("value"))
    )
    joined = coded.join(means.select(F.col("query").alias(row_id), *[F.col(c).alias(f"__m_{c}") for c in columns]), row_id, "left")
    return _restore(joined, df, numbers, labels, {c: F.col(f"__m_{c}") for c in columns})


def _restore(coded: DataFrame, original: DataFrame, numbers: list[str], labels: dict[str, list[str]], estimate: dict[str, Column]) -> DataFrame:
    """Round numbers to their habit, cast back to the original type, decode and clip codes."""
    whole = whole_majority(original, numbers)
    out = {}
    for c in numbers:
        kind = field(original, c)
        value = F.bround(F.coalesce(_finite(c), estimate[c]), 0 if whole[c] or is_integer(kind) else 2)
        out[c] = value.cast(kind)
    for c, names in labels.items():
        if names:
            code = F.greatest(F.lit(0), F.least(F.lit(len(names) - 1), F.bround(F.coalesce(F.col(c).cast("double"), estimate[c]), 0).cast("int")))
            out[c] = F.element_at(F.array(*[F.lit(n) for n in names]), code + 1)
    return coded.withColumns(out).select(*original.columns)


def fill_iterative(df: DataFrame, row_id: str, rounds: int = 10, tolerance: float = 1e-3) -> DataFrame:
    """Chained linear equations: each incomplete column is regressed on all others, round by round, until cells move less than
    `tolerance` of the largest value.

    A filled cell is a linear function of its row's known cells, the same for all rows that lack the same columns. So one pass sums
    the products of all columns for each pattern of missing cells, and all rounds run on these small matrices: after a
    column's regression, the matrices of the patterns that lack it change in place. A second pass measures how far each round moved
    any cell, a third one fills. The number of jobs depends neither on columns nor on rounds, as long as the patterns are not very many.
    """
    numbers, texts = numeric_columns(df, [row_id]), string_columns(df, [row_id])
    columns = [*numbers, *texts]
    coded, labels = encode_ordinal(df, texts)
    stats = coded.agg(*[F.struct(
        F.count_if(_finite(c).isNull()).alias("gaps"), F.avg(_finite(c)).alias("mean"), F.stddev_pop(_finite(c)).alias("spread"), F.max(F.abs(_finite(c))).alias("top")).alias(f"s{k}") for k, c in enumerate(columns)
    ]).first()
    incomplete = sorted([k for k in range(len(columns)) if stats[k]["gaps"]], key=lambda k: stats[k]["gaps"])
    if not incomplete:
        return df
    middle = np.array([s["mean"] or 0.0 for s in stats])
    spread = np.array([s["spread"] or 1.0 for s in stats])
    scale = max([s["top"] or 0.0 for s in stats]) or 1.0
    # columns around their means in units of their spread, a gap is 0; the constant comes first
    units = [F.lit(1.0), *[F.coalesce((_finite(c) - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) for c, m, s in zip(columns, middle, spread, strict=True)]]
    pattern = F.concat(*[F.when(_finite(c).isNull(), "0").otherwise("1") for c in columns])
    work = checkpointed(coded.withColumns({"__pattern": pattern, "__z": F.array(*units)}))
    if work.select("__pattern").distinct().count() * (len(columns) + 1) ** 2 > PATTERN_NUMBERS:
        filled = _in_passes(coded, columns, [columns[k] for k in incomplete], rounds, tolerance)
        return _restore(filled, df, numbers, labels, {c: F.col(f"__w_{c}") for c in columns})
    patterns, products = _products(work, len(columns) + 1)
    maps = _chained(patterns, products, middle, spread, incomplete, rounds)
    last = next((r for r, moved in enumerate(_moves(work, patterns, maps, spread)) if moved < tolerance * scale), len(maps) - 1)
    # one row a pattern
    table = [(p, *[[float(x) for x in maps[last][i][k + 1]] for k in incomplete]) for i, p in enumerate(patterns)]
    weights = df.sparkSession.createDataFrame(table, "__pattern string, " + ", ".join(f"__k_{k} array<double>" for k in incomplete))
    joined = work.join(F.broadcast(weights), "__pattern")
    estimate = {c: F.lit(0.0) for c in columns}
    for k in incomplete:
        dot = F.aggregate(F.zip_with(f"__k_{k}", "__z", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
        estimate[columns[k]] = dot * float(spread[k]) + float(middle[k])
    return _restore(joined, df, numbers, labels, estimate)


def _in_passes(coded: DataFrame, columns: list[str], incomplete: list[str], rounds: int, tolerance: float) -> DataFrame:
    """The same rounds as passes over the rows, `__w_<column>` beside each column: for tables of very many patterns."""
    means = coded.agg(*[F.avg(_finite(c)).alias(c) for c in columns]).first().asDict()
    work = coded.select("*", *[F.coalesce(_finite(c), F.lit(float(means[c] or 0.0))).alias(f"__w_{c}") for c in columns])
    scale = work.agg(F.max(F.greatest(*[F.abs(f"__w_{c}") for c in columns], F.lit(0.0)))).first()[0] or 1.0
    for _ in range(rounds):
        before = {c: f"__b_{c}" for c in incomplete}
        work = work.withColumns({before[c]: F.col(f"__w_{c}") for c in incomplete})
        for target in incomplete:
            weights = _ridge_of(work.where(_finite(target).isNotNull()), f"__w_{target}", [f"__w_{c}" for c in columns if c != target])
            estimate = F.lit(weights[0])
            for c, w in zip([c for c in columns if c != target], weights[1:]):
                estimate = estimate + F.col(f"__w_{c}") * w
            work = work.withColumn(f"__w_{target}", F.coalesce(_finite(target), estimate))
        work = checkpointed(work)
        moved = work.agg(F.max(F.greatest(*[F.abs(F.col(f"__w_{c}") - F.col(before[c])) for c in incomplete], F.lit(0.0)))).first()[0]
        work = work.drop(*before.values())
        if moved is None or moved < tolerance * scale:
            break
    return work


def _ridge_of(df: DataFrame, target: str, features: list[str]) -> list[float]:
    """Intercept and weights of a lightly regularised least-squares fit from one aggregation of moments."""
    names = [*features, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(names))])
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    left = cov[:-1, :-1] + np.eye(len(features)) * 1e-6 * max(1.0, float(np.trace(cov[:-1, :-1])) / max(1, len(features)))
    weights = np.linalg.solve(left, cov[:-1, -1]) if features else np.array([])
    return [float(mean[-1] - weights @ mean[:-1]), *[float(w) for w in weights]]


def _products(work: DataFrame, width: int) -> tuple[list[str], np.ndarray]:
    """Patterns of known columns, and for each the sums of products of all columns of its rows: from one pass, a matrix a task and pattern."""
    upper = np.triu_indices(width)

    def add(frames):
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            z = np.vstack(frame["__z"].to_list()) if len(frame) else np.zeros((0, width))
            for name, rows in frame.groupby("__pattern").indices.items():
                sums[name] = sums.get(name, 0) + z[rows].T @ z[rows]
        if sums:
            yield pd.concat([pd.DataFrame({"pattern": p, "place": np.arange(len(upper[0])), "total": m[upper]}) for p, m in sums.items()])

    rows = work.select("__pattern", "__z").mapInPandas(add, "pattern string, place int, total double").groupBy("pattern", "place").agg(F.sum("total").alias("total")).toPandas()
    patterns = sorted(set(rows["pattern"]))
    made = np.zeros((len(patterns), width, width))
    at = rows["pattern"].map({p: i for i, p in enumerate(patterns)}).to_numpy()
    i, j = upper[0][rows["place"]], upper[1][rows["place"]]
    made[at, i, j] = made[at, j, i] = rows["total"]
    return patterns, made


def _chained(patterns: list[str], products: np.ndarray, middle: np.ndarray, spread: np.ndarray, incomplete: list[int], rounds: int) -> list[np.ndarray]:
    """After each round, for each pattern: the matrix that makes the filled row from the row with zeros in its gaps."""
    maps, made = np.repeat(np.eye(products.shape[1])[None], len(patterns), 0), []
    for _ in range(rounds):
        for k in incomplete:
            knows = np.array([p[k] == "1" for p in patterns])
            row = _ridge(products[knows].sum(0), k, spread)
            step = np.eye(products.shape[1])
            step[k + 1] = row
            for i in np.flatnonzero(~knows):
                maps[i] = step @ maps[i]
                products[i] = step @ products[i] @ step.T
        made.append(maps.copy())
    return made


def _ridge(products: np.ndarray, target: int, spread: np.ndarray) -> np.ndarray:
    """Weights of all columns, the constant first, of a lightly regularised least-squares fit; the target's own weight is 0."""
    row, n = np.zeros(len(products)), products[0, 0]
    others = [k for k in range(len(spread)) if k != target]
    if n == 0:
        return row
    mean = products[0, 1:] / n
    cov = (products[1:, 1:] / n - np.outer(mean, mean)) * np.outer(spread, spread)
    left = cov[np.ix_(others, others)]
    left = left + np.eye(len(others)) * 1e-6 * max(1.0, float(np.trace(left)) / max(1, len(others)))
    weights = np.linalg.solve(left, cov[others, target]) * spread[others] / spread[target] if others else np.array([])
    row[[k + 1 for k in others]] = weights
    row[0] = mean[target] - weights @ mean[others]
    return row


def _moves(work: DataFrame, patterns: list[str], maps: list[np.ndarray], spread: np.ndarray) -> list[float]:
    """How far each round moved any cell, for all rounds from one pass."""
    width = len(spread) + 1
    before = np.repeat(np.eye(width)[None], len(patterns), 0)
    changes = {p: np.stack([(m[i] - b[i])[1:] * spread[:, None] for m, b in zip(maps, [before, *maps[:-1]], strict=True)]) for i, p in enumerate(patterns)}

    def measure(frames):
        top = np.zeros(len(maps))
        for frame in frames:
            z = np.vstack(frame["__z"].to_list()) if len(frame) else np.zeros((0, width))
            for name, rows in frame.groupby("__pattern").indices.items():
                if "0" in name:
                    for r, change in enumerate(changes[name]):
                        top[r] = max(top[r], np.abs(z[rows] @ change.T).max())
        yield pd.DataFrame({"round": np.arange(len(maps)), "moved": top})

    rows = work.select("__pattern", "__z").mapInPandas(measure, "round int, moved double").groupBy("round").agg(F.max("moved").alias("moved")).collect()
    found = {r["round"]: r["moved"] for r in rows}
    return [found.get(r, 0.0) for r in range(len(maps))]


def advanced_impute(df: DataFrame, row_id: str, method: str = "auto") -> DataFrame:
    """Fill every gap: empty columns with 0 / Unknown, temporal columns by order, the rest by the chosen method."""
    counts = column_counts(df, [c for c in df.columns if c != row_id])
    rows = counts["*"]["rows"]
    empty = [c for c in df.columns if c != row_id and counts[c]["nulls"] == rows]
    if empty:
        df = fill_simple(df, empty)
    timed = [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL) and counts.get(f.name, {}).get("nulls")]
    if timed:
        df = fill_ordered(df, row_id, timed)
    chosen = choose_method(df, [row_id]) if method == "auto" else method
    plain = [c for c in df.columns if c != row_id and c not in timed]
    if chosen == "simple":
        return fill_simple(df, plain)
    if chosen == "knn":
        return fill_by_neighbours(df, row_id, k=min(5, max(1, rows - 1)))
    return fill_iterative(df, row_id)


def downgrade_columns(df: DataFrame, row_limit: int | None = None, share: float = 0.20) -> list[str]:
    """Columns that a caller wants filled simply: those with more than `share` missing, in tables of more than `row_limit` rows.

    Without a limit no column is: a table's size alone changes nothing.
    """
    if row_limit is None:
        return []
    counts = column_counts(df, approx=True)
    rows = counts["*"]["rows"]
    return [c for c in df.columns if rows > row_limit and counts[c]["nulls"] / rows > share]


def statistic_imputer(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Median for numbers through the ML imputer, most frequent value for categories."""
    if numeric:
        doubles = df.withColumns({c: F.col(c).cast("double") for c in numeric})
        df = Imputer(strategy="median", inputCols=numeric, outputCols=numeric, relativeError=0.0001).fit(doubles).transform(doubles)
    fills = modes(df, categorical)
    return df.withColumns({c: F.coalesce(c, F.lit(fills[c])) for c in categorical if fills[c] is not None}) if categorical else df


def restore_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Round to whole numbers and cast back where the original column was an integer."""
    return df.select(*[
        (F.bround(f.name, 0).cast(f.dataType) if is_integer(f.dataType) else F.col(f.name).cast(f.dataType)).alias(f.name) for f in schema
    ])
