"""Splits, label codes, prediction metrics and curves, all as aggregations over a prediction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.hashing import cell, draw
from tablewright.operators.frames import string_columns, with_few
from tablewright.operators.neighbours import nearest_rows
from tablewright.operators.ordered import prefix_sums
from tablewright.operators.profile import distinct_counts
from tablewright.operators.quantiles import exact_quantiles, most_frequent
from tablewright.session import checkpointed

#: Rows of one number a class that are sent to all tasks; more classes are joined by a shuffle.
CLASSES_SENT = 100_000

# Model families with a complexity penalty.
COMPLEXITY = {"RandomForest": 0.015, "ExtraTrees": 0.015, "GradientBoosting": 0.015, "XGBoost": 0.015, "LightGBM": 0.015, "CatBoost": 0.015, "SVM": 0.01}


def stratified_split(df: DataFrame, row_id: str, label: str | None, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `is_test`: in every class the round(n·test_size) rows with the smallest (draw, row id).

    Per-class thresholds come from counts per cell of draws, so a class holding most rows is never
    sorted in one task, and reach the rows by broadcast where classes are few. Without a label, or when a class has one row, the split ignores classes.
    """
    rows = df.withColumn("__draw", draw(F.col(row_id), seed))
    if label is not None and df.groupBy(label).count().where("count < 2").limit(1).count():
        label = None
    rows = rows.withColumn("__class", F.col(label) if label else F.lit(0))
    rows = rows.withColumn("__cell", cell(F.col("__draw")))
    cells = rows.groupBy("__class", "__cell").agg(F.count("*").alias("__n"))
    sizes = cells.groupBy("__class").agg(F.floor(F.sum("__n") * test_size + 0.5).alias("__want"))
    before = Window.partitionBy("__class").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 1,048,576 cells
    edges = (
        cells.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(sizes.withColumnRenamed("__class", "__k"), F.col("__class").eqNullSafe(F.col("__k")))
        .where((F.col("__before") < F.col("__want")) & (F.col("__before") + F.col("__n") >= F.col("__want")))
        .select(F.col("__class").alias("__c"), F.col("__cell").alias("__edge"), (F.col("__want") - F.col("__before")).alias("__take"))
    )
    edges = with_few(checkpointed(edges), CLASSES_SENT)
    tied = rows.join(edges, F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__cell") == F.col("__edge"))).select("__c", row_id, "__draw", "__take")
    ranked = tied.withColumn("__r", F.row_number().over(Window.partitionBy("__c").orderBy("__draw", row_id)))  # one cell a class
    last = ranked.where(F.col("__r") == F.col("__take")).select("__c", F.col("__draw").alias("__last_draw"), F.col(row_id).alias("__last"))
    joined = rows.join(with_few(checkpointed(last), CLASSES_SENT), F.col("__class").eqNullSafe(F.col("__c")), "left")
    test = (F.col("__draw") < F.col("__last_draw")) | ((F.col("__draw") == F.col("__last_draw")) & (F.col(row_id) <= F.col("__last")))
    return joined.select(*df.columns, F.coalesce(test, F.lit(False)).alias("is_test"))


def encode_label(df: DataFrame, label: str, classification: bool = True, name: str = "label_code", max_classes: int = 1000) -> DataFrame:
    """Classes to sorted codes after filling gaps with the mode; regression targets are filled with the median."""
    if not classification:
        middle = exact_quantiles(df, {label: [0.5]})[label][0.5]
        return df.withColumn(name, F.coalesce(F.col(label).cast("double"), F.lit(middle)))
    fill = most_frequent(df, label)
    filled = F.coalesce(F.col(label), F.lit(fill if fill is not None else "missing"))
    values = [r[0] for r in df.select(filled.alias("v")).distinct().limit(max_classes + 1).collect()]
    if len(values) > max_classes:
        raise ValueError(f"{label!r} has more than {max_classes} classes")
    return df.withColumn(name, F.array_position(F.array(*[F.lit(v) for v in sorted(values)]), filled) - 1)


def semantic_codes(df: DataFrame, positive: dict[str, object], skip: list[str] = ()) -> DataFrame:
    """Two-valued text columns to 1 / 0 (1 is the caller's positive value, else the larger), 3–10 values to sorted codes."""
    texts = string_columns(df, skip)
    if not texts:
        return df
    distinct = distinct_counts(df, texts)
    changed = {}
    for c in texts:
        if not 2 <= distinct[c] <= 10:
            continue
        values = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().collect())  # at most 10 rows
        if distinct[c] == 2:
            yes = positive.get(c, values[1])
            changed[c] = F.when(F.col(c) == yes, 1).when(F.col(c).isin(values), 0)
        else:
            changed[c] = F.when(F.col(c).isNotNull(), (F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1).cast("int"))
    return df.withColumns(changed) if changed else df


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and class-weighted precision, recall, F1 (0 where undefined), from the confusion counts."""
    cells = confusion_matrix(df, label, prediction)
    actual = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("called"))
    per = actual.join(predicted, "class", "left")
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("called"), F.lit(0)), F.lit(0.0))
    recall = F.col("tp") / F.col("support")
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    total = F.sum("support")
    return per.agg(
        (F.sum("tp") / total).alias("accuracy"), (F.sum(precision * F.col("support")) / total).alias("precision"),
        (F.sum(recall * F.col("support")) / total).alias("recall"), (F.sum(f1 * F.col("support")) / total).alias("f1"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: RMSE, MAE and R²."""
    error = F.col(label) - F.col(prediction)
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.avg(error * error) / F.nullif(F.var_pop(label), F.lit(0.0))).alias("r2"),
    )


def _score_counts(df: DataFrame, positive: Column, score: str) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    """One row: area under the ROC curve, ties counted half, from prefix sums over distinct scores."""
    counts = _score_counts(df, F.col(label) == F.lit(positive), score)
    placed = prefix_sums(counts, "score", {"neg_below": F.col("neg")})
    return placed.agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg").cast("double"), F.lit(0.0))).alias("roc_auc")
    )


def curve_points(df: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    """(threshold, fpr, tpr, precision, recall) at every distinct score, counting scores at or above it."""
    counts = _score_counts(df, F.col(label) == F.lit(positive), score)
    totals = counts.agg(F.sum("pos"), F.sum("neg")).first()
    positives, negatives = float(totals[0] or 0), float(totals[1] or 0)
    placed = prefix_sums(counts, "score", {"pb": F.col("pos"), "nb": F.col("neg")})
    hits, alarms = F.lit(positives) - F.col("pb"), F.lit(negatives) - F.col("nb")
    return placed.select(
        F.col("score").alias("threshold"), (alarms / F.nullif(F.lit(negatives), F.lit(0.0))).alias("fpr"),
        (hits / F.nullif(F.lit(positives), F.lit(0.0))).alias("tpr"), (hits / (hits + alarms)).alias("precision"),
        (hits / F.nullif(F.lit(positives), F.lit(0.0))).alias("recall"),
    )


def multiclass_curves(df: DataFrame, label: str, scores: dict[object, str]) -> DataFrame:
    """One-vs-rest curve points per class; `scores` maps a class to its score column."""
    result = None
    for klass, column in scores.items():
        part = curve_points(df, label, column, klass).withColumn("class", F.lit(str(klass)))
        result = part if result is None else result.unionByName(part)
    return result


def residuals(df: DataFrame, row_id: str, label: str, prediction: str) -> DataFrame:
    return df.select(row_id, F.col(label).alias("actual"), F.col(prediction).alias("predicted"), (F.col(label) - F.col(prediction)).alias("residual"))


def composite_scores(board: DataFrame) -> DataFrame:
    """Balanced score per leaderboard row (model, train_score, val_score, cv_mean, cv_std).

    0.4 validation + 0.4 cross-validation + 0.2 stability, minus overfit, perfect-score and complexity penalties.
    """

    def clip(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    val, cv = clip(F.col("val_score")), clip(F.col("cv_mean"))
    train = clip(F.col("train_score"))
    gap = F.greatest(F.lit(0.0), train - val)
    overfit = F.when(gap <= 0.05, 0.0).when(gap <= 0.15, (gap - 0.05) * 0.5).otherwise(gap - 0.05 + 0.10)
    perfect = F.when((F.col("val_score") == 1.0) & (F.col("train_score") == 1.0), F.when(F.col("cv_mean") < 0.95, 0.20).otherwise(0.05)).otherwise(0.0)
    stability = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("cv_std") * 5.0)
    complexity = F.lit(0.0)
    for name, cost in COMPLEXITY.items():
        complexity = F.when(F.col("model") == name, cost).otherwise(complexity)
    out = board.withColumn("composite", clip(val * 0.4 + cv * 0.4 + stability * 0.2 - overfit - perfect - complexity)).withColumn("gap", gap)
    status = (
        F.when(F.col("gap") > 0.15, "Heavy Overfitting").when(F.col("gap") > 0.05, "Slight Overfitting")
        .when(train < 0.55, "Underfitting").otherwise("Stable")
    )
    out = out.withColumn("status", status)
    recommended = (F.col("status") == "Stable") & (F.col("cv_std") < 0.04) & (F.col("composite") >= 0.70)
    return out.withColumn("labels", F.concat_ws("|", F.col("status"), F.when(F.col("cv_std") > 0.08, "High Variance"), F.when(recommended, "Recommended").otherwise("Experimental")))


def knn_predict(
    train: DataFrame, test: DataFrame, row_id: str, features: list[str] | str, label: str, k: int = 5, regression: bool = False
) -> DataFrame:
    """(row_id, prediction): majority label (smallest on ties) or mean of the k nearest training rows."""
    near = nearest_rows(test, train.withColumnRenamed(row_id, "__train"), row_id, "__train", features, k, payload=label)
    if regression:
        return near.groupBy(F.col("query").alias(row_id)).agg(F.avg(label).alias("prediction"))
    votes = near.groupBy("query", label).agg(F.count("*").alias("n"))
    best = votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("r"), F.col(label).alias("label"))).alias("top"))
    return best.select(F.col("query").alias(row_id), F.col("top.label").alias("prediction"))
