"""Queries: features, splits, models, metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.functions.hashing import unit
from tablewright.operators import evaluate, models
from tablewright.queries.profiles import rounded
from tablewright.queries.registry import query, read
from tablewright.queries.tables import scratch
from tablewright.queries.views import sql_draw, sql_unit
from tablewright.session import checkpointed


def price_rows(spark, sf):
    """Line items as a learning table: label 1 for large lines."""
    df = read(spark, sf, "orders")
    return df.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").cast("double").alias("year"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 250000).cast("double").alias("label"), (F.col("o_totalprice") * (0.9 + unit(F.col("o_orderkey"), 40) * 0.2)).alias("noisy"))


def split(spark, sf):
    """Numeric and encoded features with a stratified split."""
    df = evaluate.stratified_split(price_rows(spark, sf), "row_id", "label")
    stages, ready = models.prepare_features(df, ["year", "noisy"], ["status"], ["priority"], "label")
    return stages, checkpointed(ready.select("row_id", "label", "is_test", "features"))  # every fit and score reads this table


@query("k1_feature_preparation")
def _(spark, sf):
    _, ready = split(spark, sf)
    return ready.select("row_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).cast("string").alias("features"))


@query("k2_stratified_split", f"""SELECT o_orderkey AS row_id, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {sql_draw('o_orderkey', 42)}, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.2 + 0.5) AS is_test FROM orders""")
def _(spark, sf):
    df = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("priority"))
    return evaluate.stratified_split(df, "row_id", "priority")


@query("k3_label_codes", "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label_code FROM orders")
def _(spark, sf):
    return evaluate.encode_label(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("k4_semantic_codes", """SELECT l_orderkey, l_linenumber, CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS l_returnflag FROM lineitem""")
def _(spark, sf):
    return evaluate.semantic_codes(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag"), {"l_linestatus": "O"})


@query("k5_baseline_training")
def _(spark, sf):
    _, ready = split(spark, sf)
    board, _ = models.train_baselines(ready.where("not is_test"), ready.where("is_test"), "binary")
    return board


@query("k6_parameter_search")
def _(spark, sf):
    _, ready = split(spark, sf)
    _, report = models.search_settings(ready.where("not is_test").select("features", "label"), "binary", "LogisticRegression")
    return spark.createDataFrame(report, "setting string, score double")


def predictions(spark, sf):
    """Labels with a derived score and prediction, portable to SQL."""
    score = F.round((F.col("quality") + unit(F.col("doc_id"), 41)) / 2, 2)
    return read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), "toxic", score.alias("score"), (score >= 0.45).cast("int").alias("prediction"))


_PRED = f"p AS (SELECT doc_id, quality AS label, toxic, round((quality + {sql_unit('doc_id', 41)}) / 2, 2) AS score, CAST(round((quality + {sql_unit('doc_id', 41)}) / 2, 2) >= 0.45 AS INTEGER) AS prediction FROM labels)"


@query("k7_classification_metrics", f"""WITH {_PRED}, c AS (SELECT k, (SELECT count(*) FROM p WHERE label = k) AS s, (SELECT count(*) FROM p WHERE label = k AND prediction = k) AS tp, (SELECT count(*) FROM p WHERE prediction = k) AS q FROM (SELECT DISTINCT label AS k FROM p)),
m AS (SELECT s, tp, coalesce(tp / nullif(q, 0), 0) AS pr, tp / s AS re FROM c) SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(sum(pr * s) / sum(s), 6) AS precision, round(sum(re * s) / sum(s), 6) AS recall, round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * s) / sum(s), 6) AS f1 FROM m""")
def _(spark, sf):
    return rounded(evaluate.classification_metrics(predictions(spark, sf), "label", "prediction"))


@query("k7_roc_auc", f"WITH {_PRED} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS roc_auc FROM p a JOIN p b ON a.label = 1 AND b.label = 0")
def _(spark, sf):
    return rounded(evaluate.roc_auc(predictions(spark, sf), "label", "score"))


@query("k7_regression_metrics", f"""WITH r AS (SELECT o_totalprice AS y, o_totalprice * (0.9 + {sql_unit('o_orderkey', 40)} * 0.2) AS p FROM orders)
SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2 FROM r""")
def _(spark, sf):
    return rounded(evaluate.regression_metrics(price_rows(spark, sf), "price", "noisy"), 4)


_BOARD = """b AS (SELECT (['LogisticRegression', 'DecisionTree', 'RandomForest', 'GradientBoosting', 'SVM'])[CAST(l_linenumber AS INTEGER) % 5 + 1] || '' AS model, l_linenumber AS fold, round(1 - avg(l_tax), 6) AS train_score, round(1 - avg(l_discount) * 2, 6) AS val_score, round(1 - avg(l_discount) * 2.5, 6) AS cv_mean, round(stddev_samp(l_tax), 6) AS cv_std FROM lineitem GROUP BY l_linenumber)"""


@query("k8_composite_scores", f"""WITH {_BOARD}, g AS (SELECT *, greatest(0, train_score - val_score) AS gap, CASE WHEN model IN ('RandomForest', 'GradientBoosting') THEN 0.015 WHEN model = 'SVM' THEN 0.01 ELSE 0 END AS cx FROM b),
s AS (SELECT *, 0.4 * val_score + 0.4 * cv_mean + 0.2 * greatest(0, 1 - 5 * cv_std) - CASE WHEN gap <= 0.05 THEN 0 WHEN gap <= 0.15 THEN 0.5 * (gap - 0.05) ELSE gap - 0.05 + 0.10 END - cx AS raw FROM g)
SELECT model, fold, train_score, val_score, cv_mean, cv_std, round(greatest(0, least(1, raw)), 6) AS composite, round(gap, 6) AS gap, CASE WHEN gap > 0.15 THEN 'Heavy Overfitting' WHEN gap > 0.05 THEN 'Slight Overfitting' WHEN train_score < 0.55 THEN 'Underfitting' ELSE 'Stable' END AS status FROM s""")
def _(spark, sf):
    name = F.element_at(F.array(*[F.lit(m) for m in ("LogisticRegression", "DecisionTree", "RandomForest", "GradientBoosting", "SVM")]), F.col("l_linenumber") % 5 + 1)
    board = read(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.round(1 - F.avg("l_tax"), 6).alias("train_score"), F.round(1 - F.avg("l_discount") * 2, 6).alias("val_score"), F.round(1 - F.avg("l_discount") * 2.5, 6).alias("cv_mean"), F.round(F.stddev_samp("l_tax"), 6).alias("cv_std"))
    board = board.select(name.alias("model"), F.col("l_linenumber").alias("fold"), "train_score", "val_score", "cv_mean", "cv_std")
    return rounded(evaluate.composite_scores(board).drop("labels"))


@query("k9_confusion_matrix", f"WITH {_PRED} SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction")
def _(spark, sf):
    return evaluate.confusion_matrix(predictions(spark, sf), "label", "prediction")


@query("k10_curve_points", f"""WITH {_PRED}, s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM p GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM s)
SELECT score AS threshold, round(fp / nn, 6) AS fpr, round(tp / pp, 6) AS tpr, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall FROM c""")
def _(spark, sf):
    return rounded(evaluate.curve_points(predictions(spark, sf), "label", "score"))


@query("k11_residuals", f"SELECT o_orderkey AS row_id, o_totalprice AS actual, round(o_totalprice * (0.9 + {sql_unit('o_orderkey', 40)} * 0.2), 4) AS predicted, round(o_totalprice - o_totalprice * (0.9 + {sql_unit('o_orderkey', 40)} * 0.2), 4) AS residual FROM orders")
def _(spark, sf):
    return rounded(evaluate.residuals(price_rows(spark, sf), "row_id", "price", "noisy"), 4)


@query("k12_feature_importance")
def _(spark, sf):
    _, ready = split(spark, sf)
    train = ready.where("not is_test")
    model = models.families("binary")["DecisionTree"].fit(train)
    width = train.select(F.size(vector_to_array("features")).alias("n")).first()["n"]
    names = [f"f{i}" for i in range(width)]
    native = spark.createDataFrame(models.native_importance(model, names), "feature string, importance double")
    shuffled = models.permutation_importance(model, ready.where("is_test"), "row_id", names, "binary")
    return native.withColumn("kind", F.lit("native")).union(shuffled.withColumn("kind", F.lit("permutation")))


@query("k13_batch_scoring")
def _(spark, sf):
    stages, ready = split(spark, sf)
    model = models.families("binary")["LogisticRegression"].fit(ready.where("not is_test"))
    fresh = price_rows(spark, sf).select("row_id", "noisy", "status", "priority")  # no year: scored as missing
    scored = models.score_rows(stages, model, fresh, ["year", "noisy"], ["status", "priority"], labels=["small", "large"])
    return scored.select("row_id", "predicted_label", F.round(F.col("probabilities")[1], 6).alias("p_large"))


_VEC = f"e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, row_number() OVER (PARTITION BY label ORDER BY {sql_draw('vec_id', 42)}, vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS is_test FROM embeddings)"


@query("k14_knn_classify", f"""WITH {_VEC}, n AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rn FROM e q JOIN e t ON q.is_test AND NOT t.is_test),
v AS (SELECT vec_id, label, count(*) AS c FROM n WHERE rn <= 5 GROUP BY vec_id, label) SELECT vec_id, arg_min(label, (-c, label)) AS prediction FROM v GROUP BY vec_id""")
def _(spark, sf):
    df = evaluate.stratified_split(read(spark, sf, "embeddings"), "vec_id", "label")
    return evaluate.knn_predict(df.where("not is_test"), df.where("is_test"), "vec_id", "embedding", "label")


@query("k15_saved_model")
def _(spark, sf):
    stages, ready = split(spark, sf)
    path = scratch(spark, "stages")
    models.save_model(stages, path)
    again = models.load_model(path).transform(models.fill_modes(price_rows(spark, sf), ["status", "priority"]))
    return again.select("row_id", F.round(vector_to_array("features")[0], 6).alias("first_feature"))
