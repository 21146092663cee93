"""Properties of results that SQL can not compute: sizes, bounds and cells that must stay, beside the same facts of the source as SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.functions.hashing import chosen, unit
from tablewright.operators import evaluate, models
from tablewright.queries.learning import price_rows, split
from tablewright.queries.profiles import rounded
from tablewright.queries.registry import QUERIES, query, read
from tablewright.queries.repair import misspelled, sql_misspelled
from tablewright.queries.synthetic import people_ids, people_table
from tablewright.queries.views import CONTACTS, DIRTY_ORDERS, contacts, sql_chosen, sql_unit
from tablewright.session import checkpointed


@query("h4_model_fill_number_properties", f"WITH {DIRTY_ORDERS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS gaps FROM dirty")
def _(spark, sf):
    return QUERIES["h4_model_fill_number"](spark, sf).agg(F.count("*").alias("rows"), F.count_if(F.col("price").isNull()).alias("gaps"))


@query("h4_model_fill_text_properties", f"WITH {CONTACTS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS gaps, count(segment) AS known_kept FROM contacts")
def _(spark, sf):
    filled = QUERIES["h4_model_fill_text"](spark, sf).select("row_id", "segment").join(contacts(spark, sf).select("row_id", F.col("segment").alias("before")), "row_id")
    return filled.agg(F.count("*").alias("rows"), F.count_if(F.col("segment").isNull()).alias("gaps"), F.count_if(F.col("segment") == F.col("before")).alias("known_kept"))


@query("h6_iterative_fill_properties", f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id FROM lineitem GROUP BY 1)
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS gaps, count(*) FILTER (WHERE NOT {sql_chosen('row_id', 24, 0.1)}) AS known_kept FROM r""")
def _(spark, sf):
    source = read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")).agg(F.max("l_extendedprice").alias("before"))
    filled = QUERIES["h6_iterative_fill"](spark, sf).select("row_id", "price").join(source, "row_id")
    known = ~chosen(F.col("row_id"), 24, 0.1)
    return filled.agg(F.count("*").alias("rows"), F.count_if(F.col("price").isNull()).alias("gaps"), F.count_if(known & (F.abs(F.col("price") - F.col("before")) < 0.006)).alias("known_kept"))


@query("g2_anomaly_properties", "SELECT count(*) AS rows, true AS few FROM orders")
def _(spark, sf):
    flags = QUERIES["g2_anomaly_flags"](spark, sf)
    return flags.agg(F.count("*").alias("rows"), (F.sum("is_anomaly") <= 0.11 * F.count("*")).alias("few"))


@query("f1_typo_map_indel_properties", "SELECT CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS to_itself")
def _(spark, sf):
    labels = misspelled(spark, sf).select("label").distinct()
    found = checkpointed(QUERIES["f1_typo_map_indel"](spark, sf))
    ends = found.select(F.col("wrong").alias("label")).union(found.select(F.col("right").alias("label")))
    strangers = ends.join(labels, "label", "left_anti").count()
    facts = found.agg(F.lit(strangers).cast("bigint").alias("strangers"), (F.count("*") - F.count_distinct("wrong")).alias("repeated"), F.count_if(F.col("wrong") == F.col("right")).alias("to_itself"))
    return facts


@query("f2_consolidation_properties", f"WITH {sql_misspelled()}, n AS (SELECT label, count(*) AS n FROM spelled GROUP BY label) SELECT CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS repeated, count(*) AS spellings FROM n")
def _(spark, sf):
    labels = misspelled(spark, sf).select("label").distinct()
    found = checkpointed(QUERIES["f2_consolidation_map"](spark, sf))
    ends = found.select(F.col("wrong").alias("label")).union(found.select(F.col("right").alias("label")))
    strangers, spellings = ends.join(labels, "label", "left_anti").count(), labels.count()
    return found.agg(F.lit(strangers).cast("bigint").alias("strangers"), (F.count("*") - F.count_distinct("wrong")).alias("repeated"), F.lit(spellings).cast("bigint").alias("spellings"))


def made_properties(spark, sf, made):
    """Rows made, numbers outside the source's bounds, categories the source does not hold."""
    source = people_table(spark, sf)
    low, high = source.agg(F.min("balance"), F.max("balance")).first()
    strangers = made.join(source.select("segment").distinct(), "segment", "left_anti").count()
    return made.agg(F.count("*").alias("rows"), F.count_if((F.col("balance") < low - 0.01) | (F.col("balance") > high + 0.01)).alias("outside"), F.lit(strangers).cast("bigint").alias("strangers"))


@query("j12_copula_properties", "SELECT true AS all_made, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS strangers")
def _(spark, sf):
    made = checkpointed(QUERIES["j12_gaussian_copula"](spark, sf))
    facts = made_properties(spark, sf, made)
    return facts.select((F.col("rows") == people_ids(spark, sf).count()).alias("all_made"), "outside", "strangers")


@query("k1_feature_properties", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unknown FROM orders")
def _(spark, sf):
    made = QUERIES["k1_feature_preparation"](spark, sf)
    return made.agg(F.count("*").alias("rows"), F.count_if(F.col("features").isNull() | F.col("features").contains("NaN")).alias("unknown"))


@query("k13_scoring_properties", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS other_labels FROM orders")
def _(spark, sf):
    scored = QUERIES["k13_batch_scoring"](spark, sf)
    return scored.agg(F.count("*").alias("rows"), F.count_if(~F.col("p_large").between(0, 1)).alias("outside"), F.count_if(~F.col("predicted_label").isin("small", "large")).alias("other_labels"))


@query("k15_saved_model_properties", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM orders")
def _(spark, sf):
    _, ready = split(spark, sf)
    first = ready.select("row_id", F.round(vector_to_array("features")[0], 6).alias("before"))
    again = QUERIES["k15_saved_model"](spark, sf).join(first, "row_id")
    return again.agg(F.count("*").alias("rows"), F.count_if(F.col("first_feature") != F.col("before")).alias("changed"))


def status_rows(spark, sf):
    """Orders with the status as a label of several classes."""
    df = price_rows(spark, sf).drop("label").withColumn("label", (F.array_position(F.array(*[F.lit(s) for s in "FOP"]), F.col("status")) - 1).cast("double"))
    df = evaluate.stratified_split(df, "row_id", "label")
    _, ready = models.prepare_features(df, ["year", "noisy"], ["priority"], [], "label")
    return checkpointed(ready.select("label", "is_test", "features"))


@query("k5_multiclass_training", "SELECT unnest(['LogisticRegression', 'DecisionTree', 'SVM']) AS model, true AS in_bounds")
def _(spark, sf):
    ready = status_rows(spark, sf)
    board, _ = models.train_baselines(ready.where("not is_test"), ready.where("is_test"), "multiclass", ["LogisticRegression", "DecisionTree", "SVM"], folds=2)
    return board.select("model", (F.col("val_score").between(0, 1) & F.col("cv_mean").between(0, 1)).alias("in_bounds"))


@query("k5_regression_training", "SELECT unnest(['LinearRegression', 'DecisionTree', 'RandomForest', 'GradientBoosting']) AS model, true AS good_fit")
def _(spark, sf):
    df = evaluate.stratified_split(price_rows(spark, sf).withColumn("part", F.lit("a")), "row_id", "part")
    _, ready = models.prepare_features(df.drop("label").withColumn("label", F.col("price")), ["year", "noisy"], ["priority"], [], "label")
    ready = checkpointed(ready.select("label", "is_test", "features"))
    board, _ = models.train_baselines(ready.where("not is_test"), ready.where("is_test"), "regression", folds=2)
    # the price is known but for a tenth
    return board.select("model", (F.col("val_score") > 0.8).alias("good_fit"))


@query("k6_regression_search", "SELECT CAST(5 AS BIGINT) AS settings, true AS in_bounds")
def _(spark, sf):
    df = price_rows(spark, sf)
    _, ready = models.prepare_features(df.drop("label").withColumn("label", F.col("price")), ["year", "noisy"], ["priority"], [], "label")
    _, report = models.search_settings(checkpointed(ready.select("features", "label")), "regression", "DecisionTree")
    return spark.createDataFrame(report, "setting string, score double").agg(F.count("*").alias("settings"), F.bool_and(F.col("score") <= 1).alias("in_bounds"))


def _sql_class(name: str, seed: int) -> str:
    return f"""SELECT '{name}' AS class, score AS threshold, round(fp / nn, 6) AS fpr, round(tp / pp, 6) AS tpr, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall
FROM (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn
FROM (SELECT round(CASE WHEN o_orderstatus = '{name}' THEN 0.4 ELSE 0.0 END + {sql_unit('o_orderkey', seed)} * 0.6, 2) AS score, count(*) FILTER (WHERE o_orderstatus = '{name}') AS pos, count(*) FILTER (WHERE o_orderstatus <> '{name}') AS neg FROM orders GROUP BY 1))"""


@query("k10_multiclass_curves", " UNION ALL ".join(_sql_class(c, 50 + k) for k, c in enumerate("FOP")))
def _(spark, sf):
    orders = read(spark, sf, "orders")
    scored = orders.select("o_orderstatus", *[
        F.round(F.when(F.col("o_orderstatus") == c, 0.4).otherwise(0.0) + unit(F.col("o_orderkey"), 50 + k) * 0.6, 2).alias(f"s_{c}") for k, c in enumerate("FOP")])
    return rounded(evaluate.multiclass_curves(scored, "o_orderstatus", {c: f"s_{c}" for c in "FOP"}))
