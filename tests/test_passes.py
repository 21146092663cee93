"""Statistics of many columns in few passes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import audit, evaluate, profile, quantiles


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    rows = []
    for i in range(3000):
        number = draw.choice([None, float("nan"), 0.0, -0.0, 1.5, draw.gauss(0, 100)])
        rows.append((i, number, draw.choice([None, "a", "b", "", str(draw.randrange(500))]), draw.choice([None, [1.0], [1.0, 2.0], []]), draw.choice([True, False, None]), bytes([draw.randrange(3)])))
    df = spark.createDataFrame(rows, "row_id long, number double, word string, list array<double>, flag boolean, raw binary")
    return df.withColumn("at", F.timestamp_micros(F.col("row_id") % 700)).repartition(6)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_counts_equal_the_built_in(table):
    columns = table.columns
    want = table.agg(*[F.count_distinct(c).alias(c) for c in columns]).first().asDict()
    assert "Expand" in plan(table.agg(*[F.count_distinct(c) for c in columns]))
    assert profile.distinct_counts(table, columns) == want
    nulls = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    assert profile.column_counts(table) == {c: {"nulls": nulls[c], "distinct": want[c]} for c in columns} | {"*": {"rows": 3000}}
    assert profile.distinct_counts(table.limit(0), columns) == dict.fromkeys(columns, 0)
    assert profile.column_counts(table.limit(0))["*"] == {"rows": 0}
    near = profile.distinct_counts(table, ["word", "row_id"], approx=True)
    assert abs(near["row_id"] - 3000) < 300 and abs(near["word"] - want["word"]) < 60


def test_no_row_is_copied_for_each_distinct_count(table):
    flat = table.select("row_id", "number", "word", "flag")
    plans = [profile.distinct_cells(flat, flat.columns), profile.column_profile(flat), profile.typed_profile(flat, "row_id"), profile.type_distribution(flat), profile.key_like(flat, ["word", "row_id"]),
             profile.training_summary(flat, "flag"), audit.column_audit(flat, flat, "row_id"), evaluate.semantic_codes(flat, {}, [])]
    assert not any("Expand" in plan(df) for df in plans)


def test_sketches_of_parts_merge(table):
    parts = [profile.distinct_sketches(table.where(f"row_id % 4 = {k}"), ["row_id", "word", "at"]) for k in range(4)]
    merged = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    got = {r["column"]: r["distinct"] for r in profile.merged_distinct(merged).collect()}
    want = profile.distinct_counts(table, ["row_id", "word", "at"])
    assert all(abs(got[c] - want[c]) <= 0.05 * want[c] for c in want)


def jobs(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs {random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("other", "other")


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_of_all_columns_share_their_passes(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    draw = np.random.default_rng(5)
    made = {"even": draw.random(4000), "tied": draw.integers(0, 4, 4000).astype(float), "one": np.full(4000, 7.0), "skewed": np.exp(draw.normal(0, 5, 4000)), "few": np.where(np.arange(4000) < 10, draw.random(4000), np.nan)}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in made.values()), strict=True)), ", ".join(f"{c} double" for c in made)).repartition(4).cache()
    df.count()
    shares = [0.0, 0.01, 0.25, 0.5, 1 / 3, 0.75, 0.999, 1.0]
    got, several = jobs(spark, lambda: quantiles.exact_quantiles(df, {c: shares for c in made}, small=50))
    for c, v in made.items():
        for p in shares:
            assert got[c][p] == pytest.approx(np.quantile(v[~np.isnan(v)], p), rel=1e-12, abs=1e-12), (c, p)
    if accuracy == 10_000:
        one = jobs(spark, lambda: quantiles.exact_quantiles(df, {"even": [0.5], "few": [0.5]}, small=50))[1]
        assert several <= one + 2
