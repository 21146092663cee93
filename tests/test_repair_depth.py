"""Short values at low ratios, wide text predictors, options left out."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import fuzzy, impute, profile


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("scorer", ["levenshtein", "indel"])
@pytest.mark.parametrize("ratio", [0.3, 0.5, 0.62, 0.8])
def test_no_similar_pair_is_missed(spark, scorer, ratio):
    draw = random.Random(7)
    values = sorted({"".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 9))) for _ in range(150)} | {"a", "b", "ab", "abcd", "aa", "xyzxyzxyzx", "한글", "글"})
    want = set()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            score = 1 - levenshtein(a, b) / max(len(a), len(b)) if scorer == "levenshtein" else 2 * common(a, b) / (len(a) + len(b))
            if score >= ratio:
                want.add((a, b))
    got = fuzzy.similar_pairs(spark.createDataFrame([(v,) for v in values], "v string"), "v", ratio, scorer).collect()
    assert {(r["a"], r["b"]) for r in got} == want


def wide_table(spark, rows=3000, kinds=500):
    """A number that a text of 500 values sets, hidden in a third of the rows; a third of all rows hold one text."""
    draw = random.Random(5)
    level = [draw.gauss(0, 100) for _ in range(kinds)]
    made = []
    for i in range(rows):
        k = 0 if draw.random() < 0.33 else draw.randrange(kinds)
        value = level[k] + draw.gauss(0, 1)
        made.append((i, None if draw.random() < 0.03 else f"kind {k}", draw.random(), None if draw.random() < 0.3 else value, value))
    return spark.createDataFrame(made, "row_id long, kind string, noise double, value double, truth double").repartition(5)


def test_target_statistics_use_earlier_rows_only(spark):
    df = wide_table(spark, 600, 60)
    got = impute.target_statistics(df, ["kind"], F.col("value"), F.col("value").isNotNull(), "row_id", seed=3).collect()
    from tablewright.functions.hashing import draw

    order = {r["row_id"]: r["d"] for r in df.select("row_id", draw(F.col("row_id"), 3).alias("d")).collect()}
    known = [r for r in got if r["value"] is not None]
    mean = sum(r["value"] for r in known) / len(known)
    for r in got:
        seen = [o["value"] for o in known if o["kind"] == r["kind"] and (r["value"] is None or (order[o["row_id"]], o["row_id"]) < (order[r["row_id"]], r["row_id"]))]
        assert r["__t_kind"] == pytest.approx((sum(seen) + mean) / (len(seen) + 1), abs=1e-9)


def test_wide_text_predictors_take_part_in_model_fills(spark):
    df = wide_table(spark)
    filled = impute.fill_by_model(df.drop("truth"), "value", "row_id")
    assert filled.columns == ["row_id", "kind", "noise", "value"] and filled.count() == 3000
    error = filled.join(df.select("row_id", "truth", F.col("value").isNull().alias("gap")), "row_id").where("gap and kind is not null")
    # texts of which no row is known can only get the mean: the middle error tells
    assert error.select(F.percentile_approx(F.abs(F.col("value") - F.col("truth")), 0.5)).first()[0] < 25
    assert filled.where("value is null").count() == 0


def test_options_left_out_are_counted(spark):
    df = spark.range(120).selectExpr("cast(id as double) as x", "concat('v', lpad(cast(id % 70 as string), 2, '0')) as c")
    cut, whole = (profile.feature_ranges(df, ["x"], ["c"], limit).where("kind = 'categorical'").first() for limit in (50, None))
    assert (len(cut["options"].split("|")), cut["more_options"]) == (50, 20)
    assert (len(whole["options"].split("|")), whole["more_options"]) == (70, 0)


def chained_table(spark, rows=1500):
    draw = random.Random(1)
    made = []
    for i in range(rows):
        a = draw.gauss(50, 10)
        b, k = 2 * a + draw.gauss(0, 3), "xyz"[int(a) % 3]
        c = 1e5 + a * 100 - b * 30 + draw.gauss(0, 50)
        gap = lambda v, p: None if draw.random() < p else v
        made.append((i, gap(round(a, 2), 0.1), gap(round(b, 2), 0.2), gap(round(c, 1), 0.15), gap(k, 0.1), draw.random()))
    return spark.createDataFrame(made, "row_id long, a double, b double, c double, k string, e double").repartition(4)


def test_chained_fills_on_matrices_equal_passes_over_rows(spark, monkeypatch):
    df = chained_table(spark)
    group = f"chained {random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    by_matrices = sorted(map(tuple, impute.fill_iterative(df, "row_id", rounds=6, tolerance=0.0).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(group + " fewer", group)
    impute.fill_iterative(df, "row_id", rounds=2, tolerance=0.0).collect()
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup(group + " fewer"))
    spark.sparkContext.setJobGroup("other", "other")
    monkeypatch.setattr(impute, "PATTERN_NUMBERS", 0)
    assert by_matrices == sorted(map(tuple, impute.fill_iterative(df, "row_id", rounds=6, tolerance=0.0).collect()))
    assert not any(None in r for r in by_matrices)
