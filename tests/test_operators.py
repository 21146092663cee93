"""Properties of the operators on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.normal import normal_cdf, normal_quantile
from tablewright.functions.numbers import parse_numbers
from tablewright.functions.text import canonical, normalize_arabic, same
from tablewright.operators import audit, corrupt, dedup, evaluate, forest, fuzzy, impute, neighbours, ordered, profile, quantiles, shape, synth
from tablewright.plans import cleaning
from tablewright.plans.policy import Policy


def test_parse_numbers_documented_forms(spark):
    cases = {
        "$1,234.50": 1234.5, "12.5%": 0.125, "1.5K": 1500.0, "2M": 2e6, "3B": 3e9, "1.2e-4": 1.2e-4, "(500)": -500.0, "($1,200.50)": -1200.5, "10-20 USD": 15.0,
        "1.5K - 3K": 2250.0, "5000 EGP": 5000.0, "-7": -7.0, "٤٢": 42.0, "Room 404": None, "ID-2039": None, "": None, "abc": None, "1.2.3": 1.23, "007": 7.0,
        "10 to 20": 15.0, "$10k-$20k": 15000.0, "€ 5 - 15 % next month": 10.0, "10-": 10.0, "3-4-5": 3.5, "1M TO 3M USD": 2e6,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r["i"]: r["t"] for r in parse_numbers(df, ["t"]).collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert (got[i] is None) == (want is None), text
        assert want is None or math.isclose(got[i], want, rel_tol=1e-12), text
    strict = {r["i"]: r["t"] for r in parse_numbers(df, ["t"], strict_compat=True).collect()}
    names = list(cases)
    assert strict[names.index("(500)")] is None and strict[names.index("1.5K - 3K")] is None


def test_parsed_column_can_be_filtered(spark):
    df = spark.range(50).select("id", F.concat(F.lit("$"), F.col("id").cast("string")).alias("t"))
    assert parse_numbers(df, ["t"]).where("t > 40").where("t is not null").count() == 9


def test_normal_functions(spark):
    xs = [-4.0, -1.5, -0.1, 0.0, 0.7, 2.3, 5.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p"), normal_quantile(normal_cdf(F.col("x"))).alias("back")).collect()
    for r in rows:
        assert abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 2e-7
        assert abs(r["x"]) > 4.5 or abs(r["back"] - r["x"]) < 1e-3


def test_arabic_and_equivalence(spark):
    df = spark.createDataFrame([("أُحْمَد  إلى مدرسة",)], "t string")
    assert df.select(normalize_arabic(F.col("t"))).first()[0] == "احمد الي مدرسه"
    pairs = [("100", "110", True), ("100", "130", False), ("05/03/2021", "2021-03-05", True), ("Cairo", "cairo ", True), ("خدمة ممتازة ٣", "خدمه ممتازه", True), (None, None, True), (None, "x", False)]
    got = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(same(canonical(F.col("a")), canonical(F.col("b"))).alias("r")).collect()
    assert [r["r"] for r in got] == [w for _, _, w in pairs]


def skewed(spark, n=3000):
    """A third of the rows share one value."""
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("v"))


@pytest.mark.parametrize("parts", [1, 16])
def test_positions_with_a_heavy_value(spark, parts):
    df = skewed(spark).repartition(parts)
    got = {r["row_id"]: r["position"] for r in ordered.row_positions(df, "v", "row_id").collect()}
    want = sorted((r["v"], r["row_id"]) for r in df.collect())
    assert [got[k] for _, k in want] == list(range(len(want)))


def test_prefix_sums_match_a_running_total(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), F.col("id").alias("x"))
    got = {r["k"]: r["before"] for r in ordered.prefix_sums(df, "k", {"before": F.col("x")}).collect()}
    total = 0
    for k, x in sorted((r["k"], r["x"]) for r in df.collect()):
        assert got[k] == total
        total += x


def test_quantiles_beyond_the_small_limit(spark):
    df = skewed(spark)
    values = sorted(r["v"] for r in df.collect())
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, {"v": probs}, small=50)["v"]
    for p in probs:
        assert math.isclose(got[p], float(np.quantile(values, p)), rel_tol=1e-9), p
    grid = quantiles.quantile_grid(df, "v", 100, small=50)
    assert np.allclose(grid, np.quantile(values, np.linspace(0, 1, 101)))


@pytest.mark.parametrize("scorer,ratio", [("levenshtein", 0.7), ("levenshtein", 0.85), ("indel", 0.8), ("indel", 0.875)])
def test_segment_join_misses_no_pair(spark, scorer, ratio):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(160)}

    def score(a, b):
        if scorer == "indel":
            return 2 * fuzzy._common_length(a, b) / (len(a) + len(b))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    want = {(a, b) for a in words for b in words if a < b and score(a, b) >= ratio}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {(r["a"], r["b"]) for r in fuzzy.similar_pairs(df, "w", ratio, scorer).collect()} == want


def test_typo_merge_prefers_the_frequent_spelling(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(["Alexandria"] * 9 + ["Alexandri", "Alexandra", "Giza", None])], "row_id int, city string")
    got = [r["city"] for r in fuzzy.merge_typos(df, "city").orderBy("row_id").collect()]
    assert got == ["Alexandria"] * 11 + ["Giza", None]


def test_duplicates_keep_the_first_row(spark):
    df = spark.createDataFrame([(i, i % 3, "x") for i in range(30)], "row_id int, k int, t string")
    assert sorted(r["row_id"] for r in dedup.drop_duplicates_first(df, "row_id").collect()) == [0, 1, 2]


def test_nearest_rows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(120, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id int, x double, y double, z double")
    near = neighbours.nearest_rows(df, df.withColumnRenamed("id", "other"), "id", "other", ["x", "y", "z"], k=4, exclude_self=True, block_rows=17)
    got = {}
    for r in near.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["candidate"]))
    for i in range(120):
        order = np.argsort(((pts - pts[i]) ** 2).sum(1))
        assert [c for _, c in sorted(got[i])] == [int(j) for j in order if j != i][:4]


def mixed_table(spark, n=150):
    rng = np.random.default_rng(7)
    x1 = rng.normal(50, 10, n)
    rows = []
    for i in range(n):
        rows.append((i, None if 10 <= i < 30 else float(x1[i]), None if 25 <= i < 45 else float(2.5 * x1[i] + rng.normal()), None if 40 <= i < 60 else "ABC"[i % 3], None if 55 <= i < 75 else int(20 + i % 40)))
    return spark.createDataFrame(rows, "row_id int, x1 double, x2 double, category string, age int")


@pytest.mark.parametrize("method", ["auto", "simple", "knn", "iterative"])
def test_imputing_leaves_no_gap_and_keeps_types(spark, method):
    df = mixed_table(spark)
    out = impute.advanced_impute(df, "row_id", method)
    assert dict(out.dtypes) == dict(df.dtypes) and out.count() == 150
    assert all(out.where(F.col(c).isNull()).count() == 0 for c in out.columns)
    assert {r[0] for r in out.select("category").distinct().collect()} <= {"A", "B", "C"}


def test_iterative_fill_follows_the_linear_relation(spark):
    out = impute.fill_iterative(mixed_table(spark), "row_id")
    errors = out.where("row_id between 10 and 24").select(F.abs(F.col("x2") - 2.5 * F.col("x1")).alias("e")).agg(F.avg("e")).first()[0]
    assert errors < 5


def test_model_fill(spark):
    df = mixed_table(spark)
    assert impute.fill_by_model(df, "x2", "row_id", iterations=5).where("x2 is null").count() == 0
    assert impute.fill_by_model(df, "category", "row_id").where("category is null").count() == 0


def test_ordered_fill_across_buckets(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), F.when(F.col("id").isin(5, 35), F.col("id").cast("double")).alias("v"))
    got = [r["v"] for r in impute.fill_ordered(df, "row_id", ["v"]).orderBy("row_id").collect()]
    assert got == [5.0] * 5 + [float(i) for i in range(5, 36)] + [35.0] * 4


def test_anomaly_share(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 40, 100.0).otherwise((F.col("id") % 10).cast("double")).alias("a"), F.when(F.col("id") < 40, -90.0).otherwise((F.col("id") % 7).cast("double")).alias("b"))
    out = forest.anomaly_flags(df, "row_id", ["a", "b"], trees=30)
    flagged = {r["row_id"] for r in out.where("is_anomaly = 1").collect()}
    assert set(range(40)) <= flagged and len(flagged) <= 140


def test_exact_selection(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    for n in (0, 1, 137, 1000):
        assert df.where(corrupt.exactly(df, "row_id", n, 3)).count() == n


def test_corruption_rates_and_errors(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("v"), F.lit("word").alias("t"))
    assert corrupt.apply_rule(df, "row_id", corrupt.Rule("v", "missing", 10)).where("v is null").count() == 100
    with pytest.raises(ValueError):
        corrupt.apply_rule(df, "row_id", corrupt.Rule("t", "outliers", 10))
    with pytest.raises(ValueError):
        corrupt.apply_rule(df, "row_id", corrupt.Rule("nope", "missing", 10))


def test_copula_keeps_dependence_and_marginals(spark):
    rng = np.random.default_rng(3)
    a = rng.gamma(2.0, 2.0, 2000)
    b = 3 * a + rng.normal(0, 1, 2000)
    df = spark.createDataFrame([(i, float(x), float(y), "uv"[i % 2]) for i, (x, y) in enumerate(zip(a, b))], "row_id bigint, a double, b double, c string")
    out = synth.fit_copula(df, "row_id").sample(spark.range(2000).withColumnRenamed("id", "row_id"), "row_id")
    assert abs(out.agg(F.corr("a", "b")).first()[0] - float(np.corrcoef(a, b)[0, 1])) < 0.08
    report = {r["column"]: r["fidelity_score"] for r in synth.fidelity_report(df, out, {"a": "numerical", "b": "numerical", "c": "categorical"}).collect()}
    assert min(report.values()) > 90


def test_closest_records_sample_and_full_agree(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") * 13 % 61).cast("double").alias("x"), (F.col("id") * 7 % 59).cast("double").alias("y"))
    moved = df.withColumn("x", F.col("x") + 0.5)
    a = {r["row_id"]: r["dcr"] for r in synth.closest_records(df, moved, "row_id", ["x", "y"]).collect()}
    b = {r["row_id"]: r["dcr"] for r in synth.closest_records(df, moved, "row_id", ["x", "y"], sample_size=None).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_split_sizes_per_class(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 < 3).cast("int").alias("label"))
    out = evaluate.stratified_split(df, "row_id", "label")
    got = {(r["label"], r["is_test"]): r["count"] for r in out.groupBy("label", "is_test").count().collect()}
    assert got == {(0, False): 560, (0, True): 140, (1, False): 240, (1, True): 60}


def test_fingerprint_ignores_order(spark):
    df = spark.range(200).select("id", (F.col("id") * 3).alias("x"))
    assert not profile.is_mutated(df, df.repartition(7).orderBy(F.desc("id")))
    assert profile.is_mutated(df, df.withColumn("x", F.col("x") + (F.col("id") == 5).cast("int")))


def test_schema_alignment_errors(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(ValueError):
        shape.align_schema(df, df.schema, required=["z"])
    assert shape.sanitize_columns(df.toDF("1 a", "a-b")).columns == ["feat_1_a", "a_b"]


def test_tiered_cleaning(spark):
    rows = [(0, 25.0, "Cairo", "2023-01-01", "5000"), (1, 25.0, "Cairo", "2023-01-01", "5000"), (2, None, "Giza", "2023-01-02", "6000"), (3, 200.0, "Cairo", "2023-01-03", "7000"),
            (4, 30.0, None, "2023-01-05", "8000"), (5, 28.0, "Cairo", "2023-01-04", "5500"), (6, 28.0, "Cairo", "2023-01-04", "5500")]
    df = spark.createDataFrame(rows, "row_id int, age double, city string, joined_date string, salary string")
    out = cleaning.fast_clean(df, "row_id")
    assert out.count() == 5
    assert dict(out.dtypes)["salary"] == "double" and "joined_date_is_weekend" in out.columns
    assert out.where("age is null or city is null").count() == 0


def test_policy():
    policy = Policy()
    assert not policy.allows("drop", "account_number") and not policy.allows("fuzzy_fix", "user_id")
    assert policy.allows("smart_impute", "age")
    policy.check_deletion(10, 100)
    assert len(policy.blocked) == 2 and policy.confidence() == 25.0


def people(spark, n=1200):
    truth = synth.ground_truth(spark.range(n).withColumnRenamed("id", "row_id"), "row_id")
    corrupted, injected = corrupt.corrupt_people(truth, "row_id")
    return truth, corrupted, injected


def test_corrupt_clean_score_loop(spark):
    """Recovery at least as good as the published floors."""
    truth, corrupted, injected = people(spark, 6000)  # floors are shares: enough rows that chance moves them little
    plan = cleaning.CleaningPlan({"age": "smart_impute", "salary": "remove_outliers", "join_date": "standardize_date", "city": "fuzzy_fix"}, model_fill=False)
    cleaned = cleaning.execute(corrupted, "row_id", plan).table
    scores = audit.recovery_metrics(truth, corrupted, cleaned, "row_id", arabic=["arabic_feedback"]).first()
    assert scores["exact_match_accuracy"] >= 42.62 and scores["over_cleaning_rate"] <= 1.0
    groups = {"currency": (["salary_currency_noise"], ["salary"]), "arabic": (["arabic_num_corrupted"], ["arabic_feedback"]), "dates": (["join_date_corrupted"], ["join_date"])}
    kinds = {r["group"]: r["recovered_pct"] for r in audit.recovery_by_kind(truth, cleaned, injected, "row_id", groups, arabic=["arabic_feedback"]).collect()}
    assert kinds["currency"] >= 95 and kinds["arabic"] == 100
    assert kinds["dates"] >= 50


def test_draws_do_not_repeat_and_seeds_are_independent(spark):
    from tablewright.functions.hashing import unit

    drawn = spark.range(1_100_000).select("id", *[unit(F.col("id"), s).alias(f"u{s}") for s in (1, 2)])
    row = drawn.agg(F.count_distinct("u1", "u2").alias("n"), F.corr("u1", "u2").alias("r"), F.corr("id", "u1").alias("k"), F.avg("u1").alias("m")).first()
    assert row["n"] == 1_100_000 and abs(row["r"]) < 0.005 and abs(row["k"]) < 0.005 and abs(row["m"] - 0.5) < 0.002


def test_merging_has_no_limit_on_spellings(spark):
    draw = random.Random(4)
    names = ["alexandria", "casablanca", "mansoura city", "port said", "luxor temple"]
    rows = []
    for i in range(1500):
        word = list(names[i % 5])
        for _ in range(i % 3):
            word[draw.randrange(len(word))] = draw.choice("abcdexyz")
        rows.append((i, "".join(word)))
    table = spark.createDataFrame(rows, "row_id long, city string")
    assert table.select("city").distinct().count() > 500
    found = fuzzy.typo_map(table, "city")
    right, wrong = ({r[0] for r in found.select(c).collect()} for c in ("right", "wrong"))
    assert not right & wrong and len(wrong) > 100  # what absorbs is never absorbed
    assert fuzzy.typo_map(table, "city", max_values=500).count() == 0


def test_model_choice_does_not_depend_on_size(spark):
    import inspect

    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    from tablewright.operators import models

    assert "SVM" in models.families("binary") and "rows" not in inspect.signature(models.families).parameters
    assert inspect.signature(models.train_baselines).parameters["folds"].default == 5
    # rows beyond the 300 that were once read decide: only a tenth of the labels is 1
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("double").alias("label"))
    rows = rows.withColumn("features", array_to_vector(F.array("label", F.lit(1.0))))
    model = DecisionTreeClassifier(maxDepth=2).fit(rows)
    read = []
    kept, models._score = models._score, lambda model, frame, task: read.append(frame.count()) or kept(model, frame, task)
    try:
        got = {r["feature"]: r["importance"] for r in models.permutation_importance(model, rows, "row_id", ["own", "same"], "binary").collect()}
    finally:
        models._score = kept
    assert set(read) == {1000}
    assert got["own"] > 0.1 and got["same"] == 0
