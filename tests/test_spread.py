"""Costly steps are dealt over all cores and read written tables, whatever the number of files."""

from pyspark.sql import functions as F

from tablewright.operators import synth
from tablewright.plans.cleaning import fast_clean


def test_copula_of_one_partition_is_made_on_all_cores(spark):
    df = spark.range(300).coalesce(1).select(F.col("id").alias("row_id"), (F.col("id") * 7 % 31).cast("double").alias("a"), F.concat(F.lit("s"), F.col("id") % 3).alias("b"))
    model = synth.fit_copula(df, "row_id")
    made = model.sample(df.select("row_id"), "row_id")
    numbers = synth.CopulaModel(["a"], model.kinds, model.grids, {}, model.mean[:1], model.cov[:1, :1]).sample(df.select("row_id"), "row_id")
    assert numbers.rdd.getNumPartitions() > 1
    assert made.count() == 300 and made.where("a is null or b is null").count() == 0
    assert synth.generate_independent(df.select("row_id"), "row_id", df, {"a": {"type": "numerical", "mean": 1.0, "std": 2.0, "min": 0.0, "max": 9.0, "is_int": False, "null_pct": 0.0}}).rdd.getNumPartitions() > 1


def test_fast_clean_does_not_read_its_source_again(spark, tmp_path):
    rows = [(i % 40, f"{i % 40}.5" if i % 40 != 7 else None, f"2024-01-{i % 28 + 1:02d}") for i in range(60)]
    spark.createDataFrame(rows, "row_id long, amount string, date_text string").write.parquet(str(tmp_path / "t"))
    cleaned = fast_clean(spark.read.parquet(str(tmp_path / "t")), "row_id")
    assert not [f for f in cleaned.inputFiles() if str(tmp_path) in f]
    assert cleaned.where("amount is null or date_text is null").count() == 0
