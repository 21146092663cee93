"""The flagship run: parse, clean and score the dirty orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.numbers import parse_numbers
from tablewright.operators.impute import fill_simple
from tablewright.operators.outliers import null_outliers
from tablewright.operators.profile import quality_score
from tablewright.operators.shape import replace_tokens
from tablewright.queries.profiles import rounded
from tablewright.queries.registry import query
from tablewright.queries.views import dirty_orders
from tablewright.session import checkpointed


def repaired(df: DataFrame) -> DataFrame:
    """Numbers parsed, tokens and outliers nulled, gaps filled."""
    parsed = checkpointed(parse_numbers(replace_tokens(df), ["price_text"]))  # parsed once, read by every statistics job
    return fill_simple(null_outliers(parsed, ["price", "price_text"]), ["price", "price_text", "priority"])


def before_and_after(spark: SparkSession, folder: str) -> DataFrame:
    before = dirty_orders(spark, folder).select("row_id", "price", "price_text", "priority", "status")
    sides = [(name, quality_score(df)) for name, df in (("before", before), ("after", repaired(before)))]
    return sides[0][1].select(F.lit(sides[0][0]).alias("side"), "*").unionByName(sides[1][1].select(F.lit(sides[1][0]).alias("side"), "*"))


@query("flagship_before_and_after")
def _(spark, sf):
    return rounded(before_and_after(spark, sf))
