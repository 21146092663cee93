"""Global order without a single-task sort.

Rows go to range buckets cut at approximate quantiles of the order column, each bucket is sorted on
its own, and small per-bucket totals carry state across buckets. A bucket holds about 1/n of the
rows, so no task sees the whole table. The order column must be numeric and free of NULLs; callers
with repeated values group to distinct values first, so one heavy value is one row.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.session import partitions_hint

BUCKET = "__bucket"
ORDER = "__order"


def order_value(col: Column, dtype: T.DataType) -> Column:
    """Order-preserving double: the coarse key for bucketing only."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("double")
    return col.cast("double")


def with_buckets(df: DataFrame, order_col: str, n: int | None = None) -> DataFrame:
    """Add an integer range-bucket column over the order column."""
    n = n or partitions_hint(df.sparkSession)
    keyed = df.withColumn(ORDER, order_value(F.col(order_col), df.schema[order_col].dataType))
    cuts = keyed.agg(F.percentile_approx(ORDER, [i / n for i in range(1, n)], 1000).alias("cuts")).first()["cuts"] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        return keyed.withColumn(BUCKET, F.lit(0))
    bucketed = Bucketizer(splits=splits, inputCol=ORDER, outputCol=BUCKET).transform(keyed)
    return bucketed.withColumn(BUCKET, F.col(BUCKET).cast("int"))


def prefix_sums(
    df: DataFrame, order_col: str, sums: dict[str, Column], ties: list[str] = (), partition_by: list[str] = (), n: int | None = None
) -> DataFrame:
    """Add, for every named expression, its total over all rows that come earlier in the global order."""
    names = list(sums)
    keys = list(partition_by)
    rows = with_buckets(df, order_col, n).withColumns({f"__v_{k}": v for k, v in sums.items()})
    inside = Window.partitionBy(*keys, BUCKET).orderBy(order_col, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"__l_{k}": F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in names})
    totals = rows.groupBy(*keys, BUCKET).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in names])
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"__t_{k}").over(across), F.lit(0)).alias(f"__o_{k}") for k in names]
    )
    if not keys:
        offsets = F.broadcast(offsets)  # one row per bucket: at most n rows
    joined = local.join(offsets, [*keys, BUCKET])
    result = joined.withColumns({k: F.col(f"__l_{k}") + F.col(f"__o_{k}") for k in names})
    return result.drop(BUCKET, ORDER, *[f"__{p}_{k}" for k in names for p in "vlo"])


def global_position(df: DataFrame, order_col: str, name: str = "position", ties: list[str] = ()) -> DataFrame:
    """Zero-based position in the global order."""
    return prefix_sums(df, order_col, {name: F.lit(1).cast("bigint")}, ties)


def nearest_known(df: DataFrame, order_col: str, columns: list[str], position: str | None = None) -> DataFrame:
    """Add `<c>__prev` and `<c>__next`: structs (pos, val) of the nearest non-NULL cell at or before / at or after each row.

    State carried across buckets is one struct per bucket and column.
    """
    position = position or order_col
    rows = with_buckets(df, order_col)
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(position).alias("pos"), F.col(c).alias("val"))) for c in columns}
    rows = rows.withColumns({f"__p_{c}": point[c] for c in columns})
    back = Window.partitionBy(BUCKET).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    # reversed order with a growing frame: a frame open to the end is re-read for every row
    ahead = Window.partitionBy(BUCKET).orderBy(F.desc(order_col)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"__b_{c}": F.last(f"__p_{c}", ignorenulls=True).over(back) for c in columns})
    local = local.withColumns({f"__a_{c}": F.last(f"__p_{c}", ignorenulls=True).over(ahead) for c in columns})
    edges = rows.groupBy(BUCKET).agg(
        *[F.max_by(f"__p_{c}", F.when(F.col(f"__p_{c}").isNotNull(), F.col(order_col))).alias(f"__last_{c}") for c in columns],
        *[F.min_by(f"__p_{c}", F.when(F.col(f"__p_{c}").isNotNull(), F.col(order_col))).alias(f"__first_{c}") for c in columns],
    )
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing)
    carried = edges.select(
        BUCKET,
        *[F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__cb_{c}") for c in columns],
        *[F.first(f"__first_{c}", ignorenulls=True).over(after).alias(f"__ca_{c}") for c in columns],
    )
    joined = local.join(F.broadcast(carried), BUCKET)  # one row per bucket
    joined = joined.withColumns({f"{c}__prev": F.coalesce(f"__b_{c}", f"__cb_{c}") for c in columns})
    joined = joined.withColumns({f"{c}__next": F.coalesce(f"__a_{c}", f"__ca_{c}") for c in columns})
    return joined.drop(BUCKET, ORDER, *[f"__{p}_{c}" for c in columns for p in ("p", "b", "a", "cb", "ca")])


def row_positions(df: DataFrame, value: str, row_id: str, name: str = "position") -> DataFrame:
    """Zero-based position in the order (value, row_id), safe against a value shared by most rows.

    Counts per (value, row-id range) are small; the within-value offset is a sum over at most n ranges,
    the between-value offset a prefix sum over distinct values, and only rows of one value and one
    range are sorted together.
    """
    rows = with_buckets(df, row_id).withColumnRenamed(BUCKET, "__range").drop(ORDER)
    cells = rows.groupBy(value, "__range").agg(F.count("*").alias("__n"))
    totals = prefix_sums(cells.groupBy(value).agg(F.sum("__n").alias("__n")), value, {"__before": F.col("__n")}).select(value, "__before")
    inside = Window.partitionBy(value).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(totals, value)
    local = rows.withColumn("__r", F.row_number().over(Window.partitionBy(value, "__range").orderBy(row_id)))
    joined = local.join(offsets.select(value, "__range", "__inside", "__before"), [value, "__range"])
    return joined.select(*df.columns, (F.col("__before") + F.col("__inside") + F.col("__r") - 1).alias(name))
