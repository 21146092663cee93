import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators.impute import fill_by_neighbours
from tablewright.operators.neighbours import nearest_rows


def clustered(n, d, clusters, seed):
    centres, draw = np.random.default_rng(9).normal(0, 20, (clusters, d)), np.random.default_rng(seed)
    return centres[draw.integers(0, clusters, n)] + draw.normal(0, 1, (n, d))


def table(spark, points, row_id):
    names = "abcdefgh"[: points.shape[1]]
    return spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in p)) for i, p in enumerate(points)], f"{row_id} long, " + ", ".join(f"{c} double" for c in names))


def closest(queries, points, k):
    apart = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(2))
    return {(i, int(j)) for i in range(len(queries)) for j in np.lexsort((np.arange(len(points)), apart[i]))[:k]}


def met_share(met, all_pairs):
    return sum(m.selectExpr("sum(__asked * __rows)").first()[0] or 0 for m in met) / all_pairs


@pytest.mark.parametrize("as_array", [False, True])
def test_nearest_rows_meet_few_cells(spark, as_array):
    points, asked = clustered(4000, 3, 40, 1), clustered(500, 3, 40, 2)
    points[:1300] = points[0]  # a third of all rows are one point
    candidates, queries, features, met = table(spark, points, "other"), table(spark, asked, "row"), ["a", "b", "c"], []
    if as_array:
        candidates, queries, features = candidates.select("other", F.array("a", "b", "c").alias("v")), queries.select("row", F.array("a", "b", "c").alias("v")), "v"
    got = nearest_rows(queries, candidates, "row", "other", features, 5, block_rows=150, cell_rows=100, met=met)
    assert {(r["query"], r["candidate"]) for r in got.collect()} == closest(asked, points, 5)
    assert met_share(met, len(points) * len(asked)) < 0.1
    # no group of candidates is much larger than a block
    assert all(m.selectExpr("max(__rows)").first()[0] < 300 for m in met)


def test_nearest_rows_leave_themselves_out_and_take_payload(spark):
    points = clustered(1500, 2, 20, 3)
    rows = table(spark, points, "row").withColumn("name", F.concat(F.lit("n"), "row"))
    got = nearest_rows(rows, rows.withColumnRenamed("row", "other"), "row", "other", ["a", "b"], 2, payload="name", exclude_self=True, block_rows=100, cell_rows=50).collect()
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    want = {(i, int(j)) for i in range(len(points)) for j in np.lexsort((np.arange(len(points)), apart[i]))[:2]}
    assert {(r["query"], r["candidate"]) for r in got} == want and all(r["name"] == f"n{r['candidate']}" for r in got)


def test_nearest_rows_without_enough_or_known_candidates(spark):
    points = clustered(300, 2, 3, 4)
    points[::3] = np.nan
    few = nearest_rows(table(spark, points[:40], "row"), table(spark, points, "other"), "row", "other", ["a", "b"], 250, block_rows=60, cell_rows=30)
    known = int((~np.isnan(points[:, 0])).sum())
    assert few.groupBy("query").count().where(f"count <> {known}").count() == 0 and few.select("query").distinct().count() == 26


def test_neighbour_fill_in_cells_equals_one_block(spark):
    points = np.round(clustered(2000, 4, 25, 5), 3)
    points[:700] = np.round(points[0] + np.random.default_rng(1).normal(0, 0.01, (700, 4)), 3)
    gaps = np.random.default_rng(6).random(points.shape) < 0.05
    asked, met = int(gaps.any(1).sum()), []
    points[gaps] = np.nan
    df = table(spark, points, "row")
    whole = sorted(map(tuple, fill_by_neighbours(df, "row").collect()))
    assert sorted(map(tuple, fill_by_neighbours(df, "row", block_rows=150, cell_rows=60, met=met).collect())) == whole
    assert met_share(met, len(points) * asked) < 0.25


def test_rows_that_lack_the_telling_column_do_not_meet_all_rows(spark):
    draw = np.random.default_rng(7)
    points = np.column_stack([np.round(draw.uniform(0, 1000, 4000), 2), draw.integers(0, 6, 4000), draw.integers(0, 4, 4000)]).astype(float)
    gaps = draw.random(points.shape) < [0.3, 0.02, 0.02]
    points[gaps] = np.nan
    points[:3] = [[np.nan, np.nan, 2], [np.nan, 3, np.nan], [np.nan, np.nan, np.nan]]
    asked, met = int(np.isnan(points).any(1).sum()), []
    df = table(spark, points, "row")
    whole = sorted(map(tuple, fill_by_neighbours(df, "row").collect()))
    assert sorted(map(tuple, fill_by_neighbours(df, "row", block_rows=400, cell_rows=40, met=met).collect())) == whole
    assert met_share(met, len(points) * asked) < 0.1
