"""Every query with SQL gives the same rows on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, rows  # noqa: E402

from tablewright.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["c20_fingerprint", "j12_gaussian_copula", "h4_model_fill_text", "g2_anomaly_flags", "m3_daily_activity_stream", "m4_batch_quality"])
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
