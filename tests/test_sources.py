"""Round trips, malformed input, registration, SQLite."""

import os
import sqlite3
import tempfile

import pytest

from tablewright.sources import tables


def frame(spark):
    return spark.createDataFrame([(1, "Ann", 30), (2, "Bob", 25), (3, "Cy", 41)], "id int, name string, age int")


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.mark.parametrize("fmt,options", [("csv", {}), ("tsv", {}), ("json", {"multi_line": False}), ("parquet", {}), ("orc", {}), ("xml", {}), ("feather", {})])
def test_round_trip(spark, fmt, options):
    path = os.path.join(folder(), f"people.{fmt}")
    tables.export_table(frame(spark), path, fmt)
    got = tables.load_table(spark, path, **options)
    assert sorted((r["id"], r["name"], r["age"]) for r in got.collect()) == [(1, "Ann", 30), (2, "Bob", 25), (3, "Cy", 41)]


def test_json_array(spark):
    path = os.path.join(folder(), "people.json")
    with open(path, "w") as f:
        f.write('[{"id": 1, "name": "Ann"}, {"id": 2, "name": "Bob"}]')
    assert tables.load_table(spark, path).count() == 2


def test_feather_overwrite(spark):
    path = os.path.join(folder(), "people.feather")
    tables.export_table(frame(spark), path, "feather")
    tables.export_table(frame(spark).limit(1), path, "feather", mode="overwrite")
    assert tables.load_table(spark, path).count() == 1


def test_errors(spark):
    with pytest.raises(ValueError):
        tables.load_table(spark, "/tmp/file.unknown")
    with pytest.raises(ValueError):
        tables.load_table(spark, "/tmp/file")
    path = os.path.join(folder(), "bad.json")
    with open(path, "w") as f:
        f.write("{not json")
    with pytest.raises(Exception):
        tables.load_table(spark, path).collect()
    with pytest.raises(ValueError):
        tables.export_table(frame(spark), path, "docx")


def test_registered_loader(spark):
    tables.register_loader(".people", lambda s, path, **o: frame(s))
    assert tables.load_table(spark, "x.people").count() == 3


def test_sqlite(spark):
    path = os.path.join(folder(), "people.db")
    tables.save_sqlite(frame(spark), path, "employees")
    assert tables.list_tables(path) == ["employees"]
    assert tables.load_table(spark, path, splits=2).count() == 3
    tables.save_sqlite(frame(spark), path, "employees", "append")
    assert tables.load_table(spark, path, table="employees").count() == 6
    tables.save_sqlite(frame(spark).limit(1), path, "employees", "replace")
    got = tables.load_table(spark, path).collect()
    assert len(got) == 1 and got[0]["name"] == "Ann"
    with pytest.raises(ValueError):
        tables.save_sqlite(frame(spark), path, "employees", "fail")
    with pytest.raises(Exception):
        tables.load_table(spark, path, table="absent").collect()
    with sqlite3.connect(path) as db:
        assert db.execute("select count(*) from employees").fetchone()[0] == 1


def test_csv_to_parquet(spark):
    base = folder()
    tables.export_table(frame(spark), os.path.join(base, "in.csv"), "csv")
    out = tables.csv_to_parquet(spark, os.path.join(base, "in.csv"), os.path.join(base, "out.parquet"), schema="id int, name string, age int")
    assert out.count() == 3
