"""Loading by extension, user formats, saving to databases, exporting and conversion."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.sources.arrow_files import FeatherSource
from tablewright.sources.sqlite_files import SqliteSource, list_tables

Loader = Callable[..., DataFrame]
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(FeatherSource)
    spark.dataSource.register(SqliteSource)


def _csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Header, inferred types (pass a schema to skip the inference pass). Malformed rows raise when a schema is given."""
    reader = spark.read.options(header=True, sep=sep, multiLine=False, **options)
    return reader.schema(schema).option("mode", "FAILFAST").csv(path) if schema else reader.option("inferSchema", True).csv(path)


def _tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return _csv(spark, path, sep="\t", **options)


def _json(spark: SparkSession, path: str, multi_line: bool = True, schema=None, **options) -> DataFrame:
    """A JSON array of records; set multi_line=False for one record per line, which splits inside a file."""
    reader = spark.read.options(multiLine=multi_line, mode="FAILFAST", **options)
    return (reader.schema(schema) if schema else reader).json(path)


def _parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def _orc(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).orc(path)


def _xml(spark: SparkSession, path: str, row_tag: str = "row", **options) -> DataFrame:
    return spark.read.options(rowTag=row_tag, mode="FAILFAST", **options).xml(path)


def _feather(spark: SparkSession, path: str, **options) -> DataFrame:
    register_sources(spark)
    return spark.read.format("feather").options(**options).load(path)


def _sqlite(spark: SparkSession, path: str, table: str | None = None, **options) -> DataFrame:
    register_sources(spark)
    list_tables(path)
    reader = spark.read.format("sqlite").options(path=path, **options)
    return (reader.option("table", table) if table else reader).load()


_LOADERS: dict[str, Loader] = {
    "csv": _csv, "tsv": _tsv, "txt": _csv, "json": _json, "parquet": _parquet, "orc": _orc, "xml": _xml, "feather": _feather, "arrow": _feather,
    "db": _sqlite, "sqlite": _sqlite, "sqlite3": _sqlite,
}


def register_loader(extension: str, loader: Loader) -> None:
    """Add or replace the loader of an extension: `loader(spark, path, **options) -> DataFrame`."""
    _LOADERS[extension.lower().lstrip(".")] = loader


def load_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Load by extension, or by `fmt` for directories and odd names."""
    kind = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if not kind:
        raise ValueError(f"no file extension in {path!r}")
    if kind not in _LOADERS:
        raise ValueError(f"unsupported format {kind!r}")
    return _LOADERS[kind](spark, path, **options)


def load_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, splits: int = 64,
              properties: dict[str, str] | None = None) -> DataFrame:
    """Database table; with a partition column and bounds it is read by `splits` parallel range queries."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=10000, **(properties or {}))
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=splits)
    return reader.load()


def save_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "fail", properties: dict[str, str] | None = None) -> None:
    writer = df.write.format("jdbc").options(url=url, dbtable=table, truncate=True, batchsize=10000, **(properties or {}))
    writer.mode(_mode(if_exists)).save()


def _mode(if_exists: str) -> str:
    if if_exists not in MODES:
        raise ValueError("if_exists must be replace, append or fail")
    return MODES[if_exists]


def save_sqlite(df: DataFrame, path: str, table: str, if_exists: str = "fail") -> None:
    """Write to a local SQLite file, which has a single writer: rows stream through the driver one partition at a time."""
    mode = _mode(if_exists)
    exists = os.path.exists(path) and table in list_tables(path)
    if exists and mode == "errorifexists":
        raise ValueError(f"table {table!r} exists")
    kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.BinaryType: "BLOB"}
    quoted = '"' + table.replace('"', '""') + '"'
    columns = ", ".join(f'"{f.name}" {kinds.get(type(f.dataType), "TEXT")}' for f in df.schema)
    marks = ", ".join("?" for _ in df.columns)
    plain = (int, float, str, bytes, type(None))
    with sqlite3.connect(path) as db:
        if exists and mode == "overwrite":
            db.execute(f"drop table {quoted}")
        db.execute(f"create table if not exists {quoted} ({columns})")
        block = []
        for row in df.toLocalIterator():
            block.append(tuple(v if isinstance(v, plain) else str(v) for v in row))
            if len(block) == 10_000:
                db.executemany(f"insert into {quoted} values ({marks})", block)
                block = []
        db.executemany(f"insert into {quoted} values ({marks})", block)


def export_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """Write csv, tsv, json, parquet, orc, xml or feather; a failure is raised, never replaced by another format."""
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        writer.options(header=True, sep="," if fmt == "csv" else "\t").csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    elif fmt == "orc":
        writer.orc(path)
    elif fmt == "xml":
        writer.options(rootTag="rows", rowTag="row").xml(path)
    elif fmt == "feather":
        register_sources(df.sparkSession)
        df.write.format("feather").mode("overwrite" if mode == "overwrite" else "append").save(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Out-of-core conversion; returns the Parquet table."""
    _csv(spark, source, schema=schema).write.mode(mode).parquet(target)
    return spark.read.parquet(target)
