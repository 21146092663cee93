"""SQLite tables as a Spark data source, split by rowid ranges; several tasks read one file side by side."""

from __future__ import annotations

import os
import sqlite3

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 10_000


def list_tables(path: str) -> list[str]:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by rowid")]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str) -> T.DataType:
    kind = (declared or "").upper()
    if "INT" in kind:
        return T.LongType()
    if any(k in kind for k in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    if "BLOB" in kind:
        return T.BinaryType()
    return T.StringType()


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, splits: int):
        self.path, self.table, self.schema, self.splits = path, table, schema, splits

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.splits))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        names = ", ".join(_quoted(f.name) for f in self.schema)
        target = to_arrow_schema(self.schema)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            rows = db.execute(f"select {names} from {_quoted(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high))
            while block := rows.fetchmany(BATCH_ROWS):
                columns = [
                    pa.array([None if v is None else str(v) if pa.types.is_string(f.type) else v for v in values], type=f.type)
                    for f, values in zip(target, zip(*block))
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


class SqliteSource(DataSource):
    """Options: path, table (first table when absent), splits."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> str:
        tables = list_tables(self.options["path"])
        wanted = self.options.get("table")
        if wanted is None:
            if not tables:
                raise ValueError("database has no tables")
            return tables[0]
        if wanted not in tables:
            raise ValueError(f"table {wanted!r} not found")
        return wanted

    def schema(self):
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            info = db.execute(f"pragma table_info({_quoted(self._table())})").fetchall()
        return T.StructType([T.StructField(row[1], _spark_type(row[2])) for row in info])

    def reader(self, schema):
        return SqliteReader(self.options["path"], self._table(), schema, int(self.options.get("splits", "8")))
