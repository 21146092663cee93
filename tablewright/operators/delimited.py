"""Delimited text held in a column, and row previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def text_tables(df: DataFrame, doc_id: str, text: str, separator: str | None = None) -> DataFrame:
    """(doc_id, row, cells): non-blank lines split on the sniffed separator, padded or cut to the header width.

    The separator comes from the first line: tab, pipe, comma, else space. A text of one line is its
    own row 0; otherwise row 0 is the header. No shuffle: each document is handled in its own row.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), _strip), lambda s: s != "")
    rows = df.select(doc_id, lines.alias("lines")).where(F.size("lines") > 0)
    first = F.col("lines")[0]
    if separator:
        mark = F.lit(separator)
    else:
        mark = F.when(first.contains("\t"), "\t").when(first.contains("|"), "|").when(first.contains(","), ",").otherwise(" ")
    rows = rows.withColumn("mark", mark)

    def cells(line: Column) -> Column:
        return F.split(line, F.concat(F.lit("\\Q"), F.col("mark"), F.lit("\\E")))

    rows = rows.withColumn("width", F.size(cells(F.col("lines")[0]))).select(doc_id, "mark", "width", F.posexplode("lines").alias("row", "line"))
    parts = cells(F.col("line"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(""), F.col("width"))), 1, F.col("width"))
    return rows.select(doc_id, "row", padded.alias("cells"))


def as_frame(tables: DataFrame, doc_id: str, key: object) -> DataFrame:
    """One document's table with its header row as column names."""
    one = tables.where(F.col(doc_id) == F.lit(key))
    names = one.where(F.col("row") == 0).first()["cells"]
    return one.where(F.col("row") > 0).select("row", *[F.col("cells")[i].alias(n or f"column_{i}") for i, n in enumerate(names)])


def preview(df: DataFrame, row_id: str, n: int = 500) -> DataFrame:
    """(row_id, record): the first n rows in row order as JSON objects."""
    return df.orderBy(row_id).limit(n).select(row_id, F.to_json(F.struct(*[c for c in df.columns if c != row_id]), {"ignoreNullFields": "false"}).alias("record"))
