"""Token ids as Parquet list columns.

Rows are range-partitioned and sorted by id, so files follow each other in id order, row groups and pages hold narrow id ranges
(page indexes are written by default) and a reader of some ids, or of the numbers alone, skips the rest. Token ids are dictionary
encoded: at most 16 bits a token before compression for vocabularies up to 65,536.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.arrays import parts, texts
from tablewright.llm.tokenizing import encoder
from tablewright.session import ship_package

#: Writer options: row groups and pages of bounded size, dictionary pages large enough for a whole vocabulary.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "20000", "parquet.dictionary.page.size": str(2 << 20), "parquet.enable.dictionary": "true", "compression": "zstd"}
SLICE_BYTES = 4 << 20


def lists(values: bytes, lengths: np.ndarray) -> pa.ListArray:
    """List column from little-endian 32-bit ids laid end to end."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(values, "<u4").astype(np.int32)))


def encoded(batch: pa.RecordBatch, text_at: int, tokenizer: str, end_id: int, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a batch with the ids of every row, the end id included."""
    own, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
    data, offsets = texts(batch.column(text_at))
    for lo, hi in parts(offsets, slice_bytes):
        yield lo, hi, [ids + end for ids in own.encode_rows(data, offsets[lo : hi + 1])]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write rows in ascending id order.

    Columns: the id, part and part_start (ids of the rows before it in its part), n_tokens, ids. NULL text is empty: its row holds
    the end id alone. NULL ids come first; rows of one id follow the order of their texts; repeated rows are written as often as
    they come. An empty table gives an empty folder of files with this schema. Other columns are not read.
    """
    ship_package(docs.sparkSession)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, rows in encoded(batch, 1, tokenizer, end_id):
                lengths = np.array([len(r) // 4 for r in rows], np.int64)
                starts = start + np.concatenate(([0], np.cumsum(lengths)))
                start = int(starts[-1])
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part)), pa.array(starts[:-1]), pa.array(lengths), lists(b"".join(rows), lengths)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "part", "part_start", "n_tokens", "ids"])

    rows = docs.select(id_col, text_col)
    # the text's hash keeps a much repeated id from filling one partition
    rows = rows.repartitionByRange(F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(F.col(id_col), F.xxhash64(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    rows.mapInArrow(encode, f"`{id_col}` {kind}, part bigint, part_start bigint, n_tokens bigint, ids array<int>").write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files with `start`: the number of ids of all rows before. Columns not asked for are not read."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a part: as many as the writing job had tasks
    offsets = totals.select("part", before.alias("__before"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("part_start") + F.col("__before")).drop("part", "part_start", "__before")


def with_crc(rows: DataFrame, ids_col: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """Replace a list column of ids by the unsigned crc32 of its ids as little-endian unsigned 32-bit integers."""
    rows = rows.select(*[c for c in rows.columns if c != ids_col], ids_col)
    ship_package(rows.sparkSession)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            offsets = ids.offsets.to_numpy()
            made = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.int64())], names=[*batch.schema.names[:-1], name])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(sums, ", ".join([*kinds, f"`{name}` bigint"]))
