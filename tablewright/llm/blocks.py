"""Blocks of documents, and exchanges of their hash keys.

A block is one row that holds some megabytes of documents as a compressed Arrow batch. It is written once to the shared
folder, so block numbers stay the same when tasks run again. A block sends each bucket of the hash range the sorted, distinct
keys it has there, as one binary value; the bucket answers in the same order. So a key that a third of all rows hold is one entry
a block, what is shuffled is a few bytes a word, and no row, key or text passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrays import cut, parts, texts
from tablewright.session import checkpointed, partitions_hint, shared_folder, ship_package

BLOCK_BYTES = 4 << 20
BLOCK_SCHEMA = "block bigint, body binary"


def _encode(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def decode(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def in_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs as written blocks; the column text_col sets their size."""
    ship_package(docs.sparkSession)
    column = docs.columns.index(text_col)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = texts(batch.column(column))
            for lo, hi in parts(offsets, block_bytes):
                # taken, not sliced: a slice would be written with the whole buffers
                piece = batch.take(pa.array(np.arange(lo, hi)))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_encode(piece)], pa.binary())], names=["block", "body"])
                number += 1

    return checkpointed(docs.mapInArrow(write, BLOCK_SCHEMA))


def bucket_count(blocks: DataFrame, block_bytes: int = BLOCK_BYTES, per_bucket: int = 64 << 20) -> int:
    """Buckets of the hash range: about per_bucket bytes of text each, and several for each shuffle partition."""
    return int(max(4 * partitions_hint(blocks.sparkSession), -(-blocks.count() * block_bytes // per_bucket)))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the upper 32 bits: growing with the hash, so hashes sorted are buckets sorted."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def sent(block: int, buckets: np.ndarray, columns: dict[str, Callable[[int, int], bytes]]) -> pa.RecordBatch:
    """One row a bucket; `buckets` is sorted, each column gives the bytes of an index range."""
    names, bounds = cut(buckets)
    arrays = [pa.array(names.astype(np.int64)), pa.array(np.full(len(names), block, np.int64))]
    arrays += [pa.array([make(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for make in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", *columns])


def dealt(rows: DataFrame, column: str) -> DataFrame:
    """The rows written once, dealt to the session's shuffle width by a column: grouping by it later moves nothing."""
    spark, table = rows.sparkSession, f"dealt_{uuid4().hex}"
    n = partitions_hint(spark)
    path = f"{shared_folder(spark)}/tables/{table}"
    rows.repartition(n, column).write.bucketBy(n, column).options(compression="zstd", path=path).saveAsTable(table)
    return spark.table(table)


def with_answers(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks with the answers of all buckets as a list; a block without any has NULL."""
    for name, rows in answers.items():
        rest = [c for c in rows.columns if c != "block"]
        blocks = blocks.join(rows.groupBy("block").agg(F.collect_list(F.struct(*rest)).alias(name)), "block", "left")
    return blocks
