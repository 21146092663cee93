"""Packing by power-of-two decomposition: every piece of a document is a whole sequence of 2**k tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.tokenfiles import LAYOUT, encoded, lists
from tablewright.session import shared_folder, ship_package


def piece_lengths(n: int, longest: int) -> list[int]:
    """Pieces of a document of n tokens: full sequences, then the binary digits of the rest from the highest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str | None, tokenizer: str, end_id: int, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         slice_bytes: int = 8 << 20) -> DataFrame:
    """Sequences of tokens, none of which holds two documents or any padding.

    Every whole text is encoded and end_id appended; a document of n tokens becomes n // longest pieces of `longest` tokens (a
    power of two) and one piece for each binary digit of the rest. Pieces of equal length form a bucket: sequence numbers run
    through the shortest bucket first, so a bucket is one range of numbers, from which batches of one length are drawn.

    The sequences are written to `path` (a new folder below the shared one if None) and read back. Columns: the id, start, length,
    ids, doc_tokens, sequence_id, offset (always 0). NULL text is empty: one piece with the end id. NULL ids are kept; repeated
    rows are packed as often as they come; an empty table gives no rows. Other columns are not read. slice_bytes: text that a worker
    encodes at a time; larger slices ask for fewer parts and take more memory.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark = docs.sparkSession
    ship_package(spark)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for lo, _, rows in encoded(batch, 1, tokenizer, end_id, slice_bytes):
                doc, start, length, total, number = [], [], [], [], []
                for i, ids in enumerate(rows):
                    at = 0
                    for n in piece_lengths(len(ids) // 4, longest):
                        doc.append(lo + i)
                        start.append(at)
                        length.append(n)
                        total.append(len(ids) // 4)
                        number.append(seen.get(n, 0))
                        seen[n] = number[-1] + 1
                        at += n
                arrays = [batch.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(number, pa.int64()), lists(b"".join(rows), np.array(length))]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "doc_tokens", "part", "number", "ids"])

    path = path or _new_folder(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, doc_tokens bigint, part bigint, number bigint, ids array<int>"
    docs.select(id_col, text_col).mapInArrow(cut, schema).write.options(**LAYOUT).parquet(path)
    rows = spark.read.parquet(path)
    totals = rows.groupBy("length", "part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("length", "part").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each length and task of the writing job
    offsets = totals.select("length", "part", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = rows.join(F.broadcast(offsets), ["length", "part"])
    return joined.select(id_col, "start", "length", "ids", "doc_tokens", (F.col("__before") + F.col("number")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def _new_folder(docs: DataFrame) -> str:
    from uuid import uuid4

    return f"{shared_folder(docs.sparkSession)}/sequences/{uuid4().hex}"
