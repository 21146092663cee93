"""Target-distribution importance resampling: documents drawn by how much likelier their hashed features are in a target.

Features are runs of words; their buckets come from crc.py. Each task of the first pass sums its buckets and sends one row for each
of them at most; the gains (one number a bucket) go to all tasks of the second pass. Documents are drawn without replacement by
adding keyed Gumbel noise to their weights and taking the highest sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.arrays import inside_table, parts, texts, valid_starts, word_bounds
from tablewright.llm.crc import crc32_of_spans
from tablewright.session import checkpointed, ship_package

SLICE_BYTES = 1 << 20
#: Sent to all tasks: a number for each bucket, so there may not be more than this many.
MOST_BUCKETS = 1 << 20
#: ASCII that is no lower-case letter or digit; every other character belongs to words.
BETWEEN = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
NAMES = ("n_words", "n_features", "weight", "score", "rank")


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and their bounds there."""
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(int(first[-1]), 0x20, np.uint8)
    before = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    within = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    out[np.repeat(first[:-1], sizes) + within] = data[np.repeat(starts, sizes) + within]
    return out, first[:-1], first[:-1] + sizes


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of every row, and for each length of run: the buckets of all runs in order, and the first run of every row."""
    lowered = np.arange(256, dtype=np.uint8)
    lowered[65:91] += 32
    data = lowered[data]
    starts, ends, first = word_bounds(data, offsets, inside_table(BETWEEN))
    if longest > 1:
        data, starts, ends = _joined(data, starts, ends)
    made = []
    for n in range(1, longest + 1):
        at = valid_starts(first, n)
        runs = np.maximum(np.diff(first) - n + 1, 0)
        made.append((crc32_of_spans(data, starts[at], ends[at + n - 1]) % np.uint32(buckets), np.concatenate(([0], np.cumsum(runs)))))
    return np.diff(first), made


def _counted(rows: DataFrame, name: str, other: str, longest: int, buckets: int) -> DataFrame:
    """Features of a text column in every bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for lo, hi in parts(offsets, SLICE_BYTES):
                for found, _ in features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], longest, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held]), pa.array(np.zeros(len(held), np.int64))], names=["bucket", name, other])

    return rows.mapInArrow(count, f"bucket bigint, {name} bigint, {other} bigint")


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int, text_col: str, target_col: str) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of every bucket in the target over its share in docs."""
    both = _counted(docs.select(text_col), "s", "t", longest, buckets).unionByName(_counted(target.select(target_col), "t", "s", longest, buckets))
    ours, theirs = np.zeros(buckets), np.zeros(buckets)
    # one row a bucket
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toLocalIterator():
        ours[r["bucket"]], theirs[r["bucket"]] = r["s"], r["t"]
    ratio = (theirs + 1) * (ours.sum() + buckets) / ((ours + 1) * (theirs.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(id_col: str, seed: int) -> Column:
    """Keyed Gumbel noise in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Draw share[0] of share[1] of the documents with at least least_words words, those like the target with higher chance.

    Columns: the id, n_words, n_features (runs of 1 to `longest` words, repeats counted), weight (the floored mean of the gains of
    its features in thousandths of a natural logarithm, 0 without any), score (weight plus noise keyed by the id), rank (1 is the
    highest score, ties to smaller ids; NULL if not drawn). One row for every row of docs, whole texts, all counts over all rows.

    NULL and empty texts have no words: weight 0, never drawn unless least_words is 0. Rows without an id draw with an empty id
    and come after others of the same score; repeated rows take places of their own, in any order among equals. An empty target
    leaves smoothing alone; an empty table gives no rows. Other columns are not read. The id column may not be called as one of
    the columns returned.
    """
    if id_col in NAMES or not 0 < buckets <= MOST_BUCKETS or longest < 1:
        raise ValueError(f"the id may not be one of {NAMES}, buckets are 1 to {MOST_BUCKETS}, runs have one word at least")
    ship_package(docs.sparkSession)
    gain = gains(docs, target, longest, buckets, text_col, target_col)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in parts(offsets, SLICE_BYTES):
                words, made = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], longest, buckets)
                count, total = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for found, first in made:
                    sums = np.concatenate(([0], np.cumsum(gain[found])))
                    total += np.diff(sums[first])
                    count += np.diff(first)
                weight = total // np.maximum(count, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(count), pa.array(weight)], names=[id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    weighed = docs.select(id_col, text_col).mapInArrow(weigh, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint")
    # numbered where written, so that many equal rows are dealt to many ranges
    scored = checkpointed(weighed.withColumn("score", F.col("weight") + noise(id_col, seed)).withColumn("__row", F.monotonically_increasing_id()))
    order = [F.desc("score"), F.asc_nulls_last(f"`{id_col}`"), F.asc("__row")]
    can = F.col("n_words") >= least_words
    ranged = scored.where(can).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.drop("__row").withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    drawn = F.floor(F.sum("__n").over(Window.partitionBy()) * share[0] / share[1])
    # one row a range
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), drawn.alias("__drawn"))
    rank = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("rank", F.when(rank <= F.col("__drawn"), rank))
    columns = [F.col(f"`{id_col}`"), *NAMES]
    return ranked.select(*columns).union(scored.where(~can).withColumn("rank", F.lit(None).cast("bigint")).select(*columns))
