"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation, connected components.

A signature has GROUPS * WIDTH minima of 16 bits. The join splits it into GROUPS chunks. Two signatures that differ in at most
2 * GROUPS - 1 places have a chunk with one error at most (pigeonhole), so every chunk is indexed under each of its versions with
one place left out: all pairs within that distance share a key. Beyond it a pair at similarity 0.8 still shares a key unless all
ten chunks have two errors: probability 2e-6.

Equal sets are one node from the start. In a key's list every node is first compared with a few centres only, which links groups
of any size by a few pairs a member; then nodes of one list that are still in different components are compared with each other.
So no link between components is lost, and members of one component are not paired. Sizes (an exact filter) and signatures are
compared before sets are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrays import WHITE, byte_values, inside_table, mix, parts, texts, valid_starts, window_hashes, word_bounds, word_hashes
from tablewright.session import checkpointed, ship_package

GROUPS, WIDTH = 10, 5
PLACES = GROUPS * WIDTH
#: Pairs whose signatures differ in more places, seen by four bits of each, are no candidates. At similarity 0.8 that many places
#: differ with probability 6e-7, above it still less often.
FURTHEST = 24
#: Centres of a key's list: the smallest node of each of that many parts.
CENTRES = 8
#: Ids up to this number are sent to all tasks instead of shuffling the texts: 16 MB.
SENT_IDS = 1_000_000
INSIDE = inside_table(WHITE)
VALUES = byte_values(6, lower=True)
SLICE_BYTES = 2 << 20
FACTORS = (mix(np.arange(1, PLACES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
NIBBLES = 0x1111111111111111


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Of every row: the sorted distinct hashes of its `size`-word shingles; of a shorter row, its whole sequence."""
    starts, ends, first = word_bounds(data, offsets, INSIDE)
    hashes = word_hashes(data, starts, ends, VALUES, 6)
    at = valid_starts(first, size)
    values = window_hashes(hashes, size, 6)[at]
    bounds = np.searchsorted(at, first)
    made = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for i in np.flatnonzero((np.diff(first) < size) & (np.diff(first) > 0)):
        own = hashes[first[i] : first[i + 1]]
        made[i] = window_hashes(own, len(own), 6)
    return made


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit minima for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    made = np.zeros((len(sets), PLACES), np.uint16)
    if not sizes.sum():
        return made
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(sizes)
    heads = (np.cumsum(sizes) - sizes)[full]
    for k, factor in enumerate(FACTORS):
        low = np.minimum.reduceat(values * factor, heads)
        made[full, k] = mix(low.astype(np.uint64)) >> np.uint64(48)
    return made


def keys(signature: np.ndarray) -> np.ndarray:
    """Index keys of signatures (rows): every chunk with one place left out."""
    chunks = signature.reshape(len(signature), GROUPS, WIDTH).astype(np.uint64)
    made = []
    for left_out in range(WIDTH):
        key = np.broadcast_to(np.arange(GROUPS, dtype=np.uint64)[None, :] * np.uint64(WIDTH) + np.uint64(left_out + 1), chunks.shape[:2])
        for k in range(WIDTH):
            if k != left_out:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ chunks[:, :, k])
        made.append(key)
    return np.concatenate(made, 1).view(np.int64)


def _described(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Of every row: n_shingles, a 128-bit sum of its set, and its signature, also as four-bit places in four numbers."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in parts(offsets, SLICE_BYTES):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                signed = signatures(sets)
                short = np.zeros((hi - lo, 64), np.uint64)
                short[:, :PLACES] = signed & 15
                short = (short.reshape(-1, 4, 16) << (4 * np.arange(16, dtype=np.uint64))).sum(2, dtype=np.uint64).view(np.int64)
                with np.errstate(over="ignore"):
                    sums = [np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for c in (0, 0xA5A5A5A5A5A5A5A5)]
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums)]
                arrays += [pa.array([r.tobytes() for r in signed], pa.binary()), *(pa.array(short[:, k]) for k in range(4))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_shingles", "sum_a", "sum_b", "signature", "s0", "s1", "s2", "s3"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_shingles bigint, sum_a bigint, sum_b bigint, signature binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(describe, schema)


def _indexed(nodes: DataFrame, kind: str) -> DataFrame:
    """(key, node) for every index key of every node."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, PLACES)
            made = keys(signed)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(made)), made.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), ids], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(index, f"key bigint, node {kind}")


def _near(a: str, b: str, percent: int) -> F.Column:
    """Whether sizes allow the similarity, and signatures differ in few enough places, by four bits of each."""
    total = F.lit(0)
    for k in range(4):
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(NIBBLES)))
    sizes = [F.col(f"{x}.n_shingles") for x in (a, b)]
    return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & (total <= FURTHEST)


def _sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The whole sets of the documents in nodes, written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in parts(offsets, SLICE_BYTES):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "body"])

    wanted = F.broadcast(nodes) if nodes.count() <= SENT_IDS else nodes
    return checkpointed(docs.select(F.col(id_col).alias("node"), text_col).join(wanted, "node", "left_semi").mapInArrow(gather, f"node {kind}, body binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar."""
    kind = sets.schema["node"].dataType.simpleString()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node reachable. Labels pass on and jump until they rest."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).withColumn("component", F.least("node", "component")))
    while True:
        passed = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("passed"))
        lower = labels.join(passed, "node").select("node", F.least("component", "passed").alias("lower"), "component")
        # a label's own label, so that long chains halve
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("jumped"))
        moved = lower.join(jump, "lower", "left").select("node", F.least("lower", "jumped").alias("component"), (F.least("lower", "jumped") != F.col("component")).alias("moved"))
        labels = checkpointed(moved)
        if not labels.where("moved").head(1):
            return labels.select("node", "component")
        labels = labels.drop("moved")


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union, and number the components.

    A-Z count as a-z; words are `[^\\x20\\x09-\\x0D]+`; a set holds the distinct shingles of `size` words, the whole sequence of a
    document with fewer, nothing of one without words. Returns one row for each input row: the id, n_shingles, component_id (the
    smallest id reachable, its own included) and kept (whether it is that id).

    NULL texts are empty; empty sets link with nothing. Rows of one id are one document: they share a component. Rows with a NULL
    id are not linked: their component is NULL and they are kept. An empty table gives no rows. Other columns are not read.
    Candidates are certain up to 2 * GROUPS - 1 differing places of PLACES and at `percent` of 80 or more missed with probability
    2e-6; a smaller percent is refused.
    """
    if percent < 80:
        raise ValueError("signatures are laid out for similarities of 80 percent and more")
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    described = checkpointed(_described(docs, id_col, text_col, size))
    linked = described.where("id is not null and n_shingles > 0")
    nodes = linked.groupBy("sum_a", "sum_b", "n_shingles", "signature", "s0", "s1", "s2", "s3").agg(F.min("id").alias("node"))
    nodes = checkpointed(nodes)
    # ids with several texts join all their classes
    same = linked.groupBy("id").agg(F.min("sum_a").alias("lo"), F.max("sum_a").alias("hi")).where("lo <> hi").select("id")
    held = linked.join(same, "id", "left_semi").join(nodes.select("sum_a", "sum_b", "node"), ["sum_a", "sum_b"]).where("id <> node")
    several = held.select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()

    index = _indexed(nodes, kind)
    lists = index.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    short = nodes.select("node", "n_shingles", "s0", "s1", "s2", "s3")
    shared = checkpointed(index.join(lists, "key", "left_semi").join(short, "node"))
    sets = _sets(shared.select("node").distinct(), docs, id_col, text_col, size)
    centres = shared.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(CENTRES)).alias("part")).agg(F.min("node").alias("a")).select("key", "a")
    pairs = shared.select("key", F.col("node").alias("b")).join(centres, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first, second = short.withColumnRenamed("node", "a").alias("x"), short.withColumnRenamed("node", "b").alias("y")
    pairs = checkpointed(pairs.join(first, "a").join(second, "b").where(_near("x", "y", percent)).select("a", "b").distinct())
    edges = checkpointed(_confirmed(pairs, sets, percent).union(several))
    one = components(edges)

    # lists whose nodes are not all linked yet
    labelled = shared.join(one, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_lists = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left = labelled.join(open_lists, "key", "left_semi")
    x, y = left.alias("x"), left.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & _near("x", "y", percent))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = checkpointed(_confirmed(checkpointed(rest), sets, percent))
    bridges = more.join(one.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(one.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    two = components(bridges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))

    placed = nodes.select("sum_a", "sum_b", "node").join(one, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.join(two.select(F.col("component").alias("final"), F.col("node").alias("component")), "component", "left")
    placed = placed.select("sum_a", "sum_b", F.coalesce("final", "component").alias("component_id"))
    rows = described.join(placed, ["sum_a", "sum_b"], "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
