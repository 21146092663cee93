"""Scores of texts under language models of the training documents: context-tree weighting over bytes, and a unigram base.

What the models count is gathered from all training documents: every block sends its distinct grams (and words) with their counts
to buckets. A gram bucket holds whole subtrees. A first pass builds the subtrees and sums their roots to the top of the tree (two
bytes of context at most: below 65,537 nodes); a second answers every block with its grams' log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrays import WHITE, byte_values, cut, inside_table, mix, texts, word_bounds, word_hashes
from tablewright.llm.blocks import bucket_count, bucket_of, dealt, decode, in_blocks, with_answers
from tablewright.llm.ctw import DEPTH, TOP, Subtrees, Top, grams

INSIDE = inside_table(WHITE)
VALUES = byte_values(4, lower=True)
SUBTREE = np.uint64(8 * (DEPTH + 1 - TOP))
#: The end token's place among word hashes.
END = np.uint64(0x5EED5EED5EED5EED)
SENT = "kind string, bucket bigint, block bigint, n bigint, keys binary, counts binary"


def _lowered(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


class Block:
    """Grams and words of one block of documents, and how often training rows hold them."""

    def __init__(self, body: bytes) -> None:
        self.rows = decode(body)
        self.data, self.offsets = texts(self.rows.column(1))
        self.held = self.rows.column(2).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)

    def grams(self, n: int) -> tuple:
        values, entry, row = grams(_lowered(self.data), self.offsets)
        buckets = bucket_of(mix(values >> SUBTREE), n)
        order = np.argsort(buckets, kind="stable")
        return values, entry, row, buckets, order

    def words(self, n: int) -> tuple:
        starts, ends, first = word_bounds(self.data, self.offsets, INSIDE)
        hashes = word_hashes(self.data, starts, ends, VALUES, 4)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        # every row ends with the end token
        hashes, row = np.append(hashes, np.full(len(first) - 1, END)), np.append(row, np.arange(len(first) - 1))
        values, entry = np.unique(hashes, return_inverse=True)
        buckets = bucket_of(values, n)
        return values, entry, row, buckets, np.arange(len(values))


def packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed differences, all lowest bytes first, then the next."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(body: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(body, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A bucket's distinct keys, their counts, the entry of each key sent, and how many each block sent."""
    sizes = table["n"].to_pylist()
    counts = [np.frombuffer(pa.decompress(x, 4 * n, codec="zstd"), np.uint32) for x, n in zip(table["counts"].to_pylist(), sizes, strict=True)]
    keys = np.concatenate([unpacked(x, n) for x, n in zip(table["keys"].to_pylist(), sizes, strict=True)])
    values, entry = np.unique(keys, return_inverse=True)
    return values, np.bincount(entry, np.concatenate(counts), len(values)), entry, sizes


def _answered(table: pa.Table, made: np.ndarray, sizes: list[int]) -> pa.Table:
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    bodies = [made[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"block": table["block"], "kind": table["kind"], "bucket": table["bucket"], "body": pa.array(bodies, pa.binary())})


def _gather(answers: list | None, kind: str, buckets: np.ndarray, order: np.ndarray, dtype: type) -> np.ndarray:
    """Answers of all buckets in the order of a block's keys."""
    made = np.zeros(len(buckets), dtype)
    inner = buckets[order]
    for a in answers or ():
        if a["kind"] == kind:
            lo, hi = np.searchsorted(inner, [a["bucket"], a["bucket"] + 1])
            made[order[lo:hi]] = np.frombuffer(a["body"], dtype)
    return made


def _roots(table: pa.Table) -> pa.Table:
    """Of a bucket: subtree roots summed by (last byte, decided bits) for grams; distinct and all training tokens for words."""
    values, counts, _, _ = _merged(table)
    if table["kind"][0].as_py() == "word":
        made = {"last": [-1], "node": [-1], "zeros": [float((counts > 0).sum())], "ones": [float(counts.sum())], "longer": [0.0]}
    else:
        parts = [np.stack([(k >> np.uint64(8 * TOP)).astype(float), (k & np.uint64(255)).astype(float), z, o, w], 1) for k, z, o, w in Subtrees(values, counts).roots]
        rows = np.concatenate(parts)
        key, entry = np.unique(rows[:, 0] * 256 + rows[:, 1], return_inverse=True)
        made = {"last": (key // 256).astype(int), "node": (key % 256).astype(int)}
        made |= {name: np.bincount(entry, rows[:, i], len(key)) for i, name in ((2, "zeros"), (3, "ones"), (4, "longer"))}
    return pa.table({k: pa.array(v, pa.int64() if k in ("last", "node") else pa.float64()) for k, v in made.items()})


def score(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all rows by models of those whose boolean column held_out is not true.

    A-Z count as a-z. Tokens are words `[^\\x20\\x09-\\x0D]+` and one end for each row. Returns for each input row: the id,
    held_out, n_bytes, n_tokens, n_known (tokens that training has), train_tokens, base_score (log10 of add-one unigrams) and
    score: log10 of the context-tree probability of the text's bytes and its end. bits_per_byte is its code length by byte, the
    end counted as one. NULL texts are empty: the end alone. NULL held_out is false. Repeated rows count as often as they come;
    NULL ids are kept; without training rows every estimate is even. Other columns are not read.
    """
    rows = docs.select(id_col, text_col, F.coalesce(F.col(held_out), F.lit(False)).alias("__held"))
    blocks = in_blocks(rows, text_col)
    n = bucket_count(blocks)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch["block"].to_pylist(), batch["body"], strict=True):
                block = Block(body.as_py())
                for kind, (values, entry, row, buckets, order) in (("gram", block.grams(n)), ("word", block.words(n))):
                    counts = np.bincount(entry, ~block.held[row], len(values)).astype(np.uint32)
                    names, bounds = cut(buckets[order])
                    spans = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    arrays = [
                        pa.array([kind] * len(names)),
                        pa.array(names.astype(np.int64)),
                        pa.array(np.full(len(names), number, np.int64)),
                        pa.array([len(s) for s in spans], pa.int64()),
                        pa.array([packed(values[s]) for s in spans], pa.binary()),
                        pa.array([pa.compress(counts[s].tobytes(), codec="zstd", asbytes=True) for s in spans], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["kind", "bucket", "block", "n", "keys", "counts"])

    # read twice: to sum the roots, and to answer
    pairs = dealt(blocks.mapInArrow(send, SENT), "bucket")
    roots = pairs.groupBy("kind", "bucket").applyInArrow(_roots, "last bigint, node bigint, zeros double, ones double, longer double")
    # one row for each last byte and node, whatever the corpus
    summed = roots.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "longer")]).toPandas()
    words, tree = summed[summed["last"] < 0], summed[summed["last"] >= 0]
    distinct, total = (int(words[c].sum()) for c in ("zeros", "ones"))
    top = Top(*[tree[c].to_numpy() for c in ("last", "node", "zeros", "ones", "longer")])

    def answer(table: pa.Table) -> pa.Table:
        values, counts, entry, sizes = _merged(table)
        if table["kind"][0].as_py() == "word":
            return _answered(table, counts.astype(np.uint32)[entry], sizes)
        return _answered(table, top.log10(values, Subtrees(values, counts)).astype(np.float32)[entry], sizes)

    answers = pairs.groupBy("kind", "bucket").applyInArrow(answer, "block bigint, kind string, bucket bigint, body binary")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, got in zip(batch["body"], batch["answers"], strict=True):
                yield _scored(Block(body.as_py()), got.as_py(), n, distinct, total, id_col)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return with_answers(blocks, answers=answers).mapInArrow(finish, schema)


def _scored(block: Block, answers: list, n: int, distinct: int, total: int, id_col: str) -> pa.RecordBatch:
    n_rows = block.rows.num_rows
    _, entry, row, buckets, order = block.grams(n)
    score = np.bincount(row, _gather(answers, "gram", buckets, order, np.float32)[entry], n_rows)
    _, entry, row, buckets, order = block.words(n)
    counts = _gather(answers, "word", buckets, order, np.uint32)[entry].astype(float)
    base = np.bincount(row, np.log10((counts + 1) / (total + distinct + 1)), n_rows)
    n_bytes = np.diff(block.offsets)
    arrays = [
        block.rows.column(0).combine_chunks(),
        pa.array(block.held),
        pa.array(n_bytes, pa.int64()),
        pa.array(np.bincount(row, minlength=n_rows), pa.int64()),
        pa.array(np.bincount(row, counts > 0, n_rows).astype(np.int64)),
        pa.array(np.full(n_rows, total, np.int64)),
        pa.array(base),
        pa.array(score),
        pa.array(-score / np.log10(2) / (n_bytes + 1)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[id_col, "held_out", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
