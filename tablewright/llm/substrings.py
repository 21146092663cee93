"""Removal of repeated word runs (fixed-block anchors).

Every row is cut into non-overlapping reference blocks of (window + 1) // 2 words. Any run of `window` words holds a whole
reference block, so two equal runs meet when every rolling window of block length is looked up among the reference blocks. Hits
are extended to all runs of `window` words around them; the runs' 128-bit hashes are counted over all rows, and repeated runs that
touch or overlap merge to maximal repeats.

Both look-ups send sorted distinct hashes a block of documents (see blocks.py): 32 bits a word for the anchors, 128 bits for the
few runs around hits. Equality is decided on 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.arrays import WHITE, bits, byte_values, inside_table, texts, unbits, valid_starts, window_hashes, word_bounds, word_hashes
from tablewright.llm.blocks import bucket_count, bucket_of, decode, in_blocks, sent, with_answers

ANSWER = "block bigint, bucket bigint, hits binary"
INSIDE = inside_table(WHITE)
LOW = np.uint64(0xFFFFFFFF)


class Words:
    """The words of one block of documents."""

    def __init__(self, body: bytes, text_at: int) -> None:
        self.rows = decode(body)
        self.data, offsets = texts(self.rows.column(text_at))
        self.starts, self.ends, self.first = word_bounds(self.data, offsets, INSIDE)

    def hashes(self, seed: int) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, byte_values(seed), seed)


def _anchors(words: Words, anchor: int, n: int) -> tuple:
    """Distinct rolling hashes of a block in order: position's entry, hash, bucket, seen twice, is a reference block."""
    at = valid_starts(words.first, anchor)
    values = window_hashes(words.hashes(0), anchor)[at]
    values, entry, counts = np.unique(values, return_inverse=True, return_counts=True)
    row_start = np.repeat(words.first[:-1], np.diff(words.first))[at]
    reference = np.zeros(len(values), bool)
    reference[entry[(at - row_start) % anchor == 0]] = True
    return at, entry, values, bucket_of(values, n), counts > 1, reference


def _runs(words: Words, window: int, anchor: int, n: int, answers: list | None) -> tuple:
    """Runs around anchor hits: their positions, entries, distinct 128-bit hashes in order, buckets, seen twice."""
    at, entry, values, buckets, _, _ = _anchors(words, anchor, n)
    hit = np.zeros(len(values), bool)
    for a in answers or ():
        lo, hi = np.searchsorted(buckets, [a["bucket"], a["bucket"] + 1])
        hit[lo:hi] = unbits(a["hits"], hi - lo)
    seeds = np.zeros(words.first[-1] + 1, np.int64)
    seeds[at[hit[entry]] + 1] = 1
    seeds = np.cumsum(seeds)
    starts = valid_starts(words.first, window)
    starts = starts[seeds[starts + window - anchor + 1] > seeds[starts]]
    if not len(starts):
        return starts, np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    first, second = (window_hashes(words.hashes(seed), window, seed)[starts] for seed in (1, 2))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    keys = np.stack([first[new], second[new]], 1)
    return starts, entry, keys, bucket_of(keys[:, 0], n), np.bincount(entry) > 1


def _answer(table: pa.Table, hit: np.ndarray, sizes: list[int]) -> pa.Table:
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    rows = [(b, k, bits(hit[lo:hi])) for b, k, lo, hi in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), bounds[:-1], bounds[1:], strict=True) if hit[lo:hi].any()]
    made = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({"block": pa.array(made[0], pa.int64()), "bucket": pa.array(made[1], pa.int64()), "hits": pa.array(made[2], pa.binary())})


def _flags(table: pa.Table, name: str, sizes: list[int]) -> np.ndarray:
    return np.concatenate([unbits(x, n) for x, n in zip(table[name].to_pylist(), sizes, strict=True)])


def _match_anchors(table: pa.Table) -> pa.Table:
    """Keys that occur at two positions, one of them a reference block."""
    bodies = table["keys"].to_pylist()
    sizes = [len(x) // 4 for x in bodies]
    keys = np.frombuffer(b"".join(bodies), np.uint32)
    _, entry, counts = np.unique(keys, return_inverse=True, return_counts=True)
    counts = counts + np.bincount(entry, _flags(table, "twice", sizes), len(counts))
    reference = np.bincount(entry, _flags(table, "reference", sizes), len(counts)) > 0
    return _answer(table, ((counts > 1) & reference)[entry], sizes)


def _match_runs(table: pa.Table) -> pa.Table:
    """Runs that start at two positions."""
    bodies = table["keys"].to_pylist()
    sizes = [len(x) // 16 for x in bodies]
    keys = np.frombuffer(b"".join(bodies), np.uint64).reshape(-1, 2)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]).any(1)))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    counts = np.bincount(entry) + np.bincount(entry, _flags(table, "twice", sizes))
    return _answer(table, (counts > 1)[entry], sizes)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove every word that lies in a run of `window` words which also starts anywhere else.

    Words are `[^\\x20\\x09-\\x0D]+`; runs stay in one row and are judged on the input. Returns one row for each input row: the id,
    n_words, n_removed, repeats (list of start and length in words, maximal), kept (remaining words joined by one space).
    A NULL or empty text has no words and an empty kept text. NULL and repeated ids are kept as they are; a repeated row repeats
    its runs. Rows of fewer than `window` words come back whole; empty tables give empty results; other columns are not read.
    """
    anchor = (window + 1) // 2
    blocks = in_blocks(docs.select(id_col, text_col), text_col)
    n = bucket_count(blocks)

    def send_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch["block"].to_pylist(), batch["body"], strict=True):
                _, _, values, buckets, twice, reference = _anchors(Words(body.as_py(), 1), anchor, n)
                low = (values & LOW).astype(np.uint32)
                yield sent(block, buckets, {"keys": lambda a, b: low[a:b].tobytes(), "twice": lambda a, b: bits(twice[a:b]), "reference": lambda a, b: bits(reference[a:b])})

    def send_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, hits in zip(batch["block"].to_pylist(), batch["body"], batch["anchors"], strict=True):
                if hits.as_py():
                    _, _, keys, buckets, twice = _runs(Words(body.as_py(), 1), window, anchor, n, hits.as_py())
                    yield sent(block, buckets, {"keys": lambda a, b: keys[a:b].tobytes(), "twice": lambda a, b: bits(twice[a:b])})

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, hits, runs in zip(batch["body"], batch["anchors"], batch["runs"], strict=True):
                words = Words(body.as_py(), 1)
                yield _kept(words, window, _repeated(words, window, anchor, n, hits.as_py(), runs.as_py()), id_col)

    sent_rows = blocks.mapInArrow(send_anchors, "bucket bigint, block bigint, keys binary, twice binary, reference binary")
    anchors = sent_rows.groupBy("bucket").applyInArrow(_match_anchors, ANSWER)
    held = with_answers(blocks, anchors=anchors)
    runs = held.mapInArrow(send_runs, "bucket bigint, block bigint, keys binary, twice binary").groupBy("bucket").applyInArrow(_match_runs, ANSWER)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, repeats array<struct<start:bigint,length:bigint>>, kept string"
    return with_answers(held, runs=runs).mapInArrow(remove, schema)


def _repeated(words: Words, window: int, anchor: int, n: int, hits: list | None, runs: list | None) -> np.ndarray:
    """Start positions of repeated runs."""
    if not runs:
        return np.zeros(0, np.int64)
    starts, entry, keys, buckets, _ = _runs(words, window, anchor, n, hits)
    hit = np.zeros(len(keys), bool)
    for a in runs:
        lo, hi = np.searchsorted(buckets, [a["bucket"], a["bucket"] + 1])
        hit[lo:hi] = unbits(a["hits"], hi - lo)
    return starts[hit[entry]]


def _kept(words: Words, window: int, repeated: np.ndarray, id_col: str) -> pa.RecordBatch:
    change = np.zeros(words.first[-1] + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + window, -1)
    covered = np.cumsum(change)[:-1] > 0
    data, starts, ends, first = words.data.tobytes(), words.starts, words.ends, words.first
    kept, spans = [], []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        own = data[starts[lo] : ends[hi - 1]].split() if hi > lo else []
        gone = covered[lo:hi]
        if gone.any():
            border = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in border.reshape(-1, 2)])
            own = [own[i] for i in np.flatnonzero(~gone)]
        else:
            spans.append([])
        kept.append(b" ".join(own))
    removed = np.add.reduceat(np.append(covered, False).astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
    removed[np.diff(first) == 0] = 0
    spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
    ids = words.rows.column(0).combine_chunks()
    arrays = [ids, pa.array(np.diff(first)), pa.array(removed), spans, pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "n_removed", "repeats", "kept"])
