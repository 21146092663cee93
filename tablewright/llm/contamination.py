"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items' words tracks, while a document's words stream by, the longest run that ends at each word and occurs in
an item. A run of `window` words or more is a hit; so is a whole item that is shorter than a window. Word pairs that occur in no
item end every run, so arrays find the stretches that can hold a hit first and only those are streamed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrays import byte_values, inside_table, parts, texts, unbits, word_bounds, word_hashes
from tablewright.session import checkpointed, ship_package

#: Words are runs of digits, letters and all characters beyond ASCII; A-Z count as a-z.
INSIDE = inside_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
VALUES = byte_values(3, lower=True)
SLICE_BYTES = 4 << 20
#: Characters of items in one automaton; more items are matched by several automata, one after the other.
SHARD_CHARS = 1 << 20


class Automaton:
    """Generalised suffix automaton over word numbers, with the items in which each window and each short item lies."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        data, offsets = texts(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = word_bounds(data, offsets, INSIDE)
        self.vocabulary, numbers = np.unique(word_hashes(data, starts, ends, VALUES, 3), return_inverse=True)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = [(name, numbers[a:b].tolist()) for (name, _), a, b in zip(items, first[:-1], first[1:], strict=True) if b > a]
        for _, words in rows:
            last = 0
            for w in words:
                last = self._extend(last, w)
        pairs = [np.array(w[:-1], np.int64) * len(self.vocabulary) + np.array(w[1:], np.int64) for _, w in rows]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.shortest = min([window, *(len(w) for _, w in rows)])
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        for name, words in rows:
            for state, length in self._walk(words):
                if length >= window:
                    self.items.setdefault(self._suffix(state, window), set()).add(name)
            if len(words) < window:
                at = self._suffix(state, len(words))
                self.short.setdefault(at, [(len(words), set())])[0][1].add(name)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            known = nxt[last][word]
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = state
            at = link[at]
        if at >= 0:
            known = nxt[at][word]
            link[state] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return state

    def _split(self, at: int, word: int, known: int) -> int:
        nxt, link = self.next, self.link
        copy = len(nxt)
        nxt.append(dict(nxt[known]))
        link.append(link[known])
        self.length.append(self.length[at] + 1)
        link[known] = copy
        while at >= 0 and nxt[at].get(word) == known:
            nxt[at][word] = copy
            at = link[at]
        return copy

    def _walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = matched = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            yield state, matched

    def _suffix(self, state: int, n: int) -> int:
        """The state that holds the last n words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def search(self, words: list[int], hit: np.ndarray, found: set[str]) -> None:
        """Mark the words of every window occurrence and add the items' names."""
        for i, (state, matched) in enumerate(self._walk(words)):
            if matched >= self.window:
                hit[i + 1 - self.window : i + 1] = True
                found |= self.items[self._suffix(state, self.window)]
            while self.short and state > 0:
                for n, names in self.short.get(state, ()):
                    if n <= matched:
                        hit[i + 1 - n : i + 1] = True
                        found |= names
                state = self.link[state]

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """Hit flags of all words and the items found in each row."""
        hit, found = np.zeros(first[-1], bool), [set() for _ in first[1:]]
        if not len(self.vocabulary) or not len(hit):
            return hit, found
        hashes = word_hashes(data, starts, ends, VALUES, 3)
        numbers = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[numbers] == hashes
        joined = np.zeros(len(hit) + 1, bool)  # the word and the one before can stand in one match
        near = np.flatnonzero(known[1:] & known[:-1])
        keys = numbers[near] * len(self.vocabulary) + numbers[near + 1]
        if len(self.pairs):
            joined[near + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys
        joined[first] = False
        heads = np.flatnonzero(known & ~joined[:-1])
        lengths = np.searchsorted(np.flatnonzero(~joined), heads, "right")
        lengths = np.flatnonzero(~joined)[lengths] - heads
        enough = lengths >= self.shortest
        rows = np.searchsorted(first, heads[enough], "right") - 1
        for a, n, row in zip(heads[enough], lengths[enough], rows, strict=True):
            self.search(numbers[a : a + n].tolist(), hit[a : a + n], found[row])
        return hit, found


def _shards(items: DataFrame | None, id_col: str, text_col: str, window: int) -> tuple[int, Iterator[Automaton]]:
    """Items in groups whose size is bounded, whatever the table's: their number, and the automaton of each, made when asked for."""
    if items is None:
        return 1, iter([Automaton([], window)])
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS))
    of = lambda k: rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k).collect()
    return n, (Automaton([(r["name"], r["text"]) for r in of(k)], window) for k in range(n))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    share: tuple[int, int] = (1, 20),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    cleaned: bool = False,
    with_text: bool = False,
) -> DataFrame:
    """Occurrences of item windows in documents.

    A window is `window` consecutive words of an item, or a whole shorter item that has words. Returns one row for each input row:
    the id, n_words, n_hit (words inside occurrences), items (names of the items found, sorted as strings), spans (start and
    length in words), contaminated (n_hit is positive and at least the share of n_words). With cleaned, also `cleaned`: the text
    without the bytes from the first to the last word of every span. With with_text the text comes last.

    NULL or empty texts have no words and are clean; NULL items never match; a NULL item id is named by the empty string; items
    of one id count once. Repeated rows each have their row. Empty tables on either side are allowed; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.lit(None).cast("binary").alias("__hit"), F.array().cast("array<string>").alias("__found"))
    n, shards = _shards(items, item_id, item_text, window)
    for k, shard in enumerate(shards):
        automaton = spark.sparkContext.broadcast(shard)
        last = k == n - 1

        def scan(batches: Iterable[pa.RecordBatch], automaton=automaton, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = texts(batch.column(1))
                for lo, hi in parts(offsets, SLICE_BYTES):
                    own, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                    starts, ends, first = word_bounds(own, bounds, INSIDE)
                    hit, found = automaton.value.scan(own, starts, ends, first)
                    for i in range(hi - lo):
                        before = batch.column(2)[lo + i].as_py()
                        if before is not None:
                            hit[first[i] : first[i + 1]] |= unbits(before, first[i + 1] - first[i])
                            found[i].update(batch.column(3)[lo + i].as_py())
                    piece = batch.slice(lo, hi - lo)
                    yield _report(piece, own, bounds, starts, ends, first, hit, found, share, cleaned, with_text) if last else _state(piece, first, hit, found)

        report = f"`{id_col}` {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,length:bigint>>, contaminated boolean" + ", cleaned string" * cleaned + f", `{text_col}` string" * with_text
        rows = rows.mapInArrow(scan, report if last else f"`{id_col}` {kind}, `{text_col}` string, __hit binary, __found array<string>")
        if not last:
            rows = checkpointed(rows)
            automaton.unpersist()
    return rows


def _state(piece: pa.RecordBatch, first: np.ndarray, hit: np.ndarray, found: list[set[str]]) -> pa.RecordBatch:
    flags = [np.packbits(hit[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
    arrays = [piece.column(0), piece.column(1), pa.array(flags, pa.binary()), pa.array([sorted(f) for f in found], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, names=piece.schema.names)


def _report(piece, data, bounds, starts, ends, first, hit, found, share, cleaned, with_text) -> pa.RecordBatch:
    n_words = np.diff(first)
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[first[1:]] - total[first[:-1]]
    spans, kept, raw = [], [], data.tobytes() if cleaned else b""
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own = np.zeros((0, 2), np.int64)
        if n_hit[i]:
            own = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))).reshape(-1, 2)
        spans.append([{"start": int(x), "length": int(y - x)} for x, y in own])
        if cleaned:
            edges = [bounds[i], *(e for x, y in own for e in (starts[a + x], ends[a + y - 1])), bounds[i + 1]]
            kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
    arrays = [
        piece.column(0),
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([sorted(f) for f in found], pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        pa.array((n_hit > 0) & (n_hit * share[1] >= n_words * share[0])),
    ]
    names = [piece.schema.names[0], "n_words", "n_hit", "items", "spans", "contaminated"]
    arrays += [pa.array(kept, pa.binary()).cast(pa.string())] * cleaned + [piece.column(1)] * with_text
    return pa.RecordBatch.from_arrays(arrays, names=names + ["cleaned"] * cleaned + [piece.schema.names[1]] * with_text)
