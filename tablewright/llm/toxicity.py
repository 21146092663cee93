"""Toxicity by a classifier chain of logistic models over hashed words and word beginnings.

Categories are predicted in order. Each later model gets the earlier categories' probabilities as extra inputs; while it is
trained, these come from models that have not seen the row (out-of-fold), so that it does not trust them more than it should.
Every partition describes its labelled texts by buckets; training reads a bounded number of them (a parameter) in one task. Weights
are two numbers a bucket and category.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrays import byte_values, inside_table, parts, texts, word_bounds, word_hashes
from tablewright.llm.tokenizing import release_encoders
from tablewright.session import checkpointed, ship_package

INSIDE = inside_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
VALUES = byte_values(8, lower=True)
BITS = 18
#: Bytes of the beginnings of words that are inputs beside the whole words.
BEGINNINGS = (3, 4, 5)
SLICE_BYTES = 2 << 20
#: Pairs of row and bucket that are summed at a time in training.
PIECE_PAIRS = 1 << 19
STEPS = 60


def inputs(data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs in order, of the buckets that are used, and the number of words of each row."""
    starts, ends, first = word_bounds(data, offsets, INSIDE)
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    found = []
    for k, stop in enumerate([ends, *(np.minimum(ends, starts + n) for n in BEGINNINGS)]):
        bucket = ((word_hashes(data, starts, stop, VALUES, 8) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
        keep = slice(None) if used is None else used[bucket]
        found.append(row[keep] << BITS | bucket[keep])
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1), np.diff(first)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(piece: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The row of every bucket of a piece."""
    return np.repeat(np.arange(piece[0], piece[0] + len(piece[1]), dtype=np.int32), piece[1])


def fit(pieces: list[tuple[int, np.ndarray, np.ndarray]], extra: np.ndarray, target: np.ndarray, use: np.ndarray, penalty: float = 2e-4) -> np.ndarray:
    """Weights of a penalised logistic model: buckets, then the extra inputs, then the constant; only rows in `use` count.

    pieces: the first of some rows that follow each other, the number of buckets of each, and the buckets. Only one piece at a time has
    the row of every bucket beside it and is widened for sums, so that all of them fit in memory.
    """
    n = max(int(use.sum()), 1)
    # buckets that go with the target more than by chance: two deviations of their log odds
    hits, all_rows = np.full(1 << BITS, 0.5), np.full(1 << BITS, 1.0)
    for piece in pieces:
        row = _rows(piece)
        row, names = row[use[row]], piece[2][use[row]]
        hits += np.bincount(names, target[row], 1 << BITS)
        all_rows += np.bincount(names, minlength=1 << BITS)
    positive = target[use].sum() + 0.5
    odds = np.log(hits * (n + 1 - positive) / ((all_rows - hits) * positive))
    telling = (all_rows > 1) & (np.abs(odds) >= 2 * np.sqrt(1 / hits + 1 / (all_rows - hits)))
    known = np.flatnonzero(telling)
    place = np.zeros(1 << BITS, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    kept = []
    for piece in pieces:
        row, bucket = _rows(piece), piece[2]
        keep = use[row] & telling[bucket]
        kept.append((row[keep], place[bucket[keep]]))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = extra @ w[len(known) : -1] + w[-1]
        for row, at in kept:
            z += np.bincount(row, w[at], len(target))
        error = np.where(use, _sigmoid(z) - target, 0.0)
        grad = np.concatenate([np.zeros(len(known)), error @ extra, [error.sum()]])
        for row, at in kept:
            grad[: len(known)] += np.bincount(at, error[row], len(known))
        grad /= n
        grad[:-1] += penalty * w[:-1]
        return np.where(use, np.logaddexp(0, z) - target * z, 0.0).sum() / n + penalty / 2 * (w[:-1] @ w[:-1]), grad

    w = np.zeros(len(known) + extra.shape[1] + 1)
    share = np.clip(target[use].mean() if use.any() else 0.0, 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    w = _minimum(loss, w) if use.any() else w
    full = np.zeros((1 << BITS) + extra.shape[1] + 1)
    full[known], full[1 << BITS :] = w[: len(known)], w[len(known) :]
    return full


def _minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, kept: int = 8) -> np.ndarray:
    """Quasi-Newton descent that keeps the last few steps, with halving of steps that do not lower the loss enough."""
    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        direction, saved = grad.copy(), []
        for s, y, r in reversed(steps):
            saved.append(r * (s @ direction))
            direction -= saved[-1] * y
        if steps:
            s, y, _ = steps[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(saved), strict=True):
            direction += s * (a - r * (y @ direction))
        slope, rate = grad @ direction, 1.0
        if slope <= 1e-10:
            break
        while rate > 1e-6:
            lower, turned = loss(w - rate * direction)
            if lower <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = -rate * direction, turned - grad
        if s @ y > 1e-12:
            steps = [*steps[1 - kept :], (s, y, 1 / (s @ y))]
        w, done = w + s, value - lower < 1e-7
        value, grad = lower, turned
        if done:
            break
    return w


def probability(w: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]], extra: np.ndarray, n: int) -> np.ndarray:
    z = extra @ w[1 << BITS : -1] + w[-1]
    for row, bucket in pairs:
        z += np.bincount(row, w[bucket], n)
    return _sigmoid(z)


def fit_chain(pieces: list[tuple[int, np.ndarray, np.ndarray]], targets: np.ndarray, fold: np.ndarray, folds: int, least_rows: int) -> list[np.ndarray]:
    """One model a category (columns of targets, NaN where unknown), in order. Buckets of fewer than least_rows rows are left out of pieces, in place."""
    rows_with = np.zeros(1 << BITS, np.int64)
    for _, _, bucket in pieces:
        rows_with += np.bincount(bucket, minlength=1 << BITS)
    for k, (first, sizes, bucket) in enumerate(pieces):
        keep = rows_with[bucket] >= least_rows
        left = np.bincount(_rows((0, sizes, bucket))[keep], minlength=len(sizes))
        pieces[k] = first, left.astype(np.int32), bucket[keep]
    models, extra = [], np.zeros((len(targets), 0))
    for k in range(targets.shape[1]):
        known = ~np.isnan(targets[:, k])
        target = np.where(known, targets[:, k], 0.0)
        models.append(fit(pieces, extra, target, known))
        if k + 1 < targets.shape[1]:
            unseen = np.zeros(len(targets))
            for f in range(folds):
                w = fit(pieces, extra, target, known & (fold != f))
                unseen = np.where(fold == f, probability(w, ((_rows(p), p[2]) for p in pieces), extra, len(targets)), unseen)
            extra = np.column_stack([extra, unseen])
    return models


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int, folds: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each of at most sample_rows labelled ids that docs hold a text of, those that come first by hash: the id, its
    fold, a column __c<k> for each category, and the buckets of its text as int32 values.

    An id with several texts has the one with the smallest hash; an id with several labels has the highest known value of each category.
    """
    columns = [f"__c{k}" for k in range(len(categories))]
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__id is not null and __text is not null")
    held = given.groupBy("__id").agg(F.min(F.xxhash64("__text")).alias("__hash"))
    wanted = labels.select(F.col(id_col).alias("__id"), *[c.cast("double").alias(n) for n, c in zip(columns, categories.values(), strict=True)])
    wanted = wanted.where(F.col("__id").isNotNull() & F.coalesce(*columns).isNotNull()).groupBy("__id").agg(*[F.max(n).alias(n) for n in columns])
    chosen = held.join(wanted, "__id").orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    chosen = checkpointed(chosen.withColumn("__fold", F.pmod(F.xxhash64("__id"), F.lit(folds)).cast("int")))
    # broadcast: sample_rows rows of a few numbers
    rows = given.withColumn("__hash", F.xxhash64("__text")).join(F.broadcast(chosen), ["__id", "__hash"]).select("__id", "__text", "__fold", *columns)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        seen = set()  # sample_rows ids at most
        for batch in batches:
            new = []
            for k, i in enumerate(batch.column(0).to_pylist()):
                if i not in seen:
                    seen.add(i)
                    new.append(k)
            batch = batch.take(pa.array(new, pa.int64()))
            data, offsets = texts(batch.column(1))
            for lo, hi in parts(offsets, SLICE_BYTES):
                row, bucket, _ = inputs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                bounds, bucket = np.searchsorted(row, np.arange(hi - lo + 1)), bucket.astype(np.int32)
                body = pa.array([bucket[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, *range(2, batch.num_columns))), body], names=["__id", "__fold", *columns, "__buckets"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(describe, f"__id {kind}, __fold int, " + "".join(f"{n} double, " for n in columns) + "__buckets binary")
    return checkpointed(made.dropDuplicates(["__id"]).sortWithinPartitions(F.xxhash64("__id"), "__id"))


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = 20_000, folds: int = 3, least_rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> list[np.ndarray]:
    """Fit the chain on at most sample_rows labelled documents (see training_rows). categories: name and condition on labels."""
    ship_package(docs.sparkSession)
    sample, count = training_rows(docs, labels, categories, sample_rows, folds, id_col, text_col).drop("__id"), len(categories)

    def fit_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        pieces, fold, targets, n = [], [np.zeros(0, np.int32)], [np.zeros((0, count))], 0
        for batch in batches:
            bodies = [np.frombuffer(v.as_buffer(), np.int32) for v in batch.column(batch.num_columns - 1)]
            sizes = np.array([len(v) for v in bodies], np.int64)
            for lo, hi in parts(np.concatenate([[0], np.cumsum(sizes)]), PIECE_PAIRS):
                pieces.append((n + lo, sizes[lo:hi].astype(np.int32), np.concatenate(bodies[lo:hi])))
            fold.append(batch.column(0).to_numpy(zero_copy_only=False))
            targets.append(np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(count)]).astype(float))
            n += batch.num_rows
        models = fit_chain(pieces, np.concatenate(targets), np.concatenate(fold), folds, least_rows)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int64()), pa.array([m.tobytes() for m in models], pa.binary())], names=["place", "weights"])

    fitted = sample.coalesce(1).mapInArrow(fit_all, "place bigint, weights binary").collect()
    return [np.frombuffer(r["weights"]) for r in sorted(fitted, key=lambda r: r["place"])]


def score_chain(docs: DataFrame, models: list[np.ndarray], names: list[str], least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Probability of every category for every row, and toxic: whether that of the last one is `least` or more.

    Words are runs of digits, letters and characters beyond ASCII; A-Z count as a-z. One row for each input row: the id, n_words,
    a column p_<name> for each category, toxic. A NULL or empty text has no words: its probabilities are the models' constants
    and it is not toxic. NULL and repeated ids are kept; an empty table gives no rows. Other columns are not read. With with_text
    the text comes last.
    """
    ship_package(docs.sparkSession)
    used = np.zeros(1 << BITS, bool)
    for w in models:
        used |= w[: 1 << BITS] != 0
    held = docs.sparkSession.sparkContext.broadcast((models, used))  # BITS sets the size, not the data

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        models, used = held.value
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in parts(offsets, SLICE_BYTES):
                row, bucket, n_words = inputs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], used)
                made = np.zeros((hi - lo, 0))
                for w in models:
                    made = np.column_stack([made, probability(w, [(row, bucket)], made, hi - lo)])
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), *(pa.array(made[:, k]) for k in range(len(models)))]
                own = [batch.column(1).slice(lo, hi - lo)] * with_text
                yield pa.RecordBatch.from_arrays([*arrays, pa.array((made[:, -1] >= least) & (n_words > 0)), *own], names=[id_col, "n_words", *names, "toxic", *[text_col] * with_text])

    names = [f"p_{n}" for n in names]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, " + ", ".join(f"`{n}` double" for n in names) + ", toxic boolean" + f", `{text_col}` string" * with_text
    return docs.select(id_col, text_col).mapInArrow(judge, schema)


def given_categories() -> dict[str, Column]:
    """Conditions on the given labels, in the order of the chain."""
    return {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def find_toxic(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, **options) -> DataFrame:
    """Train on the labelled rows and judge all: see train_chain and score_chain. By default the labels' columns quality and toxic
    make the chain: poor text first, then toxicity. Without labelled rows nothing is toxic."""
    categories = categories or given_categories()
    models = train_chain(docs, labels, categories, **options)
    return score_chain(docs, models, list(categories))
