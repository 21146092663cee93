"""Quality rules: counts of each text, and a log-likelihood ratio of hashed n-grams between trusted and all documents.

Everything is a column expression on the row itself or an aggregate over a fixed number of hash buckets, so a text of any length or
a source of any size costs no shuffle of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.frames import settle, with_few
from tablewright.session import checkpointed

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"
GAPS = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 1 << 14
#: Trusted ids up to this number are sent to all tasks (16 MB) instead of shuffling the texts.
SENT_IDS = 1_000_000
#: A document is kept from this mean log ratio on.
LEAST = -0.1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, not wherever body or a lambda in it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined_hashes(hashes: Column, size: int) -> Column:
    """Hashes of all runs of `size` values; hashes should be a column or bound by let()."""
    made = hashes
    for k in range(1, size):
        made = F.zip_with(made, F.slice(hashes, k + 1, F.greatest(F.size(hashes) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.slice(made, 1, F.greatest(F.size(hashes) - size + 1, F.lit(0)))


def repeated_words(words: Column, grams: Column, size: int) -> Column:
    """Words inside runs of `size` that occur twice or more; words and the runs' hashes are columns.

    Sorting by hash, then position, brings equal runs together; neighbours are compared by their words before they count. In texts
    of fewer than 65,536 words hash and position share one number, which sorts faster: the fewer bits positions need, the more are
    left for hashes. Longer texts sort pairs of the whole hash and the position.
    """
    n = F.size(words)
    short = F.when(n < 1 << 12, _repeated(words, size, _packed(grams, 12))).when(n < 1 << 16, _repeated(words, size, _packed(grams, 16)))
    # most texts repeat nothing
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(short.otherwise(_repeated(words, size, _paired(grams)))).cast("bigint")


def _packed(grams: Column, place: int) -> tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """Sorted numbers of hash and position, and how to read each of the two."""
    mask = (1 << place) - 1
    numbers = F.sort_array(F.transform(grams, lambda h, i: h.bitwiseAND(~mask).bitwiseOR(i.cast("bigint"))))
    return numbers, lambda x: F.shiftright(x, place), lambda x: x.bitwiseAND(mask).cast("int")


def _paired(grams: Column) -> tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """Sorted pairs of hash and position, and how to read each of the two."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("hash"), i.cast("int").alias("at"))))
    return pairs, lambda x: x["hash"], lambda x: x["at"]


def _repeated(words: Column, size: int, runs: tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]) -> Column:
    ordered, hash_of, place_of = runs

    def same(x: Column, y: Column) -> Column:
        at, other = place_of(x), place_of(y)
        equal = reduce(lambda a, b: a & b, [F.get(words, at + k) == F.get(words, other + k) for k in range(size)])
        return F.coalesce((hash_of(x) == hash_of(y)) & equal, F.lit(False))

    def positions(p: Column) -> Column:
        twice = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), same)
        found = let(twice, lambda t: F.filter(p, lambda x, k: F.get(t, k) | F.coalesce(F.get(t, k - 1), F.lit(False))))
        return F.sort_array(F.transform(found, place_of))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p + size - a["end"])).alias("n"), (p + size).alias("end"))
    return F.aggregate(let(ordered, positions), start, step)["n"]


def features(hashes: Column) -> Column:
    """Buckets of all words and word pairs."""
    return F.transform(F.concat(hashes, joined_hashes(hashes, 2)), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> Column:
    """Log of trusted over raw probability for every bucket, add-one smoothed, as a constant array of BUCKETS numbers."""
    ids = checkpointed(trusted.select(F.col(id_col)).distinct())
    rows = docs.join(with_few(ids, SENT_IDS).withColumn("__trusted", F.lit(1)), id_col, "left")
    hashes = F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w))
    counted = rows.select("__trusted", F.explode(let(hashes, features)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__trusted").alias("trusted"))
    found = {r["bucket"]: (r["trusted"] + 1, r["raw"] + 1) for r in counted.collect()}
    pairs = [found.get(b, (1, 1)) for b in range(BUCKETS)]
    target, raw = (sum(p[k] for p in pairs) for k in (0, 1))
    text = ",".join(f"{math.log(a / target) - math.log(b / raw):.17g}" for a, b in pairs)
    return F.split(F.lit(text), ",").cast("array<double>")


def rate(docs: DataFrame, trusted: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every document.

    trusted: a table whose ids name the trusted documents; its n-grams and those of all documents are counted in BUCKETS hash
    buckets each. ratio is the mean over a text's words and word pairs of the log ratio of their buckets. Returns one row for each
    input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or more than
    half of them in repeated three-word runs), ratio (NULL without words), kept (base passed and ratio of `least` or more).

    NULL and empty texts have no words and fail. Without any trusted document all ratios follow the smoothing alone. Repeated rows
    count as often as they come; a trusted id trusts all its rows, a NULL id none. Other columns are not read.
    """
    ratios = log_ratios(docs.select(id_col, text_col), trusted, id_col, text_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), words_of(F.col(text_col)).alias("__words"))
    rows = settle(rows, ["__words"]).withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    rows = settle(rows, ["__hashes"]).withColumns({"__grams": joined_hashes(F.col("__hashes"), 3), "__features": features(F.col("__hashes"))})
    rows = settle(rows.drop("__hashes"), ["__grams", "__features"])
    total = F.aggregate("__features", F.lit(0.0), lambda a, f: a + F.get(ratios, f))
    rows = rows.select(
        id_col,
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.coalesce(F.regexp_count("__text", F.lit(SYMBOLS)), F.lit(0)).cast("bigint").alias("n_symbols"),
        duplicate_lines(F.col("__text")).alias("n_dup_lines"),
        repeated_words(F.col("__words"), F.col("__grams"), 3).alias("n_repeat_words"),
        F.when(F.size("__features") > 0, total / F.size("__features")).alias("ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("ratio") >= least, F.lit(False)))
