"""Typo merging and vocabulary correction.

Similar pairs are found by segment matching (the Pass-Join idea, Li et al., VLDB 2011): if two
strings are within D edits, cutting the shorter into D + 1 segments leaves one segment intact near
its place in the longer. That turns the similarity join into an equi-join and misses nothing, so
no pair of unrelated values is ever formed.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.text import normalize_arabic
from tablewright.operators.profile import key_like
from tablewright.session import checkpointed

# Query words that are never corrected.
STOP_WORDS = ["من", "مين", "ما", "كيف", "اين", "هل", "ماذا", "في", "على", "عن", "هو", "هي", "هم", "ان", "او", "لا", "نعم", "مع", "الي", "إلى",
              "هذا", "هذه"]


def _common_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - bin(state).count("1")


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2·LCS / (len a + len b)."""
    return pd.Series([2.0 * _common_length(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of the standard library; never above the indel ratio."""
    return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)])


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _budget(short: Column, long: Column, ratio: float, scorer: str) -> Column:
    """Most edits two strings of these lengths can differ by at the wanted ratio."""
    size = long if scorer == "levenshtein" else short + long
    return F.floor(size * (1.0 - ratio) + 1e-9).cast("int")


def _left_over(rows: DataFrame, value: str, scorer: str) -> DataFrame:
    """Keys for lengths at which the budget leaves no whole segment of the shorter text.

    Two texts within the budget keep some characters in common, in order; so what is left of both after deletions, one character
    or two, is a key of both.
    """
    kept = F.col("__long") - F.col("__d") if scorer == "levenshtein" else F.ceil((F.col("__short") + F.col("__long") - F.col("__d")) / 2)
    letters = F.split(F.col(value), "")
    size = F.size("__letters")
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(1), size - 1),
        lambda i: F.transform(F.slice("__letters", i + 1, size), lambda b: F.concat(F.element_at("__letters", i), b)),
    ))
    keyed = rows.withColumn("__letters", letters).withColumn("__two", (kept >= 2) & (size >= 2))
    keys = F.array_distinct(F.when(F.col("__two"), pairs).otherwise(F.col("__letters")))
    return keyed.select(value, "__short", "__long", F.lit(-1).alias("__seg"), F.explode(keys).alias("__text"))


def candidate_pairs(left: DataFrame, right: DataFrame, a: str, b: str, ratio: float, scorer: str, both_ways: bool = True) -> DataFrame:
    """Distinct (a, b) pairs of two value tables that can reach `ratio`; a superset of the true matches, without cross join.

    With `both_ways=False` only pairs where `a` is not longer than `b` come out, enough for a self-join.
    """
    slack = 1.0 / ratio if scorer == "levenshtein" else (2.0 - ratio) / ratio  # longest partner, as a multiple of the length

    def cut(rows: DataFrame, value: str, value_is_short: bool) -> DataFrame:
        own = F.length(value)
        if value_is_short:
            other = F.sequence(own, F.ceil(own * slack).cast("int") + 1)
        else:
            other = F.sequence(F.greatest(F.lit(1), F.floor(own / slack).cast("int") - 1), own)
        frame = rows.where(own > 0).withColumn("__other", F.explode(other))
        short, long = (own, F.col("__other")) if value_is_short else (F.col("__other"), own)
        frame = frame.withColumns({"__short": short, "__long": long}).withColumn("__d", _budget(F.col("__short"), F.col("__long"), ratio, scorer))
        frame = frame.where(F.col("__long") - F.col("__short") <= F.col("__d"))
        thin = frame.where(F.col("__d") >= F.col("__short"))
        frame = frame.where(F.col("__d") < F.col("__short")).withColumn("__seg", F.explode(F.sequence(F.lit(0), F.col("__d"))))
        pieces = F.col("__d") + 1
        width = F.floor(F.col("__short") / pieces).cast("int")
        longer_from = pieces - F.col("__short") % pieces
        start = F.col("__seg") * width + F.greatest(F.lit(0), F.col("__seg") - longer_from)
        size = width + (F.col("__seg") >= longer_from).cast("int")
        frame = frame.withColumns({"__start": start, "__size": size})
        if value_is_short:
            frame = frame.withColumn("__at", F.col("__start"))
        else:
            first = F.greatest(F.lit(0), F.col("__start") - F.col("__d"))
            last = F.least(F.col("__long") - F.col("__size"), F.col("__start") + F.col("__d"))
            frame = frame.where(first <= last).withColumn("__at", F.explode(F.sequence(first, last)))
        text = F.substring(F.col(value), F.col("__at") + 1, F.col("__size"))
        made = frame.select(value, "__short", "__long", "__seg", text.alias("__text"))
        if ratio <= (0.5 if scorer == "levenshtein" else 2 / 3):  # above, the budget is always below the length of the shorter text
            made = made.unionByName(_left_over(thin, value, scorer))
        return made.distinct()

    keys = ["__short", "__long", "__seg", "__text"]
    one = cut(left, a, True).join(cut(right, b, False), keys).select(a, b)
    if not both_ways:
        return one.distinct()
    two = cut(left, a, False).where(F.col("__short") < F.col("__long")).join(cut(right, b, True).where(F.col("__short") < F.col("__long")), keys)
    return one.unionByName(two.select(a, b)).distinct()


def similar_pairs(values: DataFrame, column: str, ratio: float, scorer: str = "levenshtein") -> DataFrame:
    """(a, b, score) with a < b and score at least `ratio`, over the distinct values of a column."""
    distinct = values.select(F.col(column).alias("a")).where(F.col("a").isNotNull()).distinct()
    found = candidate_pairs(distinct, distinct.withColumnRenamed("a", "b"), "a", "b", ratio, scorer, both_ways=False).where(F.col("a") != F.col("b"))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    score = {"levenshtein": levenshtein_ratio, "indel": indel_ratio, "blocks": block_ratio}[scorer](F.col("a"), F.col("b"))
    return pairs.withColumn("score", score).where(F.col("score") >= ratio)


def silenced(edges: DataFrame) -> DataFrame:
    """(node): what a visit in order would silence, where every node not yet silenced silences the nodes its edges lead to.

    edges: (first, second) with `first` visited before `second`. Works in rounds: nodes that no open edge leads to
    act, what they lead to is silenced, and edges of settled nodes close. The lists stay distributed.
    """
    open_edges = checkpointed(edges.select("first", "second").distinct())
    found = None
    while True:
        waiting = open_edges.select(F.col("second").alias("first")).distinct()
        acting = open_edges.select("first").distinct().join(waiting, "first", "left_anti")
        hit = checkpointed(open_edges.join(acting, "first", "left_semi").select(F.col("second").alias("node")).distinct())
        found = hit if found is None else found.union(hit)
        settled = acting.select(F.col("first").alias("node")).union(hit)
        rest = open_edges.join(settled.select(F.col("node").alias("first")), "first", "left_anti").join(settled.select(F.col("node").alias("second")), "second", "left_anti")
        open_edges = checkpointed(rest.select("first", "second"))
        if not open_edges.head(1):
            return checkpointed(found)


def typo_map(df: DataFrame, column: str, threshold: int = 88, scorer: str = "indel", max_values: int | None = None) -> DataFrame:
    """(wrong, right): rarer spellings mapped to the most frequent similar one.

    Values are visited by count (descending) then text; each unmapped value absorbs its similar, not
    yet mapped values. Any number of spellings; a caller who holds columns with more than `max_values`
    of them for free text can have those left alone.
    """
    counts = checkpointed(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))
    if max_values is not None and counts.limit(max_values + 1).count() > max_values:
        return df.sparkSession.createDataFrame([], "wrong string, right string")
    ratio = (threshold - 0.5) / 100.0
    pairs = similar_pairs(counts, "value", ratio, scorer).where(F.round(F.col("score") * 100) >= threshold)
    place = F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value"))
    one, two = counts.select(F.col("value").alias("a"), place.alias("pa")), counts.select(F.col("value").alias("b"), place.alias("pb"))
    edges = checkpointed(pairs.join(one, "a").join(two, "b").select(F.least("pa", "pb").alias("first"), F.greatest("pa", "pb").alias("second")))
    mapped = silenced(edges)
    kept = edges.join(mapped.select(F.col("node").alias("second")), "second", "left_semi").join(mapped.select(F.col("node").alias("first")), "first", "left_anti")
    return kept.groupBy("second").agg(F.min("first").alias("first")).select(F.col("second.value").alias("wrong"), F.col("first.value").alias("right"))


def apply_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace mapped values; the mapping has at most one row per spelling."""
    renamed = mapping.select(F.col("wrong").alias(column), F.col("right").alias("__right"))
    return df.join(renamed, column, "left").withColumn(column, F.coalesce("__right", column)).select(*df.columns)


def merge_typos(df: DataFrame, column: str, threshold: int = 88, scorer: str = "indel", max_values: int | None = None) -> DataFrame:
    return apply_map(df, column, typo_map(df, column, threshold, scorer, max_values))


def consolidation_map(df: DataFrame, column: str, cutoff: float = 0.85, max_values: int | None = None) -> DataFrame:
    """(wrong, right): each spelling's five closest values (itself included) collapse to the most frequent of them.

    Longer spellings go first, then by text; a spelling that has been mapped collapses nothing, and a later
    mapping of a spelling replaces an earlier one. Skips key-like columns and mean lengths under five; with
    `max_values`, also columns of more spellings.
    """
    empty = df.sparkSession.createDataFrame([], "wrong string, right string")
    filled = df.where(F.col(column).isNotNull())
    lengths = filled.agg(F.avg(F.length(column))).first()[0]
    if lengths is None or lengths < 5 or key_like(df, [column]).first()["is_key"]:
        return empty
    usable = checkpointed(filled.where(F.length(F.trim(column)) > 1).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))
    if max_values is not None and usable.limit(max_values + 1).count() > max_values:
        return empty
    pairs = similar_pairs(usable, "value", cutoff, "indel").select("a", "b")
    scored = pairs.withColumn("score", block_ratio("a", "b")).unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).withColumn("score", block_ratio("a", "b"))
    ).where(F.col("score") >= cutoff).unionByName(usable.select(F.col("value").alias("a"), F.col("value").alias("b"), F.lit(1.0).alias("score")))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), F.desc("b")))).where("r <= 5")
    group = Window.partitionBy("a")  # five rows
    rows = top.join(usable.withColumnsRenamed({"value": "b"}), "b").withColumns({
        "size": F.count("*").over(group), "best": F.min(F.struct((-F.col("n")).alias("n"), "r", "b")).over(group)["b"],
    })
    turn = lambda v: F.struct((-F.length(v)).alias("length"), F.col(v).alias("value"))
    rows = checkpointed(rows.where((F.col("size") > 1) & (F.col("b") != F.col("best"))).select(turn("a").alias("first"), turn("b").alias("second"), "best"))
    quiet = silenced(rows.where(F.col("first") < F.col("second")))
    acting = rows.join(quiet.select(F.col("node").alias("first")), "first", "left_anti")
    last = acting.groupBy("second").agg(F.max(F.struct("first", "best")).alias("last"))
    return last.select(F.col("second.value").alias("wrong"), F.col("last.best").alias("right"))


def correct_words(
    queries: DataFrame, text: str, query_id: str, vocabulary: DataFrame, term: str, cutoff: float = 0.7, scorer: str = "levenshtein"
) -> DataFrame:
    """(query_id, corrected): every word of three letters or more, outside the stop list, replaced by its closest vocabulary term.

    Distinct words are matched once, however often they occur; matching uses the segment join.
    """
    tokens = queries.select(query_id, F.posexplode(F.split(normalize_arabic(F.col(text)), " ")).alias("pos", "word"))
    terms = vocabulary.select(F.col(term).alias("original"), normalize_arabic(F.col(term)).alias("term")).groupBy("term").agg(F.min("original").alias("original"))
    wanted = tokens.select("word").distinct().where((F.length("word") >= 3) & ~F.col("word").isin(STOP_WORDS))
    pairs = candidate_pairs(wanted, terms.select("term"), "word", "term", cutoff, "levenshtein" if scorer == "levenshtein" else "indel")
    score = {"levenshtein": levenshtein_ratio, "indel": indel_ratio, "blocks": block_ratio}[scorer](F.col("word"), F.col("term"))
    best = (
        pairs.withColumn("score", score).where(F.col("score") >= cutoff)
        .groupBy("word").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("term"))).alias("top"))
        .select("word", F.col("top.term").alias("term")).join(terms, "term").select("word", "original")
    )
    fixed = tokens.join(best, "word", "left").select(query_id, "pos", F.coalesce("original", "word").alias("word"))
    return fixed.groupBy(query_id).agg(  # one query's words
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("corrected")
    )
