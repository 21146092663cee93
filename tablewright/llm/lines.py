"""Line dedup: an exact set-similarity join over the distinct words of lines, with columns and joins only.

Equal lines are one line, that of their first place. A line's words are ordered from rare to frequent. Two lines with Jaccard
similarity of at least t share a word among the first n - ceil(t n) + 1 of each (prefix filter), have sizes within a factor t
(length filter), and the first shared word leaves enough words behind it in both (positional filter). Prefix words also carry a
parity bitmap of the whole set: its distance is at most the number of words that only one set has, another exact filter. What
passes is compared by wider bitmaps, and then verified on whole sets.

Only an earlier line removes one, so a pair counts only if its later line is not removed yet. Groups of many similar lines would
meet in all their pairs. So lines are first compared with the earliest line that has the same smallest, or the same largest, word
hashes; what this removes only serves as earlier lines for others, and does not meet the lines before it again.

Texts are not shuffled while the lists of repeated lines and of lines to verify are of a checked size; beyond it they are.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.quality import WHITE
from tablewright.operators.frames import settle, with_few
from tablewright.session import checkpointed

#: Word frequencies are counted in this many hash buckets, so that the table of ranks has the same size for any corpus.
RANKS = 1 << 16
#: White space of a line other than blanks.
RARE_WHITE = "[\\t\\x0B\\f\\r]"
#: Words that make a key of the first comparison.
SMALLEST = 3
#: Bitmaps of 64 bits for each line of a candidate pair.
MAPS = 4
#: Lists of line numbers of up to so many rows are sent to all tasks: 40 MB.
SENT_LINES = 1_000_000


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line that has words: id, line number in its text, line, and two hashes of it."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    rows = rows.where(F.btrim("line", F.lit(WHITE)) != "")
    return rows.select("id", "line_no", "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def _plain(line: Column) -> Column:
    """The line with blanks as its only white space, so that it is split without a regular expression."""
    return F.when(line.rlike(RARE_WHITE), F.regexp_replace(line, RARE_WHITE, " ")).otherwise(line)


def _hashed(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    return F.array_distinct(F.transform(F.filter(F.split(_plain(line), " "), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _parities(hashes: Column) -> Column:
    """64 bits, each whether an odd number of the hashes falls on it."""
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda m, w: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(w, 58).cast("int"))))


def _may_be_similar(x: str, y: str, maps: list[str], percent: int) -> Column:
    """Whether sizes and parity bitmaps of two lines allow the similarity."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = nx + ny - 2 * F.ceil(percent * (nx + ny) / (100 + percent))
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in maps])
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (apart <= most)


def _ordered(hashes: Column, ranks: Column) -> Column:
    """Word keys from rare to frequent: the rank of the word's bucket, then the rest of its hash."""
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.get(ranks, h.bitwiseAND(RANKS - 1).cast("int")), 47).bitwiseOR(F.shiftrightunsigned(h, 17))))


def _ranks(lines: DataFrame) -> Column:
    """For every bucket of word hashes its place by the frequency of its words in all lines, as a constant array."""
    words = lines.select(F.explode(F.split(_plain(F.col("line")), " ")).alias("word")).where("word <> ''")
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(RANKS - 1).alias("bucket")).count().collect()
    place = {r["bucket"]: k for k, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["bucket"])))}
    unused = iter(range(len(place), RANKS))
    return F.split(F.lit(",".join(str(place[b] if b in place else next(unused)) for b in range(RANKS))), ",").cast("array<bigint>")


def _falls_on(k: int, w: Column) -> Column:
    return w.bitwiseAND(MAPS - 1) == k


def _members(pairs: DataFrame) -> DataFrame:
    return checkpointed(pairs.select(F.col("x").alias("a")).union(pairs.select(F.col("y").alias("a"))).distinct())


def _verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (x, y), y the later line, the hashes (a, b) of each y whose word set is similar to that of its x."""
    pairs = checkpointed(pairs)
    found = lines.select("a", "b", "line").join(with_few(_members(pairs), SENT_LINES), "a", "left_semi")
    found = settle(found.withColumn("hashes", _hashed(F.col("line"))), ["hashes"])
    maps = {f"m{k}": _parities(F.filter("hashes", partial(_falls_on, k))) for k in range(MAPS)}
    found = checkpointed(found.select("a", "b", "line", F.size("hashes").alias("n"), *[m.alias(k) for k, m in maps.items()]))
    # four times the bits of the first bitmap decide most pairs, also of long lines, before texts are moved
    short = found.select("a", "n", *maps)
    one, two = (short.withColumnRenamed("a", side).alias(f"of_{side}") for side in ("x", "y"))
    pairs = checkpointed(pairs.join(one, "x").join(two, "y").where(_may_be_similar("of_x", "of_y", list(maps), percent)).select("x", "y"))
    found = found.select("a", "b", "line").join(with_few(_members(pairs), SENT_LINES), "a", "left_semi")
    one = found.select(F.col("a").alias("x"), F.col("line").alias("xl"))
    two = found.select(F.col("a").alias("y"), "b", F.col("line").alias("yl"))
    rows = pairs.join(one, "x").join(two, "y")
    rows = settle(rows.withColumns({"xs": _hashed(F.col("xl")), "ys": _hashed(F.col("yl"))}).drop("xl", "yl"), ["xs", "ys"])
    rows = settle(rows.withColumn("both", F.size(F.array_intersect("xs", "ys"))), ["both"])
    rows = rows.where(100 * F.col("both") >= percent * (F.size("xs") + F.size("ys") - F.col("both")))
    return rows.select(F.col("y").alias("a"), "b").distinct()


def _described(lines: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """Of every distinct line: its hashes and place, the number of its words, their bitmap, the prefix, and two keys of the first
    comparison. Written, so that words are split and hashed once for both comparisons."""
    rows = settle(lines.select("a", "b", "first", F.sort_array(_hashed(F.col("line"))).alias("hashes")), ["hashes"])
    ends = [F.slice("hashes", 1, SMALLEST), F.slice("hashes", F.greatest(F.size("hashes") - (SMALLEST - 1), F.lit(1)), SMALLEST)]
    keys = F.array(*[F.xxhash64(F.lit(k), e) for k, e in enumerate(ends)])
    n = F.size("hashes")
    prefix = F.slice(_ordered(F.col("hashes"), ranks), 1, n - F.floor((percent * n + 99) / 100).cast("int") + 1)
    return checkpointed(rows.select("a", "b", "first.*", n.alias("n"), _parities(F.col("hashes")).alias("bitmap"), prefix.alias("prefix"), keys.alias("keys")))


def _similar(lines: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """Lines (a, b) that are similar to an earlier line; lines: distinct ones with their first place."""
    described = _described(lines, ranks, percent)
    near = described.select("a", F.struct("id", "line_no").alias("first"), "n", "bitmap", F.explode("keys").alias("key"))
    heads = near.groupBy("key").agg(F.min(F.struct("first", "a", "n", "bitmap")).alias("head"), F.count("*").alias("lines")).where("lines > 1").select("key", "head")
    pairs = near.join(heads, "key").select("head", F.struct("first", "a", "n", "bitmap").alias("line"))
    pairs = pairs.where((F.col("head.first") < F.col("line.first")) & _may_be_similar("head", "line", ["bitmap"], percent))
    pairs = pairs.select(F.col("head.a").alias("x"), F.col("line.a").alias("y")).distinct()
    done = checkpointed(_verified(pairs, lines, percent))

    rows = described.drop("keys").join(with_few(done, SENT_LINES).withColumn("done", F.lit(1)), ["a", "b"], "left")
    # one number holds the size, and whether the line is removed already
    sent = rows.select("a", "id", "line_no", "bitmap", (F.col("n") * 2 + F.coalesce("done", F.lit(0))).alias("n2"), F.posexplode("prefix").alias("pos", "word"))
    x, y = sent.alias("x"), sent.alias("y")
    nx, ny = F.floor(F.col("x.n2") / 2), F.floor(F.col("y.n2") / 2)
    needed = F.ceil(percent * (nx + ny) / (100 + percent))
    earlier = F.struct("x.id", "x.line_no") < F.struct("y.id", "y.line_no")
    # every condition names both sides, so that both sides are one shuffle
    wanted = (
        (F.col("x.word") == F.col("y.word"))
        & (F.col("y.n2") % 2 < F.when(F.col("x.a") == F.col("y.a"), 0).otherwise(1))
        & (F.least(nx - F.col("x.pos"), ny - F.col("y.pos")) >= needed)
        & (F.bit_count(F.col("x.bitmap").bitwiseXOR(F.col("y.bitmap"))) <= nx + ny - 2 * needed)
        & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
        & earlier
    )
    pairs = x.join(y, wanted).select(F.col("x.a").alias("x"), F.col("y.a").alias("y")).distinct()
    return done.union(_verified(pairs, lines, percent)).distinct()


def judge_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line that has words, by id and line number, and whether an earlier line removes it.

    A line is removed if an earlier one (in the order of ids, then of lines) has the same text, or a word set with 100 times the
    intersection at least `percent` times the union. Words are `[^\\x20\\x09-\\x0D]+`, unchanged; lines end at \\n.
    Columns: id_col, line_no (from 0, of all lines of the text), a and b (hashes of the line), removed.

    NULL and empty texts and lines without words give no rows. NULL ids come first in the order. Rows that repeat an id are parts
    of one document: equal lines at equal places are one place. An empty table gives no rows; other columns are not read.
    """
    lines = _lines(docs, id_col, text_col)
    firsts = checkpointed(lines.groupBy("a", "b").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count("*").alias("n")))
    repeated = firsts.where("n > 1").select("a", "b", "first")
    place = F.struct("id", "line_no")
    distinct = lines.join(with_few(repeated, SENT_LINES), ["a", "b"], "left").where(F.col("first").isNull() | F.col("first").eqNullSafe(place))
    distinct = distinct.select("a", "b", F.coalesce("first", place).alias("first"), "line")
    similar = checkpointed(_similar(distinct, _ranks(lines), percent)).withColumn("similar", F.lit(True))
    # lines that are alone and similar to none need no mark, so the marks are few
    marks = checkpointed(repeated.join(similar, ["a", "b"], "full"))
    rows = lines.select("id", "line_no", "a", "b").join(with_few(marks, SENT_LINES), ["a", "b"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    return rows.select(F.col("id").alias(id_col), "line_no", "a", "b", (F.coalesce("similar", F.lit(False)) | again).alias("removed"))


def remove_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, with removed lines (see judge_lines) taken out of their texts.

    Lines without words stay; a text all of whose lines go becomes empty; a NULL text stays NULL.
    """
    gone = judge_lines(docs, percent, id_col, text_col).where("removed").groupBy(id_col).agg(F.collect_set(F.struct("line_no", "a")).alias("__gone"))
    rows = docs.join(gone.withColumnRenamed(id_col, "__id"), docs[id_col].eqNullSafe(F.col("__id")), "left").drop("__id")
    left = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__gone", F.struct(i.alias("line_no"), F.xxhash64(x).alias("a"))))
    return rows.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).select(*docs.columns)
