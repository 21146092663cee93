"""Chunking, TF-IDF search, near-duplicate lookup, vector scores, catalog ranking and retrieval checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.text import has_high_script, words
from tablewright.operators.frames import with_few
from tablewright.operators.neighbours import block_search
from tablewright.session import checkpointed

# Header marks, ranking weights and modality vocabularies.
DEFAULT_HEADER = "Introduction"
HEADER_MARKS = "[#📌👥🌐🏆⚡📖🛠️]"
OVERLAP_WEIGHT = 0.4
SCORE_FLOOR = 0.05
DUPLICATE_COSINE = 0.93
#: Rows a table of terms may have to be sent to all tasks.
TERMS_SENT = 1_000_000
#: Words of a block of texts (8 MB), terms that a range of hashes is asked for at once, and terms of texts that meet in one group (32 MB).
BLOCK_TERMS = 1_000_000
RANGE_TERMS = 4_000_000
GROUP_TERMS = 2_000_000
#: Scores of documents and queries that a task holds at once: 16 MB.
SCORES_HELD = 2_000_000
RANK_WEIGHTS = {"semantic": 0.40, "task": 0.20, "modality": 0.15, "language": 0.15, "size": 0.10}
MODALITY_WORDS = {
    "tabular": ("tabular|csv|excel|regression|dataframe|columns", ["regression", "classification"]),
    "nlp": ("nlp|text|sentiment|summarization|corpus|translation|language", ["nlp"]),
    "vision": ("image|cv|computer-vision|detection|yolo|segmentation|images", ["computer_vision"]),
}


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def header_chunks(df: DataFrame, doc_id: str, text: str, label: str = "Section") -> DataFrame:
    """(doc_id, chunk_id, header, chunk): sections that start at lines beginning with `## ` or `### `.

    A split on the line break before a header needs no shuffle, however long the document.
    """
    sections = F.split(F.col(text), r"\n(?=###? )")
    rows = df.select(doc_id, F.posexplode(sections).alias("chunk_id", "section"))
    first_line = F.substring_index(F.col("section"), "\n", 1)
    is_header = F.col("section").rlike(r"^###? ")
    header = F.when(is_header, _strip(F.regexp_replace(first_line, HEADER_MARKS, ""))).otherwise(F.lit(DEFAULT_HEADER))
    body = _strip(F.col("section"))
    return rows.where(body != "").select(doc_id, "chunk_id", header.alias("header"), F.concat(F.lit(f"{label}: "), header, F.lit("\n\n"), body).alias("chunk"))


def term_counts(df: DataFrame, doc_id: list[str], text: str) -> DataFrame:
    return df.select(*doc_id, F.explode(words(F.col(text))).alias("term")).groupBy(*doc_id, "term").agg(F.count("*").alias("tf"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def tfidf_search(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, top_k: int = 3, block_rows: int = 1024) -> DataFrame:
    """(query_id, doc_id, score, rank): cosine of TF-IDF vectors plus 0.4 × word overlap, top k above 0.05.

    Texts move to the task of their document once; there their terms are counted and written as 64-bit hashes. Terms of one document
    need no idf row, the others' are sent to all tasks up to a checked size. The queries' weights hold the square of the idf, so that
    documents hold plain counts over their norm, and only of features that are asked for. Blocks of documents meet blocks of
    queries and return k rows per query, so no (query, document) pair list is shuffled.
    """
    n_docs = docs.count()

    def hashed(kind: str, word: str) -> Column:
        return F.xxhash64(F.concat(F.lit(kind), word))

    def space_words(column: str) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(column), r"\s+"), lambda s: s != ""))

    q_words = queries.select(query_id, space_words(query_text).alias("parts"))
    q_words = q_words.select(query_id, F.explode("parts").alias("word"), (F.lit(OVERLAP_WEIGHT) / (F.size("parts") + 1)).alias("w"))
    q_words = q_words.select(query_id, hashed("w:", "word").alias("feature"), "w")
    q_tf = checkpointed(term_counts(queries, [query_id], query_text).select(query_id, hashed("t:", "term").alias("feature"), "tf"))
    asked = checkpointed(q_tf.select("feature").union(q_words.select("feature")).distinct().withColumn("asked", F.lit(True)))

    # a word counts once a row of docs, a term as often as it occurs
    split = docs.repartition(F.col(doc_id)).select(doc_id, words(F.col(text)).alias("terms"), space_words(text).alias("parts"))
    both = F.array(F.struct(F.lit("t:").alias("kind"), F.col("terms").alias("all")), F.struct(F.lit("w:").alias("kind"), F.col("parts").alias("all")))
    split = split.select(doc_id, F.explode(both).alias("side")).select(doc_id, "side.kind", F.explode("side.all").alias("word"))
    counts = split.groupBy(doc_id, (F.col("kind") == "t:").alias("is_term"), F.xxhash64(F.concat("kind", "word")).alias("feature")).agg(F.count("*").alias("tf"))
    counts = counts.join(with_few(asked, TERMS_SENT), "feature", "left").where(F.col("is_term") | F.col("asked"))
    tf = checkpointed(counts.select(doc_id, "feature", "is_term", F.coalesce("asked", F.lit(False)).alias("asked"), "tf"))

    held = tf.where("is_term").groupBy("feature").agg(F.count("*").alias("df"), F.first("asked").alias("asked"))
    known = checkpointed(held.where((F.col("df") > 1) | F.col("asked")).select("feature", "asked", smooth_idf(F.lit(float(n_docs)), F.col("df")).alias("idf")))
    idf = known.select("feature", "idf")
    alone = smooth_idf(F.lit(float(n_docs)), F.lit(1))
    w = F.col("tf") * F.coalesce("idf", alone)
    norms = tf.where("is_term").join(with_few(idf, TERMS_SENT), "feature", "left").groupBy(doc_id).agg(F.sqrt(F.sum(w * w)).alias("norm"))
    # terms and words of rows without an id are not one document
    side = F.when(F.col(doc_id).isNull(), F.col("is_term"))
    d_packed = tf.where("asked").groupBy(doc_id, side.alias("side")).agg(
        F.collect_list(F.struct("feature", "is_term", "tf")).alias("held")).join(norms.withColumnRenamed(doc_id, "__id"), F.col(doc_id).eqNullSafe(F.col("__id")), "left")
    value = F.transform("held", lambda x: F.when(x["is_term"], x["tf"] / F.col("norm")).otherwise(x["tf"].cast("double")))
    d_packed = d_packed.select(doc_id, F.col("held.feature").alias("f"), value.alias("v"))

    q_tf = q_tf.join(known.where("asked").select("feature", "idf"), "feature").withColumn("w", F.col("tf") * F.col("idf"))
    q_norm = q_tf.groupBy(query_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q_terms = q_tf.join(q_norm, query_id).select(query_id, "feature", (F.col("w") * F.col("idf") / F.col("norm")).alias("w"))
    q_packed = q_terms.unionByName(q_words).groupBy(query_id).agg(F.collect_list("feature").alias("f"), F.collect_list("w").alias("v"))

    schema = f"query {dict(queries.dtypes)[query_id]}, doc {dict(docs.dtypes)[doc_id]}, score double"

    def kernel(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame(columns=["query", "doc", "score"])
        q, d = q.sort_values(query_id), d.sort_values(doc_id)
        vocabulary, rows = np.unique(np.concatenate(q["f"].to_list()), return_inverse=True)
        # the queries of each feature lie together
        by_feature = np.argsort(rows, kind="stable")
        asking = np.repeat(np.arange(len(q)), [len(x) for x in q["f"]])[by_feature]
        asked_weight = np.concatenate(q["v"].to_list())[by_feature]
        starts = np.searchsorted(rows[by_feature], np.arange(len(vocabulary) + 1))
        lengths = [len(x) for x in d["f"]]
        features, weights = np.concatenate(d["f"].to_list()), np.concatenate(d["v"].to_list())
        owner = np.repeat(np.arange(len(d)), lengths)
        place = np.minimum(np.searchsorted(vocabulary, features), len(vocabulary) - 1)
        known = vocabulary[place] == features
        place, weights, owner = place[known], weights[known], owner[known]
        edges = np.searchsorted(owner, np.arange(len(d) + 1))
        step = max(1, SCORES_HELD // len(q))
        parts = []
        for low in range(0, len(d), step):
            high = min(len(d), low + step)
            own = slice(edges[low], edges[high])
            times = starts[place[own] + 1] - starts[place[own]]
            met = np.repeat(starts[place[own]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            cell = np.repeat(owner[own] - low, times) * len(q) + asking[met]
            scores = np.bincount(cell, np.repeat(weights[own], times) * asked_weight[met], (high - low) * len(q)).reshape(high - low, len(q))
            order = -np.round(scores, 12)
            last = min(top_k, high - low) - 1
            # all rows that tie with the last one stay until ids decide
            doc, query = np.nonzero((order <= np.partition(order, last, axis=0)[last]) & (scores > SCORE_FLOOR))
            sorted_rows = np.lexsort((doc, order[doc, query], query))
            doc, query = doc[sorted_rows], query[sorted_rows]
            first = np.arange(len(query)) - np.searchsorted(query, query) < top_k
            doc, query = doc[first], query[first]
            parts.append(pd.DataFrame({"query": q[query_id].to_numpy()[query], "doc": d[doc_id].to_numpy()[low + doc], "score": scores[doc, query]}))
        return pd.concat(parts, ignore_index=True)

    found = block_search(q_packed, d_packed, query_id, doc_id, kernel, schema, block_rows, (queries.count(), n_docs))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "doc")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return ranked.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score", "rank")


def near_duplicate_queries(
    df: DataFrame, query_id: str, tenant: str, text: str, cosine: float = DUPLICATE_COSINE, met: list[DataFrame] | None = None,
    block_terms: int = BLOCK_TERMS, group_terms: int = GROUP_TERMS,
) -> DataFrame:
    """(query_id, match_id, score): for every query, its best earlier query of the same tenant with TF-IDF cosine above the limit.

    Equal texts (by SHA-256) are one node whatever their number (an exact match scores 1). Between distinct texts
    prefix filtering (Bayardo et al., WWW 2007) joins only on the rare terms that any pair above
    the limit must share. What a pair shares in its prefixes,
    and what both have beyond the one that ends first, bound its cosine; pairs that the bound leaves are verified exactly.
    Texts are shuffled once and become blocks of hashed terms (64 bits, of tenant and word). Pairs of texts that are alike
    meet in one group, so a text moves once a group and not once a pair.
    `met` takes the pairs that are verified, for tests and tuning.
    """
    clean = _strip(F.lower(F.col(text)))
    rows = df.repartition(_width(df)).select(F.col(query_id).alias("query"), F.col(tenant).alias("tenant"), clean.alias("body"))
    marked = checkpointed(rows.withColumn("same", F.sha2("body", 256)))
    kind = dict(rows.dtypes)
    names = marked.groupBy("tenant", "same").agg(F.min("query").alias("node"))
    sizes = checkpointed(names.groupBy("tenant").agg(F.count("*").cast("double").alias("n")))
    nodes = marked.where(F.col("tenant").isNotNull()).groupBy("tenant", "same").agg(F.min("query").alias("node"), F.first("body").alias("body"))
    # texts of one repeated id are one node
    several = checkpointed(names.where(F.col("node").isNotNull()).groupBy("tenant", "node").agg(F.count("*").alias("k")).where(F.col("k") > 1).drop("k"))
    if several.limit(1).count():
        merged = nodes.join(several, ["tenant", "node"], "left_semi").groupBy("tenant", "node").agg(F.concat_ws("\n", F.collect_list("body")).alias("body"))
        nodes = nodes.join(several, ["tenant", "node"], "left_anti").select("tenant", "node", "body").unionByName(merged)
    hashed = nodes.select("tenant", "node", F.transform(words(F.col("body")), lambda w: F.xxhash64("tenant", w)).alias("words"))
    blocks = _term_blocks(hashed.join(with_few(sizes, TERMS_SENT), "tenant"), kind["tenant"], kind["query"], block_terms)
    # slack for the rounding of running sums
    limit = cosine * cosine - 1e-5
    vectors = checkpointed(_weighted_texts(blocks, kind["tenant"], kind["query"], limit))

    posted = vectors.select("doc", "node", "end_df", "end_term", "end_left", F.explode(F.arrays_zip("term", "left", "weight")).alias("t"))
    posted = posted.select("doc", "node", "end_df", "end_term", "end_left", "t.term", "t.left", "t.weight")
    later, earlier = (posted.select("term", *[F.col(c).alias(f"{side}_{c}") for c in posted.columns if c != "term"]) for side in "le")
    # all that is shared in both prefixes counts; what is shared besides is beyond the end of the prefix that ends first
    ends_first = (F.col("l_end_df") < F.col("e_end_df")) | ((F.col("l_end_df") == F.col("e_end_df")) & (F.col("l_end_term") <= F.col("e_end_term")))
    l_after, e_after = (F.col(f"{s}_left") - F.col(f"{s}_weight") * F.col(f"{s}_weight") for s in "le")
    beyond = F.when(ends_first, F.col("l_end_left") * e_after).otherwise(F.col("e_end_left") * l_after)
    shared = later.join(earlier, "term").where(F.col("e_node") < F.col("l_node"))
    pairs = shared.groupBy(F.col("l_doc").alias("later"), F.col("e_doc").alias("earlier")).agg(F.sum(F.col("l_weight") * F.col("e_weight")).alias("dot"), F.min(beyond).alias("beyond"))
    pairs = checkpointed(pairs.where(F.col("dot") + F.sqrt(F.greatest("beyond", F.lit(0.0))) >= cosine - 1e-5).select("later", "earlier"))
    if met is not None:
        met.append(pairs)

    hits = _verified(pairs, vectors, kind["tenant"], kind["query"], group_terms).where(F.col("score") > cosine)
    best = hits.groupBy("tenant", F.col("later").alias("node")).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), F.col("earlier").alias("match"))).alias("top"))
    per_row = marked.select("query", "tenant", "same").join(names, ["tenant", "same"]).join(best, ["tenant", "node"], "left")
    exact = F.col("query") != F.col("node")
    return per_row.where(exact | F.col("top").isNotNull()).select(
        F.col("query").alias(query_id), F.when(exact, F.col("node")).otherwise(F.col("top.match")).alias("match_id"),
        F.when(exact, F.lit(1.0)).otherwise(-F.col("top.s")).alias("score"))


def _width(df: DataFrame) -> int:
    """Tasks for costly steps. Explicit: adaptive coalescing judges bytes."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _term_blocks(texts: DataFrame, tenant: str, node: str, block_terms: int) -> DataFrame:
    """Texts (tenant, node, words as hashes, n) as written blocks of about block_terms words: sorted distinct terms and counts of each text.

    Texts without an id are in blocks of their own (`known` false).
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            known = np.asarray(batch.column("node").is_valid())
            for side in (True, False):
                own = batch.filter(pa.array(known == side)) if known.all() != known.any() else batch if known.all() == side else batch.slice(0, 0)
                lengths = pc.fill_null(pc.list_value_length(own.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                # a piece ends where the next text would pass the size; a longer text is a piece of its own
                edges, at = np.concatenate([[0], np.cumsum(lengths)]), 0
                while at < len(lengths):
                    end = max(at + 1, int(np.searchsorted(edges, edges[at] + block_terms, "right")) - 1)
                    piece = own.slice(at, end - at)
                    words, owner = piece.column("words").flatten().to_numpy().copy(), np.repeat(np.arange(end - at), lengths[at:end])
                    for a, b in zip(edges[at:end] - edges[at], edges[at + 1 : end + 1] - edges[at], strict=True):
                        words[a:b].sort()
                    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])])[: len(words)])
                    if len(first):
                        lists = [pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), c) for c in (
                            piece.column("tenant"), piece.column("node"), piece.column("n"), pa.array(np.bincount(owner[first], minlength=end - at).astype(np.int32)))]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([number]), pa.array([side]), pa.array([len(first)]), *lists, pa.array([words[first].tobytes()], pa.binary()),
                            pa.array([np.diff(first, append=len(words)).astype(np.int32).tobytes()], pa.binary())],
                            names=["block", "known", "terms", "tenant", "node", "n", "size", "term", "tf"])
                        number += 1
                    at = end

    return checkpointed(texts.select("tenant", "node", "n", "words").mapInArrow(
        pack, f"block bigint, known boolean, terms bigint, tenant array<{tenant}>, node array<{node}>, n array<double>, size array<int>, term binary, tf binary"))


def _weighted_texts(blocks: DataFrame, tenant: str, node: str, limit: float) -> DataFrame:
    """One row a text that can have a near one: its terms that others hold too with weights of length one, and its prefix.

    A block asks each range of hashes once for the texts that hold its distinct terms, as one sorted value, and gets the counts back in the same order.
    """
    n_ranges = max(_width(blocks), -(-(blocks.agg(F.sum("terms")).first()[0] or 0) // RANGE_TERMS))

    def split(term: np.ndarray) -> np.ndarray:
        """Range by the upper 32 bits: sorted terms are sorted ranges."""
        return ((((term.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, known, term in zip(*(batch.column(c) for c in ("block", "known", "term")), strict=True):
                keys, held = np.unique(np.frombuffer(term.as_buffer(), np.int64), return_counts=True)
                found, start = np.unique(split(keys), return_index=True)
                edges = [*start, len(keys)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(found), pa.array(np.full(len(found), block.as_py())), pa.array([known.as_py()] * len(found)),
                    *[pa.array([a[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for a in (keys, held.astype(np.int32))]],
                    names=["range", "block", "known", "term", "held"])

    def answer(asked: pa.Table) -> pa.Table:
        known = np.asarray(asked.column("known"))
        terms, held = ([np.frombuffer(x.as_buffer(), kind) for x in asked.column(c)] for c, kind in (("term", np.int64), ("held", np.int32)))
        named, rest = np.flatnonzero(known), np.flatnonzero(~known)
        keys = np.unique(np.concatenate([np.zeros(0, np.int64), *[terms[i] for i in named]]))
        places, count = [np.searchsorted(keys, terms[i]) for i in named], np.zeros(len(keys), np.int64)
        for i, place in zip(named, places, strict=True):
            count[place] += held[i]
        if len(rest):
            # texts without an id are one node
            count += np.isin(keys, np.concatenate([terms[i] for i in rest]))
        given = [count[place].tobytes() for place in places]
        return pa.table({
            "block": pa.array(np.asarray(asked.column("block"))[named], pa.int64()), "range": pa.array(np.asarray(asked.column("range"))[named], pa.int64()), "df": pa.array(given, pa.binary())})

    asked = blocks.select("block", "known", "term").mapInArrow(ask, "range bigint, block bigint, known boolean, term binary, held binary")
    answers = asked.repartition(min(n_ranges, 4 * _width(blocks)), "range").groupBy("range").applyInArrow(answer, "block bigint, range bigint, df binary")
    answers = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "df"))).alias("df"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(c)[i] for c in batch.schema.names}
                term, tf = np.frombuffer(cell["term"].as_buffer(), np.int64), np.frombuffer(cell["tf"].as_buffer(), np.int32)
                n, size = cell["n"].values.to_numpy(), cell["size"].values.to_numpy()
                held = np.concatenate([np.frombuffer(x["df"].as_buffer(), np.int64) for x in cell["df"]])
                df = held[np.searchsorted(np.unique(term), term)]
                own = np.repeat(np.arange(len(size)), size)
                w = tf * (np.log((n[own] + 1) / (df + 1)) + 1)
                w /= np.sqrt(np.bincount(own, w * w, len(size)))[own]
                # rarest terms first, of equal ones in their order; a term stays while the mass from it on could still reach the limit
                order, starts = df << 32 | np.arange(len(df)), np.cumsum(size) - size
                for a, b in zip(starts, starts + size, strict=True):
                    order[a:b].sort()
                order &= (1 << 32) - 1
                mass = (w * w)[order]
                before = np.cumsum(mass) - mass
                filled = np.flatnonzero(size)
                base = np.zeros(len(size))
                base[filled] = before[starts[filled]]
                left = 1 - (before - base[own])
                prefix = left >= limit
                # the prefix is the start of a text's terms: its last one, and what is left after that
                last = starts + np.bincount(own, prefix, len(size)).astype(np.int64) - 1
                posted, common = prefix & (df[order] > 1), df > 1
                n_posted, n_common = (np.bincount(own, x, len(size)).astype(np.int64) for x in (posted, common))
                texts = np.flatnonzero(n_posted)
                if not len(texts):
                    continue
                at_posted, at_common = np.flatnonzero(posted), np.flatnonzero(common)
                lists = [pa.array(x) for x in (term[order][at_posted], left[at_posted], w[order][at_posted])]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_posted[texts])]).astype(np.int32))
                ends = np.cumsum(n_common)
                cut = [(ends[t] - n_common[t], ends[t]) for t in texts]
                terms, weights = term[at_common], w[at_common]
                at_end = order[last[texts]]
                yield pa.RecordBatch.from_arrays([
                    pa.array((cell["block"].as_py() << 24) + texts), cell["tenant"].values.take(pa.array(texts)), cell["node"].values.take(pa.array(texts)),
                    pa.array(n_common[texts]), *[pa.ListArray.from_arrays(offsets, x) for x in lists],
                    pa.array(df[at_end]), pa.array(term[at_end]), pa.array(left[last[texts]] - mass[last[texts]]),
                    *[pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (terms, weights)]],
                    names=["doc", "tenant", "node", "size", "term", "left", "weight", "end_df", "end_term", "end_left", "terms", "weights"])

    return blocks.where("known").drop("known", "terms").join(answers, "block").repartition(_width(blocks), "block").mapInArrow(
        weigh, f"doc bigint, tenant {tenant}, node {node}, size bigint, term array<bigint>, left array<double>, weight array<double>, "
        "end_df bigint, end_term bigint, end_left double, terms binary, weights binary")


def _verified(pairs: DataFrame, vectors: DataFrame, tenant: str, node: str, group_terms: int) -> DataFrame:
    """(tenant, later, earlier, score) of all pairs. Texts with the same least neighbour meet in one group; large groups are dealt by both sides."""
    both = pairs.select(F.col("later").alias("doc"), F.col("earlier").alias("other")).union(pairs.select(F.col("earlier").alias("doc"), F.col("later").alias("other")))
    label = both.groupBy("doc").agg(F.least("doc", F.min("other")).alias("label"))
    labelled = checkpointed(pairs.join(label.withColumnRenamed("doc", "earlier"), "earlier"))
    members = labelled.select("label", F.col("later").alias("doc")).union(labelled.select("label", F.col("earlier").alias("doc"))).distinct()
    held = checkpointed(members.join(vectors.select("doc", "size"), "doc").groupBy("label").agg(F.ceil(F.sum("size") / group_terms).alias("parts"), F.sum("size").alias("terms")))
    # small groups share one
    n_groups = max(_width(pairs), -(-2 * (held.agg(F.sum("terms")).first()[0] or 0) // group_terms))
    slot = F.when(F.col("parts") <= 1, F.pmod(F.xxhash64("label"), F.lit(n_groups))).otherwise(F.col("label") + n_groups)

    def part(side: str):
        return F.pmod(F.xxhash64(side), F.greatest("parts", F.lit(1)))

    dealt = checkpointed(labelled.join(held, "label").select(slot.alias("slot"), part("later").alias("a"), part("earlier").alias("b"), "later", "earlier"))
    keys = ["slot", "a", "b"]
    needed = dealt.select(*keys, F.col("later").alias("doc")).union(dealt.select(*keys, F.col("earlier").alias("doc"))).distinct()
    texts = needed.join(vectors.select("doc", "tenant", "node", "terms", "weights"), "doc")
    texts = texts.select(*[F.col(c).alias(c) for c in texts.columns])  # fresh column ids: both sides come from one table

    def score(asked: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("doc")
        names = texts["doc"].to_numpy()
        _, term = np.unique(np.frombuffer(b"".join(texts["terms"]), np.int64), return_inverse=True)
        weight = np.frombuffer(b"".join(texts["weights"]), float)
        edges = np.concatenate([[0], np.cumsum([len(x) // 8 for x in texts["terms"]])])
        asked = asked.sort_values(["earlier", "later"])
        a, b = np.searchsorted(names, asked["later"].to_numpy()), np.searchsorted(names, asked["earlier"].to_numpy())
        spread, scores, now = np.zeros(int(term.max(initial=-1)) + 1), np.zeros(len(asked)), -1
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if y != now:
                if now >= 0:
                    spread[term[edges[now] : edges[now + 1]]] = 0
                spread[term[edges[y] : edges[y + 1]]] = weight[edges[y] : edges[y + 1]]
                now = y
            scores[i] = spread[term[edges[x] : edges[x + 1]]] @ weight[edges[x] : edges[x + 1]]
        node = texts["node"].to_numpy()
        return pd.DataFrame({"tenant": texts["tenant"].to_numpy()[a], "later": node[a], "earlier": node[b], "score": scores})

    width = min(n_groups, 4 * _width(pairs))
    dealt, texts = dealt.repartition(width, *keys), texts.repartition(width, *keys)
    return dealt.groupBy(*keys).cogroup(texts.groupBy(*keys)).applyInPandas(score, f"tenant {tenant}, later {node}, earlier {node}, score double")


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine clipped to 0–1; 0.5 when a norm is zero or a vector is missing."""
    norms = F.sqrt(dot_product(a, a)) * F.sqrt(dot_product(b, b))
    value = dot_product(a, b) / F.nullif(norms, F.lit(0.0))
    return F.when(value.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def vector_scores(df: DataFrame, row_id: str, vector: str, query: list[float], k: int | None = None) -> DataFrame:
    """(row_id, score) against one query vector, optionally the top k."""
    literal = F.array(*[F.lit(float(v)) for v in query])
    scored = df.select(row_id, cosine_score(F.col(vector), literal).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), row_id).limit(k)


def rank_catalog(catalog: DataFrame, intent: dict, semantic: str = "semantic", top: int | None = 10) -> DataFrame:
    """Weighted relevance of catalog rows for a parsed intent (task_type, modality, language, max_rows, min_rows, query)."""
    title, description = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    tags = F.lower(F.coalesce(F.array_join("tags", " "), F.lit("")))
    task, language, rows = F.lower("task_type"), F.lower(F.coalesce("language", F.lit(""))), F.col("row_count")
    want = (intent.get("task_type") or "").lower()
    if want:
        by_title = (title.contains("price") if want == "regression" else title.contains("text") if want == "nlp" else F.lit(False))
        task_fit = (
            F.when(F.coalesce(task, F.lit("")) == "", 0.7).when(task == want, 1.0).when(task.contains(want) | F.lit(want).contains(task), 0.7)
            .when(by_title, 0.8).otherwise(0.0)
        )
    else:
        task_fit = F.lit(0.7)
    modality = (intent.get("modality") or "").lower()
    if not modality:
        modality_fit = F.lit(0.8)
    elif modality in MODALITY_WORDS:
        pattern, tasks = MODALITY_WORDS[modality]
        modality_fit = F.when(tags.rlike(pattern) | description.rlike(pattern) | F.coalesce(task, F.lit("")).isin(tasks), 1.0).otherwise(0.3)
    else:
        modality_fit = F.lit(0.3)
    tongue = (intent.get("language") or "").lower()
    arabic_text = has_high_script(F.coalesce("description", F.lit("")))
    if tongue == "arabic":
        language_fit = F.when(language.contains("arabic") | tags.contains("arabic") | arabic_text, 1.0).otherwise(0.1)
    elif tongue == "english":
        language_fit = F.when(language.contains("english"), 1.0).otherwise(0.6)
    elif tongue:
        language_fit = F.lit(1.0)
    elif any(ord(ch) > 1200 for ch in intent.get("query", "")):
        language_fit = F.when(language.contains("arabic") | arabic_text, 1.0).otherwise(0.4)
    else:
        language_fit = F.lit(1.0)
    known = F.coalesce(rows, F.lit(0)) > 0
    size_fit = F.lit(1.0)
    if intent.get("max_rows"):
        ratio = rows / float(intent["max_rows"])
        size_fit = F.when(known, F.when(ratio <= 1.0, 1.0).when(ratio <= 1.5, 0.8).when(ratio <= 3.0, 0.5).when(ratio <= 10.0, 0.2).otherwise(0.05)).otherwise(1.0)
    if intent.get("min_rows"):
        size_fit = F.when(known, F.when(rows >= int(intent["min_rows"]), 1.0).otherwise(0.4)).otherwise(size_fit)
    w = RANK_WEIGHTS
    total = F.col(semantic) * w["semantic"] + task_fit * w["task"] + modality_fit * w["modality"] + language_fit * w["language"] + size_fit * w["size"]
    ranked = catalog.withColumns({
        "task_fit": task_fit, "modality_fit": modality_fit, "language_fit": language_fit, "size_fit": size_fit, "relevance": F.round(F.round(total * 100, 6), 1),
    })
    return ranked if top is None else ranked.orderBy(F.desc("relevance"), "id").limit(top)


def evaluate_retrieval(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per test: hit, language / task / size fit of its first result, mean relevance of all its results.

    `results`: (name, place, title, language, task_type, row_count, relevance); `expected`: (name, expected_language, expected_task, max_rows).
    """
    stats = results.groupBy("name").agg(
        F.min(F.struct("place", "title", "language", "task_type", "row_count")).alias("top"), F.round(F.avg("relevance"), 1).alias("avg_relevance"))
    joined = expected.join(stats, "name", "left")
    hit = F.col("top").isNotNull()
    task_ok = (F.col("top.task_type") == F.col("expected_task")) | ((F.col("expected_task") == "regression") & F.lower("top.title").contains("price"))
    size_ok = F.when(F.col("max_rows").isNull(), F.lit(True)).otherwise(F.coalesce((F.col("top.row_count") > 0) & (F.col("top.row_count") <= F.col("max_rows")), F.lit(False)))

    def flag(c: Column) -> Column:
        return (hit & F.coalesce(c, F.lit(False))).cast("double")

    return joined.select(
        "name", hit.cast("double").alias("hit"), flag(F.col("top.language") == F.col("expected_language")).alias("language_fit"),
        flag(task_ok).alias("task_fit"), flag(size_ok).alias("size_fit"), F.coalesce("avg_relevance", F.lit(0.0)).alias("avg_relevance"))


def keyword_filter(catalog: DataFrame, query: str) -> DataFrame:
    """Rows matching the query in title, description or tags, or through language and task synonyms; all rows when none match.

    Whether anything matches is one bounded look-up before the plan is built.
    """
    q = query.lower()
    tests = F.lower("title").contains(q) | F.lower("description").contains(q) | F.exists("tags", lambda t: t.contains(q))
    for needles, column, value in (
        (("arabic", "عرب"), "language", "arabic"), (("nlp", "text", "نصوص"), "task_type", "nlp"), (("cv", "image", "صورة"), "task_type", "computer_vision"),
        (("price", "regression", "سعر"), "task_type", "regression"),
    ):
        if any(n in q for n in needles):
            tests = tests | (F.col(column) == value)
    matched = F.coalesce(tests, F.lit(False))
    none = catalog.where(matched).limit(1).count() == 0
    return catalog if none else catalog.where(matched)
