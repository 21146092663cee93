"""Queries: chunking, retrieval, near-duplicate lookup, catalog ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import retrieval
from tablewright.queries.profiles import rounded
from tablewright.queries.registry import query, read
from tablewright.queries.views import modulo, sql_draw

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("n1_header_chunks", f"""WITH d AS (SELECT page_id, replace(replace(html, '<h2>', chr(10) || '## '), '<p>', chr(10)) AS body FROM pages),
s AS (SELECT page_id, generate_subscripts(p, 1) - 1 AS chunk_id, unnest(p) AS section FROM (SELECT page_id, string_split(replace(replace(body, chr(10) || '## ', chr(1) || '## '), chr(10) || '### ', chr(1) || '### '), chr(1)) AS p FROM d)),
h AS (SELECT *, CASE WHEN regexp_matches(section, '^###? ') THEN {_STRIP.format("regexp_replace(string_split(section, chr(10))[1], '" + retrieval.HEADER_MARKS + "', '', 'g')")} ELSE 'Introduction' END AS header, {_STRIP.format('section')} AS body FROM s)
SELECT page_id, chunk_id, header, 'Section: ' || header || chr(10) || chr(10) || body AS chunk FROM h WHERE body <> ''""")
def _(spark, sf):
    body = F.replace(F.replace("html", F.lit("<h2>"), F.lit("\n## ")), F.lit("<p>"), F.lit("\n"))
    return retrieval.header_chunks(read(spark, sf, "pages").select("page_id", body.alias("body")), "page_id", "body")


_TF = r"""dw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM dw GROUP BY ALL), nd AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, nd GROUP BY term, n), wd AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wd GROUP BY doc_id),
qw AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}')) AS term FROM benchmark), wq AS (SELECT item_id, term, count(*) * max(idf) AS w FROM qw JOIN idf USING (term) GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM wq GROUP BY item_id),
cs AS (SELECT item_id, doc_id, sum(wq.w * wd.w / qn.norm / dn.norm) AS s FROM wq JOIN wd USING (term) JOIN qn USING (item_id) JOIN dn USING (doc_id) GROUP BY item_id, doc_id),
qs AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS p FROM benchmark), ds AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS word FROM documents),
ov AS (SELECT item_id, doc_id, count(*) * 0.4 / max(k) AS s FROM (SELECT item_id, unnest(p) AS word, len(p) + 1 AS k FROM qs) JOIN ds USING (word) GROUP BY item_id, doc_id),
al AS (SELECT item_id, doc_id, sum(s) AS score FROM (SELECT * FROM cs UNION ALL SELECT * FROM ov) GROUP BY item_id, doc_id), rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM al WHERE score > 0.05)"""


@query("n2_tfidf_search", f"WITH {_TF} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 3")
def _(spark, sf):
    docs, queries = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    return rounded(retrieval.tfidf_search(docs, "doc_id", "text", queries, "item_id", "text", 3))


def _sql_duplicates(source: str) -> str:
    return rf"""WITH r AS ({source}), b AS (SELECT tenant, body, min(query_id) AS node FROM r GROUP BY ALL), sz AS (SELECT tenant, count(*) AS n FROM b GROUP BY tenant),
w AS (SELECT tenant, node, unnest(regexp_extract_all(body, '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}')) AS term FROM b), tf AS (SELECT tenant, node, term, count(*) AS tf FROM w GROUP BY ALL), idf AS (SELECT tenant, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf JOIN sz USING (tenant) GROUP BY tenant, term, n),
wd AS (SELECT tenant, node, term, tf * idf AS w FROM tf JOIN idf USING (tenant, term)), nm AS (SELECT tenant, node, sqrt(sum(w * w)) AS norm FROM wd GROUP BY ALL), v AS (SELECT tenant, node, term, w / norm AS w FROM wd JOIN nm USING (tenant, node)),
s AS (SELECT x.tenant, x.node AS later, y.node AS earlier, sum(x.w * y.w) AS score FROM v x JOIN v y ON x.tenant = y.tenant AND x.term = y.term AND y.node < x.node GROUP BY ALL HAVING sum(x.w * y.w) > {retrieval.DUPLICATE_COSINE}),
best AS (SELECT later, arg_min(earlier, (-round(score, 9), earlier)) AS match, max(round(score, 9)) AS score FROM s GROUP BY later)
SELECT query_id, CASE WHEN query_id <> node THEN node ELSE match END AS match_id, round(CASE WHEN query_id <> node THEN 1.0 ELSE score END, 6) AS score FROM r JOIN b USING (tenant, body) LEFT JOIN best ON later = node WHERE query_id <> node OR match IS NOT NULL"""


@query("n3_near_duplicate_queries", _sql_duplicates("SELECT conv_id * 100000 + turn AS query_id, role AS tenant, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS body FROM conversations"))
def _(spark, sf):
    df = read(spark, sf, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), "role", "text")
    return rounded(retrieval.near_duplicate_queries(df, "query_id", "role", "text"))


@query("n3_near_duplicate_documents", _sql_duplicates("SELECT doc_id AS query_id, lang AS tenant, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS body FROM documents"))
def _(spark, sf):
    return rounded(retrieval.near_duplicate_queries(read(spark, sf, "documents"), "doc_id", "lang", "text").withColumnRenamed("doc_id", "query_id"))


_V0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("n4_vector_scores", f"SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V0}))), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V0}) DESC, vec_id LIMIT 20")
def _(spark, sf):
    vectors = read(spark, sf, "embeddings")
    first = vectors.orderBy("vec_id").select("embedding").first()["embedding"]
    return rounded(retrieval.vector_scores(vectors, "vec_id", "embedding", first, 20))


INTENT = {"task_type": "nlp", "modality": "nlp", "language": "english", "max_rows": 2000, "query": "text"}
_TASKS = ["regression", "nlp", "computer_vision", "classification"]
_LANGS = "CASE lang WHEN 'en' THEN 'english' WHEN 'ar' THEN 'arabic' ELSE lang END"


def catalog(spark, sf):
    """Documents as catalog entries; relevance of the content from the embedding with the same number."""
    vectors = read(spark, sf, "embeddings")
    first = vectors.orderBy("vec_id").select("embedding").first()["embedding"]
    scores = retrieval.vector_scores(vectors, "vec_id", "embedding", first).select(F.col("vec_id").alias("id"), F.round("score", 6).alias("semantic"))
    docs = read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("set "), F.col("source")).alias("title"), F.col("text").alias("description"),
        F.when(F.col("lang") == "en", "english").when(F.col("lang") == "ar", "arabic").otherwise(F.col("lang")).alias("language"),
        F.element_at(F.array(*[F.lit(t) for t in _TASKS]), (modulo(F.col("doc_id"), 60, 4) + 1).cast("int")).alias("task_type"), F.array("source", "lang").alias("tags"), F.col("n_chars").alias("row_count"))
    return docs.join(scores, "id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.5)))


_CATALOG = f"""sc AS (SELECT vec_id AS id, round(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V0}))), 6) AS semantic FROM embeddings),
cat AS (SELECT doc_id AS id, 'set ' || source AS title, text AS description, {_LANGS} AS language, ({_TASKS})[({sql_draw('doc_id', 60)}) % 4 + 1] AS task_type, [source, lang] AS tags, n_chars AS row_count, coalesce(semantic, 0.5) AS semantic FROM documents LEFT JOIN sc ON sc.id = doc_id),
fit AS (SELECT *, CASE WHEN task_type = 'nlp' THEN 1.0 WHEN contains(lower(title), 'text') THEN 0.8 ELSE 0.0 END AS task_fit,
 CASE WHEN regexp_matches(lower(source_tags), 'nlp|text|sentiment|summarization|corpus|translation|language') OR regexp_matches(lower(description), 'nlp|text|sentiment|summarization|corpus|translation|language') OR task_type = 'nlp' THEN 1.0 ELSE 0.3 END AS modality_fit,
 CASE WHEN contains(lower(language), 'english') THEN 1.0 ELSE 0.6 END AS language_fit, CASE WHEN row_count <= 0 OR row_count / 2000 <= 1 THEN 1.0 WHEN row_count / 2000 <= 1.5 THEN 0.8 WHEN row_count / 2000 <= 3 THEN 0.5 WHEN row_count / 2000 <= 10 THEN 0.2 ELSE 0.05 END AS size_fit
 FROM (SELECT *, array_to_string(tags, ' ') AS source_tags FROM cat)),
ranked AS (SELECT *, round(round((0.40 * semantic + 0.20 * task_fit + 0.15 * modality_fit + 0.15 * language_fit + 0.10 * size_fit) * 100, 6), 1) AS relevance FROM fit)"""


@query("n5_rank_catalog", f"WITH {_CATALOG} SELECT id, task_fit, modality_fit, language_fit, size_fit, relevance FROM ranked ORDER BY relevance DESC, id LIMIT 10")
def _(spark, sf):
    return retrieval.rank_catalog(catalog(spark, sf), INTENT).select("id", "task_fit", "modality_fit", "language_fit", "size_fit", "relevance")


@query("n6_retrieval_evaluation", f"""WITH {_CATALOG}, t AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS place FROM ranked QUALIFY place <= 10), a AS (SELECT round(avg(relevance), 1) AS r FROM t)
SELECT 'english nlp' AS name, 1.0 AS hit, CAST(language = 'english' AS DOUBLE) AS language_fit, CAST(task_type = 'nlp' AS DOUBLE) AS task_fit, CAST(row_count > 0 AND row_count <= 2000 AS DOUBLE) AS size_fit, r AS avg_relevance FROM t, a WHERE place = 1
UNION ALL SELECT 'no result', 0.0, 0.0, 0.0, 0.0, 0.0""")
def _(spark, sf):
    from pyspark.sql.window import Window

    top = retrieval.rank_catalog(catalog(spark, sf), INTENT)
    placed = top.select(F.lit("english nlp").alias("name"), F.row_number().over(Window.orderBy(F.desc("relevance"), "id")).alias("place"), "title", "language", "task_type", "row_count", "relevance")  # ten rows
    expected = spark.createDataFrame([("english nlp", "english", "nlp", 2000), ("no result", "arabic", "nlp", None)], "name string, expected_language string, expected_task string, max_rows int")
    return retrieval.evaluate_retrieval(placed, expected)


@query("n7_keyword_filter", f"WITH {_CATALOG} SELECT id, task_type FROM cat WHERE contains(lower(title), 'text') OR contains(lower(description), 'text') OR list_bool_or(list_transform(tags, lambda t: contains(t, 'text'))) OR task_type = 'nlp'".replace("list_bool_or(", "list_contains(").replace("contains(t, 'text')))", "contains(t, 'text')), true)"))
def _(spark, sf):
    return retrieval.keyword_filter(catalog(spark, sf), "text").select("id", "task_type")
