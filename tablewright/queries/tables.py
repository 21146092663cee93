"""Queries: scans and previews, duplicates and unions, reports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tablewright.operators import dedup, delimited, reports
from tablewright.queries.registry import query, read
from tablewright.queries.views import CLEANED_ORDERS, DIRTY_ORDERS, REPEATED, cleaned_orders, dirty_orders, repeated_lines
from tablewright.session import shared_folder
from tablewright.sources.tables import csv_to_parquet, export_table, load_table


def scratch(spark, name: str) -> str:
    """New path for a written copy in the shared folder."""
    return f"{shared_folder(spark)}/copies/{uuid4().hex[:12]}-{name}"


# ---- A: scans ----------------------------------------------------------------------------------
_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("a1_load_by_extension", _CUSTOMERS)
def _(spark, sf):
    return load_table(spark, f"{sf}/customer.parquet")


@query("a4_parquet_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    return load_table(spark, f"{sf}/lineitem.parquet", "parquet").where(F.col("l_quantity") > 45).select("l_orderkey", "l_extendedprice")


def _round_trip(spark, sf, fmt: str, **options):
    path = scratch(spark, f"customer.{fmt}")
    export_table(read(spark, sf, "customer"), path, fmt)
    return load_table(spark, path, fmt, **options).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("a2_csv_round_trip", _CUSTOMERS)
def _(spark, sf):
    return _round_trip(spark, sf, "csv")


@query("a2_tsv_round_trip", _CUSTOMERS)
def _(spark, sf):
    return _round_trip(spark, sf, "tsv")


@query("a3_json_round_trip", _CUSTOMERS)
def _(spark, sf):
    return _round_trip(spark, sf, "json", multi_line=False)


@query("a5_orc_round_trip", _CUSTOMERS)
def _(spark, sf):
    return _round_trip(spark, sf, "orc")


@query("a6_xml_round_trip", _CUSTOMERS)
def _(spark, sf):
    return _round_trip(spark, sf, "xml")


@query("a7_feather_round_trip", _CUSTOMERS)
def _(spark, sf):
    return _round_trip(spark, sf, "feather")


@query("a10_export_parquet", _CUSTOMERS)
def _(spark, sf):
    return _round_trip(spark, sf, "parquet")


@query("a11_csv_to_parquet", _CUSTOMERS)
def _(spark, sf):
    source = scratch(spark, "source.csv")
    customers = read(spark, sf, "customer")
    export_table(customers, source, "csv")
    return csv_to_parquet(spark, source, scratch(spark, "converted.parquet"), schema=customers.schema)


_DELIMITED = """t AS (SELECT p_partkey, (['	', '|', ',', ' '])[p_partkey % 4 + 1] AS m, p_name, p_brand, p_size FROM part),
d AS (SELECT p_partkey, m, ['a', 'b', 'c'] AS r0, [replace(p_name, ' ', '_'), replace(p_brand, ' ', '_')] AS r1, [CAST(p_size AS VARCHAR), 'x', 'y', 'z'] AS r2 FROM t)"""


@query("a12_delimited_text", f"""WITH {_DELIMITED} SELECT p_partkey, CAST(0 AS INTEGER) AS row, 'a~b~c' AS cells FROM d UNION ALL SELECT p_partkey, 1, r1[1] || '~' || r1[2] || '~' FROM d UNION ALL SELECT p_partkey, 2, r2[1] || '~x~y' FROM d""")
def _(spark, sf):
    mark = F.element_at(F.array(F.lit("\t"), F.lit("|"), F.lit(","), F.lit(" ")), (F.col("p_partkey") % 4 + 1).cast("int"))

    def safe(c: str):
        return F.replace(F.col(c), F.lit(" "), F.lit("_"))

    lines = F.concat_ws("\n", F.lit(""), F.concat_ws("", F.lit(" a"), mark, F.lit("b"), mark, F.lit("c")), F.concat(safe("p_name"), mark, safe("p_brand")),
                        F.lit("   "), F.concat(F.col("p_size").cast("string"), mark, F.lit("x"), mark, F.lit("y"), mark, F.lit("z")))
    docs = read(spark, sf, "part").select("p_partkey", lines.alias("body"))
    return delimited.text_tables(docs, "p_partkey", "body").select("p_partkey", "row", F.array_join("cells", "~").alias("cells"))


@query("a13_preview", "SELECT row_id, '{\"status\":\"' || o_orderstatus || '\",\"cust_id\":' || o_custkey || '}' AS record FROM (SELECT o_orderkey AS row_id, * FROM orders ORDER BY o_orderkey LIMIT 500)")
def _(spark, sf):
    df = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust_id"))
    return delimited.preview(df, "row_id", 500)


# ---- D: duplicates, unions, schema --------------------------------------------------------------
@query("d1_drop_duplicates", f"WITH {REPEATED} SELECT min(row_id) AS row_id, status, flag, quantity, year FROM repeated GROUP BY status, flag, quantity, year")
def _(spark, sf):
    return dedup.drop_duplicates_first(repeated_lines(spark, sf).drop("name"), "row_id")


@query("d2_drop_duplicates_ignoring_ids", f"WITH {REPEATED} SELECT min(row_id) AS row_id, 'order ' || min(row_id) AS name, status, flag, quantity, year FROM repeated GROUP BY status, flag, quantity, year")
def _(spark, sf):
    return dedup.drop_duplicates_ignoring_ids(repeated_lines(spark, sf), "row_id")


@query("d3_deletion_guard", f"""WITH {REPEATED}, s AS (SELECT count(*) AS b, (SELECT count(*) FROM (SELECT DISTINCT status, flag, quantity, year FROM repeated)) AS a FROM repeated)
SELECT b AS rows_before, a AS rows_after, b - a AS removed, round((b - a) / b * 100, 6) AS removed_pct, (b - a) / b * 100 > 5 AS exceeds_limit FROM s""")
def _(spark, sf):
    counts = dedup.duplicate_counts(repeated_lines(spark, sf), "row_id", ["name"])
    return dedup.deletion_guard(counts).withColumn("removed_pct", F.round("removed_pct", 6))


@query("d4_union_by_key", """WITH u AS (SELECT 0 AS source_rank, doc_id AS position, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'k' || (doc_id % 97) END AS id, 'u' || (doc_id % 211) AS url, n_chars FROM documents
UNION ALL SELECT 1, page_id, CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'k' || (page_id % 131) END, 'u' || (page_id % 307), length(html) FROM pages),
r AS (SELECT coalesce(id, url) AS key, *, row_number() OVER (PARTITION BY coalesce(id, url) ORDER BY source_rank, position) AS rn FROM u)
SELECT key, source_rank, position, id, url, n_chars FROM r WHERE rn = 1""")
def _(spark, sf):
    def text(prefix: str, c: str, n: int):
        return F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))

    one = read(spark, sf, "documents").select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 3 != 0, text("k", "doc_id", 97)).alias("id"), text("u", "doc_id", 211).alias("url"), "n_chars")
    two = read(spark, sf, "pages").select(F.col("page_id").alias("position"), F.when(F.col("page_id") % 2 != 0, text("k", "page_id", 131)).alias("id"), text("u", "page_id", 307).alias("url"), F.length("html").cast("bigint").alias("n_chars"))
    return dedup.union_by_key([one, two], F.coalesce("id", "url"))


@query("d5_schema_changes", "SELECT * FROM (VALUES ('row_id', 'bigint', 'bigint', 'PRESERVED'), ('price', 'double', 'double', 'PRESERVED'), ('price_text', 'string', 'N/A', 'DROPPED'), ('priority', 'string', 'string', 'PRESERVED'), "
       "('status', 'string', 'string', 'PRESERVED'), ('date_text', 'string', 'string', 'PRESERVED'), ('order_date', 'timestamp_ntz', 'timestamp_ntz', 'PRESERVED'), ('cust_id', 'bigint', 'string', 'MUTATED'), ('checked', 'N/A', 'int', 'ADDED')) "
       "t(\"column\", before_type, after_type, status)")
def _(spark, sf):
    return dedup.schema_changes(dirty_orders(spark, sf), cleaned_orders(spark, sf))


_CAT_OLD = "old AS (SELECT doc_id AS id, 'title ' || doc_id AS title, lang AS language, n_chars AS row_count, doc_id % 10 / 10 AS quality_score FROM documents)"
_CAT_NEW = "new AS (SELECT page_id * 7 AS id, 'page ' || page_id AS title, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'xx' END AS language, CASE WHEN page_id % 5 = 0 THEN 0 ELSE length(html) END AS row_count, page_id % 7 / 10 AS quality_score FROM pages)"


@query("d6_catalog_upsert", f"""WITH {_CAT_OLD}, {_CAT_NEW} SELECT coalesce(o.id, n.id) AS id, coalesce(o.title, n.title) AS title, coalesce(n.language, o.language) AS language, CAST(coalesce(nullif(n.row_count, 0), o.row_count) AS DOUBLE) AS row_count,
CASE WHEN o.quality_score IS NULL THEN n.quality_score WHEN n.quality_score IS NULL THEN o.quality_score ELSE greatest(o.quality_score, n.quality_score) END AS quality_score FROM old o FULL JOIN new n ON o.id = n.id""")
def _(spark, sf):
    old = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("title "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("language"), F.col("n_chars").alias("row_count"), (F.col("doc_id") % 10 / 10).alias("quality_score"))
    new = read(spark, sf, "pages").select(
        (F.col("page_id") * 7).alias("id"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 4 != 0, "xx").alias("language"),
        F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.length("html")).cast("bigint").alias("row_count"), (F.col("page_id") % 7 / 10).alias("quality_score"))
    return dedup.upsert(old, new, "id", replace=["language", "row_count"], maximum=["quality_score"]).withColumn("row_count", F.col("row_count").cast("double"))


# ---- L: reports ----------------------------------------------------------------------------------
def jobs(spark, sf):
    """Events as job records: task_type and status from the event type, size and accuracy from value."""
    kind, value = F.col("event_type"), F.col("value")
    status = F.element_at(F.array(*[F.lit(s) for s in ("completed", "completed", "failed", "pending", "running")]), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf, "events").select(
        "event_id", F.col("ts").alias("created_at"), "user_id", kind.alias("task_type"), status.alias("status"), F.floor(value * 1000).cast("bigint").alias("file_size_bytes"),
        F.when(F.col("event_id") % 3 != 0, value / 5).alias("accuracy_rate"))


_JOBS = """jobs AS (SELECT event_id, ts AS created_at, user_id, event_type AS task_type, (['completed', 'completed', 'failed', 'pending', 'running'])[event_id % 5 + 1] AS status,
  CAST(floor(value * 1000) AS BIGINT) AS file_size_bytes, CASE WHEN event_id % 3 <> 0 THEN value / 5 END AS accuracy_rate FROM events)"""


@query("l1_kpis", f"""WITH {_JOBS}, s AS (SELECT count(*) FILTER (WHERE status = 'completed' AND task_type = 'click') AS total_click, count(*) FILTER (WHERE status = 'completed' AND task_type = 'error') AS total_error,
  CAST(sum(file_size_bytes) AS BIGINT) AS total_bytes, round(avg(accuracy_rate), 2) AS avg_accuracy, count(*) FILTER (WHERE status IN ('pending', 'processing', 'running')) AS active_jobs FROM jobs WHERE user_id = 7)
SELECT *, CASE WHEN total_bytes < 1048576 THEN CASE WHEN abs(total_bytes / 1024 - round_even(total_bytes / 1024, 0)) < 0.05 THEN CAST(CAST(round_even(total_bytes / 1024, 0) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', total_bytes / 1024) END || ' KB'
  ELSE CASE WHEN abs(total_bytes / 1048576 - round_even(total_bytes / 1048576, 0)) < 0.05 THEN CAST(CAST(round_even(total_bytes / 1048576, 0) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', total_bytes / 1048576) END || ' MB' END AS storage_used FROM s""")
def _(spark, sf):
    return reports.kpis(reports.for_tenant(jobs(spark, sf), 7), kinds=("click", "error"))


@query("l2_latest_per_type", f"WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, event_id DESC) AS rn FROM jobs WHERE user_id = 7) SELECT event_id, created_at, task_type, status FROM r WHERE rn = 1")
def _(spark, sf):
    mine = reports.for_tenant(jobs(spark, sf), 7).select("event_id", "created_at", "task_type", "status")
    return reports.latest_per(mine, "task_type", "created_at", "event_id")


@query("l3_most_recent", f"WITH {_JOBS} SELECT event_id, created_at, task_type, status FROM jobs ORDER BY created_at DESC, event_id DESC LIMIT 10")
def _(spark, sf):
    return reports.most_recent(jobs(spark, sf).select("event_id", "created_at", "task_type", "status"), "created_at", "event_id", 10)


@query("l4_counts_by_status_and_type", f"WITH {_JOBS} SELECT status, task_type, count(*) AS n FROM jobs GROUP BY status, task_type")
def _(spark, sf):
    return reports.counts_by(jobs(spark, sf), "status", "task_type")


@query("l5_daily_timeline", """WITH e AS (SELECT max(CAST(ts AS DATE)) AS last FROM events), d AS (SELECT CAST(unnest(generate_series(last - 6, last, INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT CAST(day AS VARCHAR) AS day, count(event_id) AS n FROM d LEFT JOIN (SELECT * FROM events WHERE user_id = 7) v ON CAST(v.ts AS DATE) = d.day GROUP BY d.day""")
def _(spark, sf):
    events = read(spark, sf, "events")
    last = events.agg(F.to_date(F.max("ts"))).first()[0]
    return reports.daily_timeline(reports.for_tenant(events, 7), "ts", F.lit(last)).withColumn("day", F.col("day").cast("string"))


@query("l6_token_sums", "SELECT event_type AS model_name, CAST(sum(floor(value)) AS BIGINT) AS prompt_tokens, CAST(sum(floor(value * 2)) AS BIGINT) AS completion_tokens, CAST(sum(floor(value) + floor(value * 2)) AS BIGINT) AS total_tokens, count(*) AS calls FROM events GROUP BY event_type")
def _(spark, sf):
    prompt, completion = F.floor("value").cast("bigint"), F.floor(F.col("value") * 2).cast("bigint")
    usage = read(spark, sf, "events").select(F.col("event_type").alias("model_name"), prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"))
    return reports.token_sums(usage, "model_name")


@query("l7_joined_count", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 11")
def _(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    return reports.joined_count(lines, orders, "order_id", 11)


@query("l8_answers_wide", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, sf):
    return reports.answers_wide(read(spark, sf, "events"), "props", ["event_id"])


@query("l9_history_export", f"WITH {_JOBS} SELECT event_id, strftime(created_at, '%Y-%m-%d %H:%M') AS created, upper(status) AS status, printf('%.1f', accuracy_rate) || '%' AS accuracy FROM jobs WHERE user_id = 7")
def _(spark, sf):
    return reports.history(reports.for_tenant(jobs(spark, sf), 7), "created_at", "event_id", {
        "event_id": F.col("event_id"), "created": F.date_format("created_at", "yyyy-MM-dd HH:mm"), "status": F.upper("status"), "accuracy": F.when(F.col("accuracy_rate").isNotNull(), F.format_string("%.1f%%", "accuracy_rate")),
    })


@query("l10_admin_totals", f"WITH {_JOBS} SELECT 'users' AS entity, 'all' AS status, count(*) AS n FROM customer UNION ALL SELECT 'jobs', 'all', count(*) FROM jobs UNION ALL SELECT 'jobs', status, count(*) FROM jobs GROUP BY status")
def _(spark, sf):
    return reports.admin_totals(read(spark, sf, "customer"), jobs(spark, sf))


@query("l11_last_messages", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text FROM r WHERE rn <= 6""")
def _(spark, sf):
    return reports.last_messages(read(spark, sf, "conversations"), "conv_id", "turn", "role", 6, {"assistant": "model"})
