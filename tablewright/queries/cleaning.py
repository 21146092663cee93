"""Queries: projections, filters, coercion and cleaning expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import numbers, patterns, text
from tablewright.functions.dates import date_parts, standardize_date
from tablewright.functions.tokens import AUDIT_TOKENS, CLEANER_TOKENS
from tablewright.operators import profile, shape
from tablewright.queries.registry import query, read
from tablewright.queries.views import CONTACTS, DIRTY_ORDERS, contacts, dirty_orders, sql_chosen, sql_in
from tablewright.functions.hashing import RANGE, draw


# ---- B: projections and coercion -----------------------------------------------------------------
@query("b1_drop_columns", f"WITH {DIRTY_ORDERS} SELECT row_id, price, priority, status, order_date, cust_id FROM dirty")
def _(spark, sf):
    return shape.drop_columns(dirty_orders(spark, sf), {"price_text": "drop", "date_text": "drop", "price": "smart_impute"})


@query("b2_blacklist_projection", f"WITH {DIRTY_ORDERS} SELECT row_id, price, status, order_date FROM dirty")
def _(spark, sf):
    return shape.without_blacklist(dirty_orders(spark, sf), ["price_text", "date_text", "cust_id", "priority", "price"], target="price")


@query("b3_token_to_null", f"WITH {DIRTY_ORDERS} SELECT row_id, CASE WHEN priority IN {sql_in(CLEANER_TOKENS)} THEN NULL ELSE priority END AS priority, "
       f"CASE WHEN price_text IN {sql_in(CLEANER_TOKENS)} THEN NULL ELSE price_text END AS price_text FROM dirty")
def _(spark, sf):
    return shape.replace_tokens(dirty_orders(spark, sf)).select("row_id", "priority", "price_text")


@query("b4_dirty_cells", f"WITH {DIRTY_ORDERS} SELECT row_id, price IS NULL AS price_dirty, "
       f"(priority IS NULL OR coalesce(trim(priority) IN {sql_in(AUDIT_TOKENS)}, false)) AS priority_dirty, "
       f"(price_text IS NULL OR coalesce(trim(price_text) IN {sql_in(AUDIT_TOKENS)}, false)) AS price_text_dirty FROM dirty")
def _(spark, sf):
    flagged = shape.dirty_flags(dirty_orders(spark, sf), ["price", "priority", "price_text"])
    return flagged.select("row_id", "price_dirty", "priority_dirty", "price_text_dirty")


_MIXED = f"""{DIRTY_ORDERS}, mixed AS (SELECT row_id, CASE WHEN {sql_chosen('row_id', 15, 0.25)} THEN 'n/a' ELSE ' ' || CAST(cust_id AS VARCHAR) || ' ' END AS mostly,
  CASE WHEN {sql_chosen('row_id', 16, 0.10)} THEN 'none' ELSE CAST(cust_id AS VARCHAR) END AS nearly, status FROM dirty)"""


def _mixed(spark, sf):
    df, k = dirty_orders(spark, sf), F.col("row_id")
    number = F.col("cust_id").cast("string")
    return df.select(
        "row_id", F.when(draw(k, 15) < int(round(0.25 * RANGE)), "n/a").otherwise(F.concat(F.lit(" "), number, F.lit(" "))).alias("mostly"),
        F.when(draw(k, 16) < int(round(0.10 * RANGE)), "none").otherwise(number).alias("nearly"), "status",
    )


@query("b5_hidden_numbers", f"""WITH {_MIXED}, r AS (SELECT count(try_cast(trim(mostly) AS DOUBLE)) / count(mostly) AS a, count(try_cast(trim(nearly) AS DOUBLE)) / count(nearly) AS b FROM mixed)
SELECT row_id, CASE WHEN a >= 0.7 THEN try_cast(trim(mostly) AS DOUBLE) END AS mostly, CASE WHEN b >= 0.7 THEN try_cast(trim(nearly) AS DOUBLE) END AS nearly, status FROM mixed, r""")
def _(spark, sf):
    return shape.coerce_hidden_numbers(_mixed(spark, sf))[0]


@query("b6_coercion_report", f"""WITH {_MIXED}, l AS (SELECT unnest([{{'c': 'mostly', 'v': mostly}}, {{'c': 'nearly', 'v': nearly}}, {{'c': 'status', 'v': status}}], recursive := true) FROM mixed),
s AS (SELECT c, count(v) AS n, count(try_cast(trim(v) AS DOUBLE)) AS p, count(*) FILTER (v IS NOT NULL AND v IS DISTINCT FROM CAST(try_cast(trim(v) AS DOUBLE) AS VARCHAR)) AS ch FROM l GROUP BY c)
SELECT c AS "column", n AS non_null, round(p / n, 6) AS ratio, p / n > 0.8 AS coerced, CASE WHEN p / n > 0.8 THEN ch ELSE 0 END AS changed_cells FROM s""")
def _(spark, sf):
    return shape.coercion_report(_mixed(spark, sf).drop("row_id")).withColumn("ratio", F.round("ratio", 6))


@query("b7_logical_bounds", f"WITH {CONTACTS} SELECT row_id, CASE WHEN customer_age < 0 THEN 0 ELSE customer_age END AS customer_age, balance FROM contacts")
def _(spark, sf):
    return shape.enforce_bounds(contacts(spark, sf).select("row_id", "customer_age", "balance"))


@query("b8_schema_alignment", "SELECT CAST(c_custkey AS BIGINT) AS row_id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS score, CAST(c_acctbal AS DOUBLE) AS balance FROM customer")
def _(spark, sf):
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("balance", T.DoubleType())])
    renamed = read(spark, sf, "customer").withColumnsRenamed({"c_custkey": "row_id", "c_mktsegment": "segment", "c_acctbal": "balance"})
    return shape.align_schema(renamed, schema, required=["row_id", "balance"])


def _screened(spark, sf):
    df = read(spark, sf, "part").withColumn("constant", F.lit("x"))
    df = df.withColumn("nearly_constant", F.when(F.col("p_partkey") == 1, "a").otherwise("b"))
    kinds = {"p_partkey": "numerical", "p_name": "categorical", "p_brand": "categorical", "p_type": "categorical", "p_size": "numerical", "constant": "categorical", "nearly_constant": "categorical"}
    return profile.feature_screen(df, "p_retailprice", kinds)


_SCREEN = """WITH t AS (SELECT *, 'x' AS constant, CASE WHEN p_partkey = 1 THEN 'a' ELSE 'b' END AS nearly_constant FROM part),
l AS (SELECT unnest([{'c': 'p_partkey', 'v': CAST(p_partkey AS VARCHAR)}, {'c': 'p_name', 'v': p_name}, {'c': 'p_brand', 'v': p_brand}, {'c': 'p_type', 'v': p_type},
  {'c': 'p_size', 'v': CAST(p_size AS VARCHAR)}, {'c': 'constant', 'v': constant}, {'c': 'nearly_constant', 'v': nearly_constant}], recursive := true) FROM t),
g AS (SELECT c, v, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT c, count(*) AS u, max(n) / sum(n) AS top FROM g GROUP BY c), t0 AS (SELECT count(*) AS total FROM part),
k AS (SELECT c, u, top, u / total AS ur, c IN ('p_partkey') AS idn, c IN ('p_partkey', 'p_size') AS num FROM s, t0)
SELECT c AS "column", u AS n_unique, round(top, 6) AS top_share, CASE WHEN u <= 1 THEN 'constant' WHEN top > 0.995 THEN 'near_constant' WHEN ur > 0.9 AND (NOT num OR idn) THEN 'id_like'
  WHEN idn AND ur > 0.5 THEN 'id_like' WHEN num THEN 'numeric' WHEN u <= 15 THEN 'low_cardinality' ELSE 'high_cardinality' END AS verdict FROM k"""


@query("b9_feature_screen", _SCREEN)
def _(spark, sf):
    return _screened(spark, sf).withColumn("top_share", F.round("top_share", 6))


@query("b10_cardinality_split", _SCREEN.replace("""SELECT c AS "column", u AS n_unique, round(top, 6) AS top_share,""", """SELECT "column", verdict FROM (SELECT c AS "column",""")
       + ") WHERE verdict IN ('low_cardinality', 'high_cardinality')")
def _(spark, sf):
    return _screened(spark, sf).where(F.col("verdict").isin("low_cardinality", "high_cardinality")).select("column", "verdict")


@query("b11_tenant_filter", "SELECT event_id, ts, event_type, value FROM events WHERE user_id = 7")
def _(spark, sf):
    return read(spark, sf, "events").where(F.col("user_id") == 7).select("event_id", "ts", "event_type", "value")


@query("b12_bounds_violations", f"""WITH {CONTACTS} SELECT row_id, 'age_bounds' AS rule FROM contacts WHERE customer_age < 0 OR customer_age > 120
UNION ALL SELECT row_id, 'salary_bounds' FROM contacts WHERE balance < 0""")
def _(spark, sf):
    return shape.bounds_violations(contacts(spark, sf), "row_id", "customer_age", "balance")


# ---- E: cleaning expressions ---------------------------------------------------------------------
def _sql_plain(x: str) -> str:
    digits = f"regexp_replace({x}, '[^\\d.]', '', 'g')"
    number = f"try_cast(CASE WHEN contains({digits}, '.') THEN split_part({digits}, '.', 1) || '.' || replace(regexp_replace({digits}, '^[^.]*\\.?', ''), '.', '') ELSE {digits} END AS DOUBLE)"
    factor = f"CASE upper(regexp_extract({x}, '{numbers.SUFFIX}', 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1.0 END"
    value = f"({number} * {factor} * CASE WHEN starts_with(ltrim({x}), '-') THEN -1.0 ELSE 1.0 END)"
    return f"(CASE WHEN contains({x}, '%') THEN {value} / 100.0 ELSE {value} END)"


def sql_parse(source: str, column: str, blend: str = "(lo + hi) / 2.0", strict: bool = False) -> str:
    """CTEs ending in parsed(row_id, number)."""
    body = "t" if strict else f"CASE WHEN regexp_extract(t, '{numbers.ACCOUNTING}', 1) <> '' THEN regexp_extract(t, '{numbers.ACCOUNTING}', 1) ELSE t END"
    negate = "false" if strict else f"regexp_extract(t, '{numbers.ACCOUNTING}', 1) <> ''"
    vocabulary = numbers.VOCABULARY if strict else numbers.SIGNED_VOCABULARY
    extra = "" if strict else f" OR (regexp_matches(rest, '(?i)^[kmb]{{2}}$') AND lt <> '')"
    signs, blanks = numbers.CURRENCY + numbers.BLANKS, numbers.BLANKS
    return f"""p0 AS (SELECT row_id, trim(translate({column}, '{numbers.ARABIC_DIGITS}', '{numbers.WESTERN_DIGITS}')) AS t FROM {source}),
p1 AS (SELECT row_id, {body} AS b, {negate} AS neg FROM p0),
s0 AS (SELECT *, replace(lower(b), 'to', '-') AS even FROM p1),
s1 AS (SELECT *, rtrim(ltrim(split_part(even, '-', 1), '{signs}'), '{blanks}') AS l, CASE WHEN contains(even, '-') THEN regexp_extract(ltrim(substr(even, instr(even, '-') + 1), '{signs}'), '^[0-9.,]+[{numbers.MAGNITUDES}]?') ELSE '' END AS h FROM s0),
s2 AS (SELECT *, h <> '' AND rtrim(l, '{numbers.MAGNITUDES}') <> '' AND translate(rtrim(l, '{numbers.MAGNITUDES}'), '0123456789.,', '') = '' AND length(l) - length(rtrim(l, '{numbers.MAGNITUDES}')) <= 1 AS two FROM s1),
p2 AS (SELECT *, regexp_replace(b, '{vocabulary}', '', 'g') AS rest, CASE WHEN two THEN l ELSE '' END AS lt, CASE WHEN two THEN h ELSE '' END AS ht FROM s2),
p3 AS (SELECT *, {_sql_plain('lt')} AS lo, {_sql_plain('ht')} AS hi, {_sql_plain('b')} AS one FROM p2),
p4 AS (SELECT *, CASE WHEN regexp_matches(b, '{numbers.SCIENTIFIC}') THEN try_cast(b AS DOUBLE) WHEN lt <> '' AND lo IS NOT NULL AND hi IS NOT NULL THEN {blend} ELSE one END AS v FROM p3),
parsed AS (SELECT row_id, CASE WHEN b <> '' AND (rest = '' OR regexp_matches(rest, '(?i)^[kmbe]$'){extra}) THEN CASE WHEN neg THEN -abs(v) ELSE v END END AS number FROM p4)"""


@query("e1_parse_numbers", f"WITH {DIRTY_ORDERS}, {sql_parse('dirty', 'price_text')} SELECT row_id, round(number, 6) AS number FROM parsed")
def _(spark, sf):
    parsed = numbers.parse_numbers(dirty_orders(spark, sf).select("row_id", "price_text"), ["price_text"])
    return parsed.select("row_id", F.round("price_text", 6).alias("number"))


@query("e1_parse_numbers_weighted_strict", f"WITH {DIRTY_ORDERS}, {sql_parse('dirty', 'price_text', 'lo * 0.6 + hi * 0.4', True)} SELECT row_id, round(number, 6) AS number FROM parsed")
def _(spark, sf):
    parsed = numbers.parse_numbers(dirty_orders(spark, sf).select("row_id", "price_text"), ["price_text"], "weighted", strict_compat=True)
    return parsed.select("row_id", F.round("price_text", 6).alias("number"))


_DATES = "coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d-%m-%Y'), try_strptime(d, '%m-%d-%Y'), try_strptime(d, '%d-%b-%Y'))"


@query("e2_standardize_dates", f"WITH {DIRTY_ORDERS} SELECT row_id, {_DATES} AS day FROM (SELECT row_id, regexp_replace(trim(date_text), '[./\\s\\\\]', '-', 'g') AS d FROM dirty)")
def _(spark, sf):
    return dirty_orders(spark, sf).select("row_id", standardize_date(F.col("date_text")).alias("day"))


@query("e3_date_features", f"""WITH {DIRTY_ORDERS}, s AS (SELECT row_id, {_DATES} AS day FROM (SELECT row_id, regexp_replace(trim(date_text), '[./\\s\\\\]', '-', 'g') AS d FROM dirty))
SELECT row_id, CAST(year(day) AS DOUBLE) AS day_year, CAST(month(day) AS DOUBLE) AS day_month, CAST(day(day) AS DOUBLE) AS day_day, CAST(CAST(isodow(day) IN (6, 7) AS INTEGER) AS DOUBLE) AS day_is_weekend FROM s""")
def _(spark, sf):
    return dirty_orders(spark, sf).select("row_id", standardize_date(F.col("date_text")).alias("day")).select("row_id", *date_parts(F.col("day"), "day")).select("row_id", *[F.col(c).cast("double").alias(c) for c in ("day_year", "day_month", "day_day", "day_is_weekend")])


@query("e4_clean_email", f"WITH {CONTACTS} SELECT row_id, CASE WHEN regexp_matches(e, '^[\\w.-]+@[\\w.-]+\\.\\w+$') THEN e END AS email FROM (SELECT row_id, trim(lower(email)) AS e FROM contacts)")
def _(spark, sf):
    return contacts(spark, sf).select("row_id", patterns.clean_email(F.col("email")).alias("email"))


@query("e5_clean_phone", f"WITH {CONTACTS} SELECT row_id, CASE WHEN length(p) >= 4 THEN p END AS phone FROM (SELECT row_id, regexp_replace(trim(phone), '[^\\d+]', '', 'g') AS p FROM contacts)")
def _(spark, sf):
    return contacts(spark, sf).select("row_id", patterns.clean_phone(F.col("phone")).alias("phone"))


_ARABIC_TEXT = "'السيارة إلى الشاطئ أُخرى ' || text"


@query("e6_normalize_arabic", f"""SELECT doc_id, trim(regexp_replace(translate(regexp_replace(lower({_ARABIC_TEXT}), '[\\x{{064B}}-\\x{{0652}}]', '', 'g'), 'أإآىة', 'اااايه'), '\\s+', ' ', 'g')) AS plain
FROM documents""".replace("'اااايه'", "'ااايه'"))
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.normalize_arabic(F.concat(F.lit("السيارة إلى الشاطئ أُخرى "), "text")).alias("plain"))


@query("e7_comparable_arabic", f"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(translate({_ARABIC_TEXT} || ' ٣٤', 'أإآة', 'اااه'), '{numbers.ARABIC_DIGITS}', '{numbers.WESTERN_DIGITS}'), '\\p{{Nd}}', '', 'g'), '\\s+', ' ', 'g')) AS plain
FROM documents""")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.comparable_arabic(F.concat(F.lit("السيارة إلى الشاطئ أُخرى "), "text", F.lit(" ٣٤"))).alias("plain"))


@query("e8_pattern_template", """WITH v AS (SELECT 'C-' || c_nationkey || '/' || substr(c_name, 15) || '.X' AS v FROM customer),
m AS (SELECT regexp_replace(regexp_replace(substr(v, 3, length(v) - 4), '\\p{L}', '?', 'g'), '\\p{Nd}', '#', 'g') AS s FROM v)
SELECT 'C-' || s || '.X' AS template FROM (SELECT s, count(*) AS n FROM m GROUP BY s ORDER BY n DESC, s LIMIT 1)""")
def _(spark, sf):
    coded = F.concat(F.lit("C-"), F.col("c_nationkey").cast("string"), F.lit("/"), F.substring("c_name", 15, 100), F.lit(".X"))
    return profile.pattern_template(read(spark, sf, "customer").select(coded.alias("code")), "code")


@query("e9_id_sequence", """WITH v AS (SELECT regexp_extract(c_name, '^([^0-9]*)(\\d+)$', 1) AS p, try_cast(regexp_extract(c_name, '^([^0-9]*)(\\d+)$', 2) AS BIGINT) AS n, c_name FROM customer)
SELECT 'c_name' AS "column", count(*) = count(DISTINCT c_name) AND min(p) = max(p) AND bool_and(n IS NOT NULL) AS is_sequence, min(p) AS prefix, min(n) AS start FROM v""")
def _(spark, sf):
    return profile.id_sequence(read(spark, sf, "customer"), "c_name")


@query("e10_key_like_columns", """WITH l AS (SELECT unnest([{'c': 'p_name', 'v': p_name}, {'c': 'p_brand', 'v': p_brand}, {'c': 'p_type', 'v': p_type}, {'c': 'tag', 'v': 'A' || p_partkey}], recursive := true) FROM part)
SELECT c AS "column", bool_and(regexp_matches(v, '^[A-Za-z0-9_-]+$')) AND bool_or(regexp_matches(v, '[A-Za-z]')) AND bool_or(regexp_matches(v, '\\d')) AND count(DISTINCT v) / count(v) > 0.7 AS is_key FROM l GROUP BY c""")
def _(spark, sf):
    df = read(spark, sf, "part").withColumn("tag", F.concat(F.lit("A"), F.col("p_partkey").cast("string")))
    return profile.key_like(df, ["p_name", "p_brand", "p_type", "tag"])


@query("e11_high_script", "SELECT doc_id, regexp_matches(text, '[\\x{04B1}-\\x{10FFFF}]') AS high_script FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.has_high_script(F.col("text")).alias("high_script"))


_BYTES = "n_chars * n_chars * (doc_id % 13)"


def _sql_size(b: str) -> str:
    arms = ""
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        v = f"({b} / {float(1024 ** i)!r}::DOUBLE)"
        arms += f" WHEN {v} < 1024 THEN CASE WHEN abs({v} - round_even({v}, 0)) < 0.05 THEN CAST(CAST(round_even({v}, 0) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {v}) END || ' {unit}'"
    return f"CASE WHEN {b} = 0 THEN 'Unknown size'{arms} END"


@query("e12_size_and_row_estimate", f"""SELECT doc_id, {_sql_size('b')} AS size_text, CASE WHEN b = 0 THEN 5000 WHEN task = 'nlp' THEN greatest(100, floor(b / 400)) WHEN task = 'computer_vision' THEN greatest(50, floor(b / 153600))
  ELSE greatest(200, floor(b / 120)) END AS estimated_rows FROM (SELECT doc_id, {_BYTES} AS b, (['nlp', 'computer_vision', 'regression'])[doc_id % 3 + 1] AS task FROM documents)""")
def _(spark, sf):
    size = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 13)
    task = F.element_at(F.array(F.lit("nlp"), F.lit("computer_vision"), F.lit("regression")), (F.col("doc_id") % 3 + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", size.alias("b"), task.alias("task")).select(
        "doc_id", numbers.size_text(F.col("b")).alias("size_text"), numbers.estimated_rows(F.col("b"), F.col("task")).cast("double").alias("estimated_rows"))


@query("e13_language_and_task_tags", """WITH t AS (SELECT doc_id, lower(text) AS low, text, [lower(source), lower(lang)] AS tags FROM documents)
SELECT doc_id, CASE WHEN list_contains(tags, 'arabic') OR contains(low, 'arabic') OR regexp_matches(text, '[\\x{04B1}-\\x{10FFFF}]') THEN 'arabic'
  WHEN list_contains(tags, 'multilingual') OR list_contains(tags, 'translation') OR contains(low, 'multilingual') THEN 'multilingual' ELSE 'english' END AS language,
CASE WHEN list_has_any(tags, ['regression', 'prediction', 'forecast']) OR regexp_matches(low, 'price|house') THEN 'regression'
  WHEN list_has_any(tags, ['nlp', 'text', 'sentiment', 'translation']) OR regexp_matches(low, 'nlp|text|sentiment|summarization|corpus') THEN 'nlp'
  WHEN list_has_any(tags, ['image', 'cv', 'computer-vision', 'detection', 'segmentation']) OR regexp_matches(low, 'image|detection|vision|object') THEN 'computer_vision' ELSE 'classification' END AS task
FROM t""")
def _(spark, sf):
    tags = F.array(F.lower("source"), F.lower("lang"))
    return read(spark, sf, "documents").select(
        "doc_id", text.guess_language(F.col("text"), tags).alias("language"), text.guess_task(F.col("text"), F.lit(""), tags).alias("task"))


@query("e14_phone_guard", f"WITH {CONTACTS} SELECT row_id, CASE WHEN starts_with(phone, '+') AND contains(phone, '-') THEN '''' || phone ELSE phone END AS phone FROM contacts")
def _(spark, sf):
    return contacts(spark, sf).select("row_id", patterns.guard_phone(F.col("phone")).alias("phone"))
