"""Queries: fuzzy matching, outliers, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.hashing import RANGE, draw
from tablewright.functions.text import canonical, same
from tablewright.functions.tokens import CLEANER_TOKENS
from tablewright.operators import corrupt, forest, fuzzy, impute, outliers, shape
from tablewright.plans import cleaning
from tablewright.queries.cleaning import _DATES
from tablewright.queries.profiles import rounded
from tablewright.queries.registry import query, read
from tablewright.queries.views import CONTACTS, DIRTY_ORDERS, contacts, dirty_orders, modulo, sql_chosen, sql_draw, sql_in, sql_pick


# ---- F: spellings -----------------------------------------------------------------------------------
def misspelled(spark, sf, column: str = "p_type"):
    """Every fifth value or so loses a character or swaps two; at most two variants per position."""
    k, v = F.col("p_partkey"), F.col(column)
    at = F.pmod(draw(k, 18), (F.length(v) - 1).cast("bigint")).cast("int")
    head, tail = F.substring(v, F.lit(1), at), F.substring(v, at + 3, F.length(v))
    first, second = F.substring(v, at + 1, F.lit(1)), F.substring(v, at + 2, F.lit(1))
    broken = F.when(modulo(k, 19, 2) == 0, F.concat(head, second, tail)).otherwise(F.concat(head, second, first, tail))
    return read(spark, sf, "part").select(k.alias("row_id"), F.when(draw(k, 17) < int(round(0.2 * RANGE)), broken).otherwise(v).alias("label"))


def sql_misspelled(column: str = "p_type") -> str:
    k = "p_partkey"
    at = f"({sql_draw(k, 18)}) % (length({column}) - 1)"
    return f"""spelled AS (SELECT p_partkey AS row_id, CASE WHEN {sql_chosen(k, 17, 0.2)} THEN substr(v, 1, a) || CASE WHEN ({sql_draw(k, 19)}) % 2 = 0 THEN substr(v, a + 2, 1) ELSE substr(v, a + 2, 1) || substr(v, a + 1, 1) END || substr(v, a + 3)
  ELSE v END AS label FROM (SELECT p_partkey, {column} AS v, CAST({at} AS BIGINT) AS a FROM part))"""


@query("f1_similar_pairs", f"""WITH {sql_misspelled()}, d AS (SELECT DISTINCT label AS v FROM spelled)
SELECT x.v AS a, y.v AS b, round(1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v)), 6) AS score FROM d x JOIN d y ON x.v < y.v WHERE 1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v)) >= 0.75""")
def _(spark, sf):
    return rounded(fuzzy.similar_pairs(misspelled(spark, sf), "label", 0.75, "levenshtein"))


_MERGE = """r AS (SELECT label AS v, row_number() OVER (ORDER BY count(*) DESC, label) AS rn FROM spelled GROUP BY label),
step AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS bases, CAST([] AS VARCHAR[]) AS wrongs, CAST([] AS VARCHAR[]) AS rights
 UNION ALL SELECT i + 1, CASE WHEN hit IS NULL THEN list_append(bases, v) ELSE bases END, CASE WHEN hit IS NULL THEN wrongs ELSE list_append(wrongs, v) END, CASE WHEN hit IS NULL THEN rights ELSE list_append(rights, hit) END
 FROM (SELECT s.*, r.v, list_filter(s.bases, lambda b: round((1 - levenshtein(b, r.v) / greatest(length(b), length(r.v))) * 100) >= 78)[1] AS hit FROM step s JOIN r ON r.rn = s.i + 1)),
final AS (SELECT unnest(wrongs) AS wrong, unnest(rights) AS "right" FROM (SELECT * FROM step ORDER BY i DESC LIMIT 1))"""


@query("f1_typo_merge", f"WITH RECURSIVE {sql_misspelled()}, {_MERGE} SELECT row_id, coalesce(\"right\", label) AS label FROM spelled LEFT JOIN final ON label = wrong")
def _(spark, sf):
    return fuzzy.merge_typos(misspelled(spark, sf), "label", 78, "levenshtein")


@query("f1_typo_map_indel")
def _(spark, sf):
    return fuzzy.typo_map(misspelled(spark, sf), "label", 88, "indel")


@query("f2_consolidation_map")
def _(spark, sf):
    return fuzzy.consolidation_map(misspelled(spark, sf), "label")


@query("f3_correct_words", f"""WITH {sql_misspelled('p_name')}, v AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part),
w AS (SELECT row_id, generate_subscripts(p, 1) AS pos, unnest(p) AS word FROM (SELECT row_id, string_split(trim(regexp_replace(lower(label), '\\s+', ' ', 'g')), ' ') AS p FROM spelled)),
b AS (SELECT word, arg_min(term, (-s, term)) AS term FROM (SELECT d.word, v.term, 1 - levenshtein(d.word, v.term) / greatest(length(d.word), length(v.term)) AS s FROM (SELECT DISTINCT word FROM w WHERE length(word) >= 3) d, v) WHERE s >= 0.7 GROUP BY word)
SELECT row_id, string_agg(coalesce(b.term, w.word), ' ' ORDER BY pos) AS corrected FROM w LEFT JOIN b ON w.word = b.word GROUP BY row_id""")
def _(spark, sf):
    vocabulary = read(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct()
    return fuzzy.correct_words(misspelled(spark, sf, "p_name"), "label", "row_id", vocabulary, "term")


@query("f4_equivalence", f"""WITH {DIRTY_ORDERS}, d AS (SELECT row_id, price_text AS a, CAST(o_totalprice AS VARCHAR) AS b, date_text, order_date, regexp_replace(trim(date_text), '[./\\s\\\\]', '-', 'g') AS d FROM dirty JOIN orders ON row_id = o_orderkey),
e AS (SELECT *, try_cast(a AS DOUBLE) AS x, try_cast(b AS DOUBLE) AS y, {_DATES} AS p FROM d)
SELECT row_id, CASE WHEN a IS NULL THEN false WHEN x IS NOT NULL THEN abs(x - y) / greatest(abs(x), 1) <= 0.15 ELSE lower(trim(a)) = b END AS price_same, CASE WHEN p IS NULL THEN false ELSE CAST(p AS DATE) = CAST(order_date AS DATE) END AS date_same FROM e""")
def _(spark, sf):
    totals = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").cast("string").alias("total"))
    df = dirty_orders(spark, sf).where(F.col("row_id").isNotNull()).join(totals, "row_id")
    plain = F.when(F.col("price_text").rlike("[٠-٩]"), "arabic digits").otherwise(F.col("price_text"))
    cells = df.select("row_id", canonical(plain).alias("a"), canonical(F.col("total")).alias("b"), canonical(F.col("date_text")).alias("c"), canonical(F.date_format("order_date", "yyyy-MM-dd")).alias("d"))
    return cells.select("row_id", same(F.col("a"), F.col("b")).alias("price_same"), same(F.col("c"), F.col("d")).alias("date_same"))


# ---- G: outliers --------------------------------------------------------------------------------------
def _sql_rule(c: str, t: str) -> str:
    return f"""s AS (SELECT count({c}) AS n, skewness({c}) AS sk, quantile_cont({c}, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q, avg({c}) AS mu, stddev_samp({c}) AS sd FROM {t}), a AS (SELECT quantile_cont(abs({c} - q[3]), 0.5) AS mad FROM {t}, s),
o AS (SELECT *, CASE WHEN n < 15 THEN {c} < q[1] OR {c} > q[5] WHEN abs(sk) > 1.5 THEN {c} < q[2] - 1.5 * (q[4] - q[2]) OR {c} > q[4] + 1.5 * (q[4] - q[2])
  WHEN mad > 0 THEN abs(0.6745 * ({c} - q[3]) / mad) > 3 WHEN sd > 0 THEN abs(({c} - mu) / sd) > 3 ELSE false END AS far FROM {t}, s, a)"""


@query("g1_null_outliers", f"WITH {DIRTY_ORDERS}, {_sql_rule('price', 'dirty')} SELECT row_id, CASE WHEN far THEN NULL ELSE price END AS price FROM o")
def _(spark, sf):
    return outliers.null_outliers(dirty_orders(spark, sf).select("row_id", "price"), ["price"])


@query("g1_null_outliers_symmetric", f"WITH c AS (SELECT c_custkey AS row_id, CASE WHEN {sql_chosen('c_custkey', 20, 0.01)} THEN c_acctbal * 4 ELSE c_acctbal END AS balance FROM customer), {_sql_rule('balance', 'c')} SELECT row_id, CASE WHEN far THEN NULL ELSE balance END AS balance FROM o")
def _(spark, sf):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    df = read(spark, sf, "customer").select(k.alias("row_id"), F.when(draw(k, 20) < int(round(0.01 * RANGE)), v * 4).otherwise(v).alias("balance"))
    return outliers.null_outliers(df, ["balance"])


@query("g2_anomaly_flags")
def _(spark, sf):
    df = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", F.col("o_custkey").cast("double").alias("cust"))
    return forest.anomaly_flags(df, "row_id", ["o_totalprice", "cust"]).select("row_id", "is_anomaly")


_Q = "quantile_cont(CAST({0} AS DOUBLE), 0.5) AS m_{0}, quantile_cont(CAST({0} AS DOUBLE), 0.75) - quantile_cont(CAST({0} AS DOUBLE), 0.25) AS i_{0}"


@query("g3_robust_scale", f"WITH s AS (SELECT {_Q.format('p_size')}, {_Q.format('p_retailprice')} FROM part) SELECT p_partkey, round((p_size - m_p_size) / i_p_size, 6) AS p_size, round((p_retailprice - m_p_retailprice) / i_p_retailprice, 6) AS p_retailprice FROM part, s")
def _(spark, sf):
    return rounded(outliers.robust_scale(read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@query("g4_mass_outliers", f"""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {sql_draw('o_orderkey', 7)}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, round(CASE WHEN rn <= floor(n * 3 / 100) THEN o_totalprice * {sql_pick('o_orderkey', 107, [5.0, 10.0, -5.0])} ELSE o_totalprice END, 4) AS o_totalprice FROM o""")
def _(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(corrupt.mass_outliers(df, "o_orderkey", ["o_totalprice"], 3.0, exact=True), 4)


# ---- H: imputation --------------------------------------------------------------------------------------
_FILLED = f"filled AS (SELECT row_id, price, CASE WHEN priority IN {sql_in(CLEANER_TOKENS)} THEN NULL ELSE priority END AS priority FROM dirty)"


def _sql_fill(centre: str) -> str:
    return f"""WITH {DIRTY_ORDERS}, {_FILLED}, s AS (SELECT {centre} AS c, count(*) FILTER (WHERE price % 1 = 0) > count(*) FILTER (WHERE price % 1 <> 0) AS whole FROM filled), m AS (SELECT priority AS p FROM filled WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)
SELECT row_id, coalesce(price, CASE WHEN whole THEN round_even(c, 0) ELSE round_even(c, 2) END) AS price, coalesce(priority, p) AS priority FROM filled, s, m"""


def _gappy(spark, sf):
    return shape.replace_tokens(dirty_orders(spark, sf).select("row_id", "price", "priority"))


@query("h1_median_mode_fill", _sql_fill("quantile_cont(price, 0.5)"))
def _(spark, sf):
    return impute.fill_simple(_gappy(spark, sf), ["price", "priority"])


@query("h2_mean_mode_fill", _sql_fill("avg(price)"))
def _(spark, sf):
    return impute.fill_simple(_gappy(spark, sf), ["price", "priority"], "mean")


@query("h3_group_fill", f"""WITH t AS (SELECT c_custkey AS row_id, 'n' || c_nationkey AS nation, c_mktsegment AS segment, CASE WHEN {sql_chosen('c_custkey', 21, 0.15)} THEN NULL ELSE c_nationkey * 1.5 END AS rate FROM customer)
SELECT row_id, nation, segment, coalesce(rate, avg(rate) OVER (PARTITION BY nation)) AS rate FROM t""")
def _(spark, sf):
    k = F.col("c_custkey")
    df = read(spark, sf, "customer").select(
        k.alias("row_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.when(draw(k, 21) >= int(round(0.15 * RANGE)), F.col("c_nationkey") * 1.5).alias("rate"))
    return impute.fill_by_group(df, "rate", ["segment", "nation"])


@query("h4_model_fill_number")
def _(spark, sf):
    df = dirty_orders(spark, sf).select("row_id", "price", "status", "priority", F.year("order_date").alias("year"))
    return impute.fill_by_model(shape.replace_tokens(df), "price", "row_id")


@query("h4_model_fill_text")
def _(spark, sf):
    return impute.fill_by_model(contacts(spark, sf).select("row_id", "segment", "balance", "nation", "customer_age"), "segment", "row_id")


_KNN = ["balance", "customer_age", "nation"]


def _knn_input(spark, sf):
    k = F.col("row_id")
    return contacts(spark, sf).select(
        "row_id", F.when(draw(k, 22) >= int(round(0.05 * RANGE)), F.col("balance")).alias("balance"),
        F.when(draw(k, 23) >= int(round(0.05 * RANGE)), F.col("customer_age")).alias("customer_age"), F.col("nation").cast("double").alias("nation"), "segment")


def _sql_knn() -> str:
    columns = [*_KNN, "code"]
    shared = " + ".join(f"CAST(q.{c} IS NOT NULL AND d.{c} IS NOT NULL AS INTEGER)" for c in columns)
    squared = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in columns)
    gaps = " OR ".join(f"{c} IS NULL" for c in columns)
    parts = [f"""n_{c} AS (SELECT id, avg(v) AS m FROM (SELECT q.row_id AS id, d.{c} AS v, row_number() OVER (PARTITION BY q.row_id ORDER BY sqrt(({squared}) * 4.0 / ({shared})), d.row_id) AS rn FROM t q JOIN t d ON d.{c} IS NOT NULL AND ({shared}) > 0 WHERE q.{c} IS NULL) WHERE rn <= 5 GROUP BY id)""" for c in columns]
    whole = ", ".join(f"count(*) FILTER (WHERE {c} % 1 = 0) > count(*) FILTER (WHERE {c} % 1 <> 0) AS w_{c}" for c in _KNN)
    joins = " ".join(f"LEFT JOIN n_{c} ON n_{c}.id = t.row_id" for c in columns)
    out = ", ".join(f"round_even(coalesce(t.{c}, n_{c}.m), CASE WHEN w_{c} THEN 0 ELSE 2 END) AS {c}" for c in _KNN)
    assert gaps
    return f"""WITH {CONTACTS}, base AS (SELECT row_id, CASE WHEN {sql_chosen('row_id', 22, 0.05)} THEN NULL ELSE balance END AS balance, CASE WHEN {sql_chosen('row_id', 23, 0.05)} THEN NULL ELSE customer_age END AS customer_age, CAST(nation AS DOUBLE) AS nation, segment FROM contacts),
lab AS (SELECT segment AS s, row_number() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM base WHERE segment IS NOT NULL)), t AS (SELECT row_id, balance, customer_age, nation, CAST(code AS DOUBLE) AS code, segment FROM base LEFT JOIN lab ON s = segment),
{", ".join(parts)}, w AS (SELECT {whole} FROM t), k AS (SELECT max(code) AS top FROM lab), r AS (SELECT t.row_id, {out}, coalesce(segment, (SELECT s FROM lab WHERE lab.code = greatest(0, least(top, round_even(n_code.m, 0))))) AS segment FROM t CROSS JOIN w CROSS JOIN k {joins}) SELECT * FROM r"""


@query("h5_neighbour_fill", _sql_knn())
def _(spark, sf):
    return impute.fill_by_neighbours(_knn_input(spark, sf), "row_id")


@query("h6_iterative_fill")
def _(spark, sf):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    df = read(spark, sf, "lineitem").groupBy(k.alias("row_id")).agg(F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))
    gappy = df.withColumn("price", F.when(draw(F.col("row_id"), 24) >= int(round(0.1 * RANGE)), F.col("price")))
    return impute.fill_iterative(gappy, "row_id")


@query("h7_choose_method", f"""WITH {DIRTY_ORDERS}, s AS (SELECT count(*) AS n, (4 * count(*) - count(row_id) - count(price) - count(priority) - count(cust_id)) / (4 * count(*)) AS miss, greatest(abs(corr(row_id, price)), abs(corr(row_id, cust_id)), abs(corr(price, cust_id))) AS r FROM dirty)
SELECT CASE WHEN miss < 0.01 THEN 'simple' WHEN r > 0.4 THEN 'iterative' ELSE 'knn' END AS method FROM s""")
def _(spark, sf):
    return impute.method_facts(dirty_orders(spark, sf).select("row_id", "price", "priority", "cust_id"))


@query("h8_downgrade_columns", f"""WITH {DIRTY_ORDERS}, s AS (SELECT unnest([{{'c': 'price', 'x': count(*) - count(price)}}, {{'c': 'price_text', 'x': count(*) - count(price_text)}}, {{'c': 'priority', 'x': count(*) - count(priority)}}, {{'c': 'status', 'x': count(*) - count(status)}}], recursive := true), count(*) AS n FROM dirty)
SELECT c AS "column" FROM s WHERE n > 1000 AND x / n > 0.06""")
def _(spark, sf):
    df = dirty_orders(spark, sf).select("price", "price_text", "priority", "status")
    return spark.createDataFrame([(c,) for c in impute.downgrade_columns(df, 1000, 0.06)], "column string")


_GAPS = f"""g AS (SELECT event_id, CASE WHEN {sql_chosen('event_id', 25, 0.3)} THEN NULL ELSE value END AS value, CASE WHEN {sql_chosen('event_id', 26, 0.3)} THEN NULL ELSE event_type END AS kind, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)"""


def _gap_events(spark, sf):
    k = F.col("event_id")

    def lost(seed):
        return draw(k, seed) < int(round(0.3 * RANGE))

    return read(spark, sf, "events").select("event_id", F.when(~lost(25), F.col("value")).alias("value"), F.when(~lost(26), F.col("event_type")).alias("kind"))


@query("h9_interpolate", f"""WITH {_GAPS}, p AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
 first_value(value IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1 FROM g
 WINDOW b AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(value, v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0), v0, v1), 6) AS value FROM p""")
def _(spark, sf):
    return rounded(impute.fill_ordered(_gap_events(spark, sf).select("event_id", "value"), "event_id", ["value"]))


@query("h10_fill_forward_backward", f"""WITH {_GAPS} SELECT event_id, coalesce(last_value(kind IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(kind IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS kind FROM g""")
def _(spark, sf):
    return impute.fill_ordered(_gap_events(spark, sf).select("event_id", "kind"), "event_id", ["kind"])


@query("h11_time_series_check", """WITH e AS (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS b FROM events), o AS (SELECT o_orderdate AS d, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS b FROM orders)
SELECT 'events' AS name, (SELECT bool_and(coalesce(ts >= b, true)) OR bool_and(coalesce(ts <= b, true)) FROM e) AS is_series UNION ALL SELECT 'orders', (SELECT bool_and(coalesce(d >= b, true)) OR bool_and(coalesce(d <= b, true)) FROM o)""")
def _(spark, sf):
    facts = [(n, impute.is_time_series(read(spark, sf, n), k)) for n, k in (("events", "event_id"), ("orders", "o_orderkey"))]
    return spark.createDataFrame(facts, "name string, is_series boolean")


@query("h12_statistic_imputer")
def _(spark, sf):
    return impute.statistic_imputer(_gappy(spark, sf), ["price"], ["priority"])


@query("h13_restore_types", "SELECT c_custkey, CAST(round_even(c_nationkey + 0.4, 0) AS INTEGER) AS c_nationkey, c_acctbal FROM customer")
def _(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return impute.restore_types(df.withColumn("c_nationkey", F.col("c_nationkey") + 0.4), df.schema)


# ---- cleaning plan and table functions ----------------------------------------------------------------
@query("plan_clean_orders")
def _(spark, sf):
    df = dirty_orders(spark, sf).select("row_id", "price", "price_text", "priority", "status", "date_text")
    plan = cleaning.plan_for(df, "row_id", "beta")
    plan.model_fill = False
    return cleaning.execute(df, "row_id", plan).table


@query("plan_fast_clean")
def _(spark, sf):
    return cleaning.fast_clean(dirty_orders(spark, sf).select("row_id", "price", "priority", "date_text"), "row_id")


@query("plan_deep_clean")
def _(spark, sf):
    return cleaning.deep_clean(contacts(spark, sf).select("row_id", "segment", "balance", "customer_age"), "row_id")
