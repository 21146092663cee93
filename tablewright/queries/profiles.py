"""Queries: profiles, quality scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.tokens import AUDIT_TOKENS
from tablewright.operators import profile
from tablewright.queries.registry import query, read
from tablewright.queries.views import CONTACTS, DIRTY_ORDERS, REPEATED, contacts, dirty_orders, repeated_lines, sql_in


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_D = ["row_id", "price", "price_text", "priority", "status", "date_text", "order_date", "cust_id"]
_TYPES = {"row_id": "bigint", "price": "double", "price_text": "string", "priority": "string", "status": "string", "date_text": "string", "order_date": "timestamp_ntz", "cust_id": "bigint"}
_NUM = ["row_id", "price", "cust_id"]


def _profile_part(c: str) -> str:
    unique = f"count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT)"
    if c in _NUM:
        kind, low, high = f"CASE WHEN {unique} = 2 THEN 'Binary' ELSE 'Numeric' END", f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)"
    else:
        kind = "'DateTime'" if c == "order_date" else f"CASE WHEN {unique} < 20 AND count(*) > 20 THEN 'Categorical' ELSE 'Text' END"
        low = high = "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{c}' AS \"column\", '{_TYPES[c]}' AS physical_type, {kind} AS semantic_type, count(*) - count({c}) AS missing_count, "
            f"round_even((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, {unique} AS unique_values, {low} AS min_value, {high} AS max_value FROM dirty")


_PROFILE = union_all([_profile_part(c) for c in _D])


@query("c1_column_profile", f"WITH {DIRTY_ORDERS} SELECT *, semantic_type IN ('Binary', 'Categorical', 'Numeric') AS is_target_candidate FROM ({_PROFILE})")
def _(spark, sf):
    return profile.column_profile(dirty_orders(spark, sf))


_CAST = {"p_partkey": "CAST(p_partkey AS VARCHAR)", "p_size": "CAST(p_size AS VARCHAR)", "p_retailprice": "CAST(p_retailprice AS VARCHAR)"}


def _typed_part(c: str, label: str) -> str:
    text = _CAST.get(c, c)
    return (f"SELECT '{c}' AS \"column\", '{label}' AS inferred_type, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) * 100 AS missing_pct, "
            f"count(DISTINCT {c}) AS unique_count, (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT {text} AS v, p_partkey AS k FROM part WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 5)) AS sample_values FROM part")


_TYPED = union_all([_typed_part("p_name", "Categorical"), _typed_part("p_brand", "Categorical"), _typed_part("p_type", "Categorical"), _typed_part("p_size", "Numerical"), _typed_part("p_retailprice", "Numerical")])


@query("c2_typed_profile", _TYPED)
def _(spark, sf):
    return profile.typed_profile(read(spark, sf, "part"), "p_partkey")


@query("c3_value_counts", """WITH l AS (SELECT unnest([{'c': 'status', 'v': o_orderstatus}, {'c': 'priority', 'v': o_orderpriority}], recursive := true) FROM orders),
g AS (SELECT c, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL) SELECT c AS "column", v AS "value", n AS count, round(n / sum(n) OVER (PARTITION BY c), 6) AS ratio FROM g""")
def _(spark, sf):
    df = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return rounded(profile.value_counts(df, ["status", "priority"]))


def _describe(c: str, t: str) -> str:
    return (f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {t}")


@query("c4_describe_numbers", union_all([_describe(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
def _(spark, sf):
    return rounded(profile.describe_numbers(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


_R = [("status", "string"), ("flag", "string"), ("quantity", "bigint"), ("year", "bigint")]


@query("c5_schema_summary", f"WITH {REPEATED}, d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT status, flag, quantity, year FROM repeated)) AS dups FROM repeated) " + union_all([
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS null_count, round_even((count(*) - count({c})) / count(*) * 100, 1) AS null_pct, count(*) AS total_rows, (SELECT dups FROM d) AS duplicate_rows FROM repeated"
    for c, t in _R]))
def _(spark, sf):
    return profile.schema_summary(repeated_lines(spark, sf).drop("name"), "row_id")


_SUP_NUM, _SUP_TXT = ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand"]


@query("c6_supervised_profile", f"""WITH s AS (SELECT count(*) AS n, count(DISTINCT p_type) AS k FROM part)
SELECT 'scale' AS section, 'n_rows' AS item, CAST(n AS DOUBLE) AS "value" FROM s UNION ALL SELECT 'scale', 'n_cols', 6 UNION ALL SELECT 'scale', 'n_feature_cols', 5
UNION ALL SELECT 'features', 'n_numerical', 3 UNION ALL SELECT 'features', 'n_categorical', 2 UNION ALL SELECT 'features', 'n_binary', {" + ".join(f"(SELECT CAST(count(DISTINCT {c}) = 2 AS INTEGER) FROM part)" for c in _SUP_NUM + _SUP_TXT)}
UNION ALL SELECT 'features', 'cat_to_num_ratio', round(2 / 3, 4) UNION ALL SELECT 'target', 'n_unique_values', k FROM s
UNION ALL SELECT 'target', CASE WHEN k = 2 THEN 'Binary Classification' ELSE 'Multi-class Classification' END, 1 FROM s
UNION ALL SELECT 'health', 'overall_missing_pct', 0 UNION ALL {union_all([f"SELECT 'missing_rate', '{c}', round((count(*) - count({c})) / count(*), 4) FROM part" for c in _SUP_NUM + _SUP_TXT + ['p_type']])}
UNION ALL {union_all([f"SELECT 'skewness', '{c}', round((avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5)), 4) FROM part, (SELECT avg({c}) AS m FROM part)" for c in _SUP_NUM])}
UNION ALL SELECT 'class_balance', p_type, round(count(*) / (SELECT n FROM s), 4) FROM part GROUP BY p_type""")
def _(spark, sf):
    return profile.supervised_profile(read(spark, sf, "part"), "p_type")


@query("c8_sensitive_types", f"""WITH {CONTACTS}, named AS (SELECT row_id, 'Person ' || chr(CAST(65 + row_id % 26 AS INTEGER)) AS full_name, 'Firm ' || row_id AS owner_name, email, phone, segment, balance FROM contacts),
a AS (SELECT avg(CAST(regexp_matches(full_name, '\\d') AS INTEGER)) AS x FROM (SELECT full_name FROM named ORDER BY row_id LIMIT 100)), b AS (SELECT avg(CAST(regexp_matches(owner_name, '\\d') AS INTEGER)) AS x FROM (SELECT owner_name FROM named ORDER BY row_id LIMIT 100))
SELECT 'email' AS "column", 'sensitive_email' AS kind UNION ALL SELECT 'phone', 'sensitive_phone' UNION ALL SELECT 'segment', 'categorical' UNION ALL SELECT 'balance', 'numerical'
UNION ALL SELECT 'full_name', CASE WHEN x > 0.05 THEN 'categorical' ELSE 'sensitive_name' END FROM a UNION ALL SELECT 'owner_name', CASE WHEN x > 0.05 THEN 'categorical' ELSE 'sensitive_name' END FROM b""")
def _(spark, sf):
    df = contacts(spark, sf).select(
        "row_id", F.concat(F.lit("Person "), F.char(F.lit(65) + F.col("row_id") % 26)).alias("full_name"), F.concat(F.lit("Firm "), F.col("row_id").cast("string")).alias("owner_name"),
        "email", "phone", "segment", "balance")
    return profile.sensitive_types(df, "row_id")


_L = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("c9_correlation_matrix", union_all([f"SELECT '{a}' AS x, '{b}' AS y, round(coalesce(corr({a}, {b}), 0), 6) + 0.0 AS r FROM lineitem" for a in _L for b in _L]))
def _(spark, sf):
    return rounded(profile.correlation_matrix(read(spark, sf, "lineitem"), _L)).withColumn("r", F.col("r") + 0.0)


@query("c10_group_moments", "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS variance, round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return rounded(profile.group_moments(read(spark, sf, "lineitem"), "l_returnflag", "l_quantity"))


@query("c11_missingness_class", f"""WITH {DIRTY_ORDERS}, s AS (SELECT count(*) - count(price) AS m, count(*) AS n, greatest(abs(coalesce(corr(CAST(price IS NULL AS DOUBLE), row_id), 0)), abs(coalesce(corr(CAST(price IS NULL AS DOUBLE), cust_id), 0))) AS r FROM dirty)
SELECT 'price' AS "column", CASE WHEN m = 0 THEN 'None' WHEN m / n > 0.6 THEN 'MNAR / Sparse' WHEN r > 0.15 THEN 'MAR (Missing At Random)' ELSE 'MCAR (Missing Completely At Random)' END AS kind,
round(m / n * 100, 6) AS missing_pct, round(r, 6) AS max_corr, m / n <= 0.6 AS should_impute FROM s""")
def _(spark, sf):
    return rounded(profile.missingness_class(dirty_orders(spark, sf), "price"))


_TOKENS = sql_in(AUDIT_TOKENS)
_S = ["row_id", "price", "priority", "status", "cust_id"]


def _sql_dirty(c: str) -> str:
    return f"({c} IS NULL)" if c in _NUM else f"({c} IS NULL OR coalesce(trim({c}) IN {_TOKENS}, false))"


_MOMENTS = "m AS (SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}, count({c}) AS n_{c}" for c in _NUM) + " FROM dirty)"
_BEYOND = ", ".join(f"count(*) FILTER (abs({c} - mu_{c}) > 3 * sd_{c}) AS x_{c}" for c in _NUM)


@query("c12_quality_score", f"""WITH {DIRTY_ORDERS}, {_MOMENTS}, s AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER {_sql_dirty(c)} AS d_{c}, count({c}) AS k_{c}".replace("FILTER (", "FILTER (WHERE (", 1).replace(f") AS d_{c}", f")) AS d_{c}", 1) for c in _S)}, {_BEYOND} FROM dirty, m),
r AS (SELECT 1 - ({" + ".join("d_" + c for c in _S)}) / (n * {len(_S)}) AS completeness, 1 - ({" + ".join(f"round_even(x_{c} / n_{c}, 4)" for c in _NUM)}) / 3 AS outlier_safety,
  (3 + (1 - (d_priority - (n - k_priority)) / k_priority) + (1 - (d_status - (n - k_status)) / k_status)) / 5 AS consistency FROM s, m), o AS (SELECT *, 0.5 * completeness + 0.3 * outlier_safety + 0.2 * consistency AS overall FROM r)
SELECT round(completeness, 6) AS completeness, round(outlier_safety, 6) AS outlier_safety, round(consistency, 6) AS consistency, round(overall, 6) AS overall, CAST(round_even(completeness * 100, 0) AS INTEGER) AS completeness_score,
CAST(round_even(outlier_safety * 100, 0) AS INTEGER) AS outlier_safety_score, CAST(round_even(consistency * 100, 0) AS INTEGER) AS consistency_score, CAST(round_even(overall * 100, 0) AS INTEGER) AS overall_score FROM o""")
def _(spark, sf):
    return rounded(profile.quality_score(dirty_orders(spark, sf).select(*_S)))


@query("c13_outlier_ratios", f"WITH {DIRTY_ORDERS}, {_MOMENTS}, s AS (SELECT {_BEYOND} FROM dirty, m) " + union_all([
    f"SELECT '{c}' AS \"column\", n_{c} AS n, x_{c} AS outliers, round_even(x_{c} / n_{c}, 4) AS ratio FROM s, m" for c in _NUM]))
def _(spark, sf):
    return profile.outlier_ratios(dirty_orders(spark, sf), _NUM)


@query("c14_health_score", f"""WITH {REPEATED}, s AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT status, flag, quantity, year FROM repeated)) AS d FROM repeated)
SELECT n AS total_rows, d AS duplicate_rows, 0 AS dirty_cells, CAST(greatest(0, least(100, 100 - round_even(d / n * 20, 0))) AS INTEGER) AS score,
CASE WHEN 100 - round_even(d / n * 20, 0) >= 80 THEN 'Healthy' WHEN 100 - round_even(d / n * 20, 0) >= 50 THEN 'Needs Attention' ELSE 'Critically Dirty' END AS band FROM s""")
def _(spark, sf):
    return profile.health_score(repeated_lines(spark, sf).drop("name"), "row_id")


@query("c15_missing_by_column", f"WITH {DIRTY_ORDERS}, s AS (" + union_all([
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_sql_dirty(c) if c != 'order_date' else c + ' IS NULL'}) AS missing_count, count(*) AS n FROM dirty" for c in _D if c != "row_id"])
    + ") SELECT \"column\", missing_count, round_even(missing_count / n * 100, 1) AS missing_pct FROM s WHERE missing_count > 0 ORDER BY missing_pct DESC LIMIT 10")
def _(spark, sf):
    return profile.missing_by_column(dirty_orders(spark, sf), "row_id")


@query("c16_type_distribution", f"WITH {DIRTY_ORDERS}, p AS ({_PROFILE}) SELECT CASE semantic_type WHEN 'Binary' THEN 'Numeric' ELSE semantic_type END AS semantic_type, count(*) AS columns FROM p GROUP BY 1")
def _(spark, sf):
    return profile.type_distribution(dirty_orders(spark, sf))


@query("c17_constraint_compliance", f"""WITH {CONTACTS}, m AS (SELECT avg(balance) AS mb, stddev_samp(balance) AS sb, avg(customer_age) AS ma, stddev_samp(customer_age) AS sa FROM contacts),
r AS (SELECT 'email' AS "column", 'Email Format Match' AS rule, round_even(count(*) FILTER (WHERE regexp_matches(trim(email), '^[^@]+@[^@]+\\.[^@]+$')) / count(email) * 100, 2) AS compliance_rate FROM contacts
UNION ALL SELECT 'phone', 'Phone Format E.164', round_even(count(*) FILTER (WHERE regexp_matches(regexp_replace(phone, '[\\s()-]', '', 'g'), '^\\+?[1-9]\\d{{1,14}}$')) / count(phone) * 100, 2) FROM contacts
UNION ALL SELECT 'segment', 'Not Null', round_even(count(segment) / count(*) * 100, 2) FROM contacts
UNION ALL SELECT 'balance', 'Outlier Range [±3σ]', round_even((count(*) - count(*) FILTER (WHERE abs(balance - mb) > 3 * sb)) / count(*) * 100, 2) FROM contacts, m
UNION ALL SELECT 'customer_age', 'Outlier Range [±3σ]', round_even((count(*) - count(*) FILTER (WHERE abs(customer_age - ma) > 3 * sa)) / count(*) * 100, 2) FROM contacts, m)
SELECT *, CASE WHEN compliance_rate >= 95 THEN 'PASS' WHEN compliance_rate >= 80 THEN 'WARNING' ELSE 'FAIL' END AS status FROM r""")
def _(spark, sf):
    return profile.constraint_compliance(contacts(spark, sf).select("email", "phone", "segment", "balance", "customer_age"))


_TARGETS = """WITH s AS (SELECT 'p_name' AS c, 0 AS place, 'categorical' AS kind, count(DISTINCT p_name) AS u FROM part UNION ALL SELECT 'p_brand', 1, 'categorical', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'p_type', 2, 'categorical', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', 3, 'numerical', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_retailprice', 4, 'numerical', count(DISTINCT p_retailprice) FROM part),
t AS (SELECT s.*, (SELECT count(*) FROM part) AS n, regexp_matches(c, '(?i)id|name|idx|uuid|guid|row|index|key|serial|code|phone|email') AS idn, regexp_matches(c, '(?i)target|label|class|y|status|output|sale_price|price|revenue|income|clicked|survived|churn|fraud|default') AS tn FROM s),
z AS (SELECT c, place, kind, u, CASE WHEN u = n THEN -10.0 WHEN idn AND u > n * 0.5 THEN -5.0 ELSE 0 END + CASE WHEN u <= 1 THEN -20 ELSE 0 END + CASE WHEN tn THEN 8 ELSE 0 END + CASE place WHEN 4 THEN 4 WHEN 0 THEN -2 ELSE 0 END
 + CASE WHEN kind = 'categorical' AND u = 2 THEN 5 WHEN kind = 'categorical' AND u BETWEEN 3 AND 10 THEN 4 WHEN kind = 'categorical' AND u > 50 AND NOT idn THEN -3 WHEN kind = 'numerical' AND NOT idn AND u > 10 THEN 3 ELSE 0 END AS score FROM t)
SELECT c AS "column", CAST(score AS DOUBLE) AS score, CASE WHEN u = 2 THEN 'binary' WHEN kind = 'categorical' OR u <= 10 THEN 'categorical' ELSE 'continuous' END AS inferred_type, place FROM z"""


@query("c18_rank_targets", _TARGETS)
def _(spark, sf):
    return profile.rank_targets(read(spark, sf, "part"), "p_partkey")


@query("c19_infer_task", "SELECT 'p_type' AS target, CASE WHEN count(DISTINCT p_type) = 2 THEN 'binary' ELSE 'multiclass' END AS task FROM part "
       "UNION ALL SELECT 'p_retailprice', CASE count(DISTINCT p_retailprice) WHEN 2 THEN 'binary' ELSE CASE WHEN count(DISTINCT p_retailprice) <= 10 THEN 'multiclass' ELSE 'regression' END END FROM part")
def _(spark, sf):
    df = read(spark, sf, "part")
    kinds = profile.logical_types(df, "p_partkey")
    return spark.createDataFrame([(t, profile.infer_task(df, t, kinds)) for t in ("p_type", "p_retailprice")], "target string, task string")


@query("c20_fingerprint")
def _(spark, sf):
    return profile.fingerprint(read(spark, sf, "lineitem"))


@query("c21_mutation_check", "SELECT 'same' AS pair, false AS mutated UNION ALL SELECT 'repriced', (SELECT count(*) > 0 FROM orders WHERE o_totalprice <> o_totalprice + 1)")
def _(spark, sf):
    df = read(spark, sf, "orders")
    shuffled, repriced = df.repartition(5, "o_custkey"), df.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return spark.createDataFrame([("same", profile.is_mutated(df, shuffled)), ("repriced", profile.is_mutated(df, repriced))], "pair string, mutated boolean")


@query("c22_class_weights", """WITH g AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)
SELECT quality, n, round((SELECT sum(n) FROM g) / ((SELECT count(*) FROM g) * n), 6) AS weight, round((SELECT max(n) / min(n) FROM g), 6) AS imbalance_ratio, (SELECT max(n) / min(n) > 1.5 FROM g) AS active FROM g""")
def _(spark, sf):
    return rounded(profile.class_weights(read(spark, sf, "labels"), "quality"))


@query("c23_feature_ranges", """SELECT 'o_totalprice' AS "column", 'numerical' AS kind, min(o_totalprice) AS min, max(o_totalprice) AS max, quantile_cont(o_totalprice, 0.5) AS median, NULL AS options, 0 AS more_options FROM orders
UNION ALL SELECT 'o_orderstatus', 'categorical', NULL, NULL, NULL, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderstatus AS v FROM orders ORDER BY v LIMIT 50)), (SELECT greatest(count(DISTINCT o_orderstatus) - 50, 0) FROM orders)
UNION ALL SELECT 'o_orderpriority', 'categorical', NULL, NULL, NULL, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY v LIMIT 50)), (SELECT greatest(count(DISTINCT o_orderpriority) - 50, 0) FROM orders)""")
def _(spark, sf):
    return profile.feature_ranges(read(spark, sf, "orders"), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])


@query("c24_dataset_signature", f"SELECT \"column\", CASE \"column\" WHEN 'p_size' THEN 'int' WHEN 'p_retailprice' THEN 'double' ELSE 'string' END AS dtype, unique_count, round_even(missing_pct, 1) AS null_pct, sample_values FROM ({_TYPED})")
def _(spark, sf):
    return profile.dataset_signature(read(spark, sf, "part"), "p_partkey")


@query("c25_training_summary", f"""WITH {DIRTY_ORDERS}, g AS (SELECT status, count(*) AS n FROM dirty GROUP BY status), s AS (SELECT count(*) AS n, {" + ".join(f"count({c})" for c in _S)} AS filled, CAST(count(DISTINCT priority) > 50 AS INTEGER) AS w FROM dirty)
SELECT n AS n_rows, 5 AS n_cols, 3 AS n_numeric, 2 AS n_text, round_even((n * 5 - filled) / (n * 5) * 100, 2) AS missing_pct, round_even((SELECT min(n) / sum(n) * 100 FROM g), 2) AS minority_pct, w AS wide_columns FROM s""")
def _(spark, sf):
    return profile.training_summary(dirty_orders(spark, sf).select(*_S), "status")
