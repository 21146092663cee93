"""Queries: differences between two versions, recovery, drift, temporal checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import numbers
from tablewright.functions.dates import standardize_date
from tablewright.functions.hashing import draw
from tablewright.functions.tokens import AUDIT_TOKENS, DIFF_TOKENS
from tablewright.operators import audit, corrupt, synth
from tablewright.queries.profiles import rounded, union_all
from tablewright.queries.registry import query, read
from tablewright.queries.views import CLEANED_ORDERS, DIRTY_ORDERS, cleaned_orders, dirty_orders, sql_chosen, sql_in

PAIR = f"{DIRTY_ORDERS}, {CLEANED_ORDERS}"
SHARED = ["price", "priority", "status", "date_text", "order_date", "cust_id"]
TEXT = ["priority", "status", "date_text"]


def sql_dirty(side: str, c: str, tokens: list[str]) -> str:
    if c in TEXT or (c == "cust_id" and side == "a"):
        return f"({side}.{c} IS NULL OR coalesce(trim({side}.{c}) IN {sql_in(tokens)}, false))"
    return f"({side}.{c} IS NULL)"


def sql_changed(c: str, tokens: list[str]) -> str:
    old, new = sql_dirty("b", c, tokens), sql_dirty("a", c, tokens)
    return f"(({old} AND NOT {new}) OR (NOT {old} AND NOT {new} AND CAST(b.{c} AS VARCHAR) IS DISTINCT FROM CAST(a.{c} AS VARCHAR)))"


_JOIN = "FROM dirty b JOIN cleaned a ON b.row_id = a.row_id"
_CHANGES = union_all([f"SELECT '{c}' AS \"column\", b.row_id {_JOIN} WHERE {sql_changed(c, DIFF_TOKENS)}" for c in SHARED])


def pair(spark, sf):
    return dirty_orders(spark, sf), cleaned_orders(spark, sf)


@query("i1_changed_cells", f"WITH {PAIR} {_CHANGES}")
def _(spark, sf):
    return audit.changed_cells(*pair(spark, sf), "row_id")


@query("i2_dirty_cells", f"WITH {DIRTY_ORDERS} " + union_all([f"SELECT '{c}' AS \"column\", row_id FROM dirty b WHERE {sql_dirty('b', c, DIFF_TOKENS)}" for c in ["price", "priority", "status", "date_text"]])
       + f" UNION ALL SELECT 'price_text', row_id FROM dirty WHERE price_text IS NULL OR trim(price_text) IN {sql_in(DIFF_TOKENS)}")
def _(spark, sf):
    return audit.dirty_cells(dirty_orders(spark, sf), "row_id")


_OLD = ["price", "price_text", "priority", "status", "date_text", "order_date", "cust_id"]
_NEW = ["price", "priority", "status", "date_text", "order_date", "cust_id", "checked"]


@query("i3_audit_totals", f"""WITH {PAIR}, c AS (SELECT {" + ".join(f"count(*) FILTER (WHERE {sql_changed(c, AUDIT_TOKENS)})" for c in SHARED)} AS n {_JOIN}),
o AS (SELECT count(*) AS n, {" + ".join(f"(count(*) - count({c}))" for c in _OLD)} AS m FROM dirty), w AS (SELECT count(*) AS n, {" + ".join(f"(count(*) - count({c}))" for c in _NEW)} AS m, ({" + ".join(f"count({c}) / count(*) * 100" for c in _NEW)}) / 7 AS rate FROM cleaned)
SELECT o.n AS rows_before, w.n AS rows_after, 7 AS columns, o.n * 7 AS total_cells, c.n AS cells_changed, round_even(c.n / (o.n * 7) * 100, 2) AS pct_corrected, greatest(0, o.n - w.n) AS duplicates_removed, o.m AS missing_before, w.m AS missing_after,
round_even(rate, 2) AS compliance_rate FROM c, o, w""")
def _(spark, sf):
    return audit.audit_totals(*pair(spark, sf), "row_id")


PLAN = {"price": "smart_impute", "priority": "impute_mode", "date_text": "standardize_date", "status": "fuzzy_fix"}
_FAMILY = "CASE \"column\" WHEN 'price' THEN 'Null Handling' WHEN 'priority' THEN 'Null Handling' WHEN 'date_text' THEN 'Standardization' WHEN 'status' THEN 'Standardization' ELSE 'General Cleaning' END"


def _side(c: str, side: str, table: str) -> str:
    numeric = c == "price" or (c == "cust_id" and side == "before")
    alias = "b" if side == "before" else "a"
    stats = ", ".join(f"{f'round_even({fn}({c}), 4)' if numeric else 'CAST(NULL AS DOUBLE)'} AS {k}_{side}" for k, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    return f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {sql_dirty(alias, c, AUDIT_TOKENS)}) AS missing_{side}, count(DISTINCT {c}) AS unique_{side}, {stats} FROM {table} {alias}"


_AUDIT = f"""ch AS ({union_all([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {sql_changed(c, AUDIT_TOKENS)}) AS cells_changed {_JOIN}" for c in SHARED])}),
sb AS ({union_all([_side(c, 'before', 'dirty') for c in SHARED])}), sa AS ({union_all([_side(c, 'after', 'cleaned') for c in SHARED])}),
au AS (SELECT *, {_FAMILY} AS operation, CASE WHEN cells_changed > 0 AND missing_after = 0 THEN 'FIXED' WHEN cells_changed > 0 AND missing_after > 0 THEN 'PARTIALLY FIXED' WHEN cells_changed = 0 AND missing_before = 0 THEN 'CLEAN'
  WHEN cells_changed = 0 AND missing_after > 0 THEN 'ISSUE REMAINS' ELSE 'MODIFIED' END AS status FROM ch JOIN sb USING ("column") JOIN sa USING ("column"))"""


@query("i4_column_audit", f"WITH {PAIR}, {_AUDIT} SELECT * FROM au")
def _(spark, sf):
    return audit.column_audit(*pair(spark, sf), "row_id", PLAN)


@query("i5_status_labels", f"WITH {PAIR}, {_AUDIT} SELECT \"column\", status FROM au")
def _(spark, sf):
    return audit.column_audit(*pair(spark, sf), "row_id", PLAN).select("column", "status")


@query("i6_operation_breakdown", f"""WITH {PAIR}, {_AUDIT} SELECT f.operation, CAST(coalesce(sum(cells_changed), 0) + CASE WHEN f.operation = 'Deduplication' THEN (SELECT count(*) FROM dirty) - (SELECT count(*) FROM cleaned) ELSE 0 END AS BIGINT) AS cells
FROM (SELECT unnest({audit.REPORTED_FAMILIES}) AS operation) f LEFT JOIN au ON au.operation = f.operation GROUP BY f.operation""")
def _(spark, sf):
    before, after = pair(spark, sf)
    return audit.operation_breakdown(audit.column_audit(before, after, "row_id", PLAN), before.count() - after.count())


@query("i7_null_comparison", f"""WITH {PAIR}, n AS ({union_all([f"SELECT '{c}' AS \"column\", (SELECT count(*) - count({c}) FROM dirty) AS nulls_before, (SELECT count(*) - count({c}) FROM cleaned) AS nulls_after" for c in SHARED])})
SELECT *, greatest(0, nulls_before - nulls_after) AS cells_fixed FROM n WHERE nulls_before > 0 OR nulls_after > 0 ORDER BY cells_fixed DESC LIMIT 15""")
def _(spark, sf):
    return audit.null_comparison(*pair(spark, sf), "row_id")


@query("i8_histogram_drift", f"""WITH {PAIR}, e AS (SELECT min(p) AS lo, (max(p) - min(p)) / 30 AS w FROM (SELECT price AS p FROM dirty UNION ALL SELECT price FROM cleaned)),
l AS (SELECT 'before' AS side, price FROM dirty WHERE price IS NOT NULL UNION ALL SELECT 'after', price FROM cleaned), c AS (SELECT side, count(*) AS n FROM l GROUP BY side)
SELECT 'price' AS "column", side, CAST(least(floor((price - lo) / w), 29) AS INTEGER) AS bin, round(count(*) / (max(n) * max(w)), 12) AS density FROM l JOIN c USING (side), e GROUP BY side, bin""")
def _(spark, sf):
    return rounded(audit.histogram_drift(*pair(spark, sf), ["price"]), 12)


@query("i9_box_statistics", f"WITH {PAIR} " + union_all([f"SELECT 'price' AS \"column\", '{s}' AS side, min(price) AS lowest, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.75) AS p75, max(price) AS highest FROM {t}"
                                                            for s, t in (("before", "dirty"), ("after", "cleaned"))]))
def _(spark, sf):
    return audit.box_statistics(*pair(spark, sf), ["price"])




@query("i10_drift_report", f"""WITH {PAIR}, g AS (SELECT p FROM (SELECT unnest(range(0, 1000)) / 1000.0::DOUBLE AS p)), b0 AS (SELECT list(price ORDER BY price) AS v, count(price) - 1 AS n FROM dirty WHERE price IS NOT NULL), a0 AS (SELECT list(price ORDER BY price) AS v, count(price) - 1 AS n FROM cleaned WHERE price IS NOT NULL),
q AS (SELECT p, b0.v[CAST(floor(p * b0.n) AS BIGINT) + 1] + (b0.v[CAST(ceil(p * b0.n) AS BIGINT) + 1] - b0.v[CAST(floor(p * b0.n) AS BIGINT) + 1]) * (p * b0.n - floor(p * b0.n)) AS x, a0.v[CAST(floor(p * a0.n) AS BIGINT) + 1] + (a0.v[CAST(ceil(p * a0.n) AS BIGINT) + 1] - a0.v[CAST(floor(p * a0.n) AS BIGINT) + 1]) * (p * a0.n - floor(p * a0.n)) AS y FROM g, b0, a0),
s AS (SELECT (SELECT sum(abs(x - y)) / 1000 FROM q) AS wd, stddev_pop(price) AS sd, var_pop(price) AS v0, (SELECT var_pop(price) FROM cleaned) AS v1, quantile_cont(price, 0.5) AS m0, (SELECT quantile_cont(price, 0.5) FROM cleaned) AS m1 FROM dirty)
SELECT 'price' AS "column", round(wd, 2) AS wasserstein, round(wd / sd, 5) AS normalized, round(abs(m0 - m1) / m0 * 100, 5) AS median_shift_pct, round((v0 - v1) / v0 * 100, 5) AS variance_collapse_pct, wd / sd > 0.25 OR (v0 - v1) / v0 > 0.5 AS alert FROM s""")
def _(spark, sf):
    report = audit.drift_report(*pair(spark, sf), ["price"])
    return rounded(report, 5).withColumn("wasserstein", F.round("wasserstein", 2))


@query("i11_correlation_shift", f"""WITH {PAIR}, s AS (SELECT (SELECT corr(price, cust_id) FROM dirty) AS b, (SELECT corr(price, CAST(cust_id AS DOUBLE)) FROM cleaned) AS a)
SELECT round(b, 6) AS before_r, round(a, 6) AS after_r, round(abs(b - a), 6) AS shift, CASE WHEN abs(b - a) < 0.2 THEN 'OK' ELSE 'DRIFT_DETECTED' END AS status FROM s""")
def _(spark, sf):
    before, after = pair(spark, sf)
    return rounded(audit.correlation_shift(before.withColumn("cust_id", F.col("cust_id").cast("string")).withColumn("price", F.col("price").cast("string")), after.withColumn("price", F.col("price").cast("string")), "price", "cust_id"))


@query("i13_identifier_check", f"""WITH {PAIR}, j AS (SELECT count(*) AS n, count(*) FILTER (WHERE CAST(b.cust_id AS VARCHAR) IS DISTINCT FROM a.cust_id) AS c, count(*) FILTER (WHERE b.priority IS DISTINCT FROM a.priority) AS p {_JOIN})
SELECT 'cust_id' AS "column", CASE WHEN c > 0 THEN 'MUTATED' ELSE 'OK' END AS status, c AS mutated FROM j UNION ALL SELECT 'priority', CASE WHEN p > 0 THEN 'MUTATED' ELSE 'OK' END, p FROM j UNION ALL SELECT 'price_text', 'DROPPED', 0""")
def _(spark, sf):
    return audit.identifier_check(*pair(spark, sf), "row_id", ["cust_id", "priority", "price_text"])


# ---- ground truth, corruption, repair --------------------------------------------------------------
def people(spark, sf):
    """Ground truth over the customers, its corrupted form, the injected cells and a repaired version."""
    truth = synth.ground_truth(read(spark, sf, "customer").select(F.col("c_custkey").alias("row_id")), "row_id")
    corrupted, injected = corrupt.corrupt_people(truth, "row_id")
    repaired = numbers.parse_numbers(corrupted, ["salary"]).withColumns({
        "join_date": F.date_format(standardize_date(F.col("join_date")), "yyyy-MM-dd"),
        "city": F.initcap("city"),
        "age": F.coalesce("age", F.lit(44.0)),
    }).withColumn("salary", F.coalesce("salary", F.lit(14000.0)))
    return truth, corrupted, injected, repaired


@query("i12_semantic_scores")
def _(spark, sf):
    truth, _, _, repaired = people(spark, sf)
    return audit.semantic_scores(truth, repaired, "age", "salary")


@query("i14_recovery_metrics")
def _(spark, sf):
    truth, corrupted, _, repaired = people(spark, sf)
    return audit.recovery_metrics(truth, corrupted, repaired, "row_id", arabic=["arabic_feedback"])


GROUPS = {
    "missing_numeric": (["age_missing", "salary_missing"], ["age", "salary"]), "outlier_replacement": (["salary_outliers"], ["salary"]),
    "broken_dates": (["join_date_corrupted"], ["join_date"]), "currency_noise": (["salary_currency_noise"], ["salary"]), "arabic_typos": (["arabic_num_corrupted"], ["arabic_feedback"]),
}


@query("i15_recovery_by_kind")
def _(spark, sf):
    truth, _, injected, repaired = people(spark, sf)
    return audit.recovery_by_kind(truth, repaired, injected, "row_id", GROUPS, arabic=["arabic_feedback"])


@query("i16_temporal_checks", f"""WITH t AS (SELECT o_orderdate AS start_date, o_orderdate + CAST(({'o_orderkey % 11 - 3'}) AS INTEGER) * INTERVAL 1 DAY AS end_date FROM orders)
SELECT 'future_date' AS "check", 'start_date' AS "column", '' AS other, count(*) FILTER (WHERE start_date > TIMESTAMP '1998-01-01') AS violations FROM t UNION ALL SELECT 'future_date', 'end_date', '', count(*) FILTER (WHERE end_date > TIMESTAMP '1998-01-01') FROM t
UNION ALL SELECT 'end_before_start', 'end_date', 'start_date', count(*) FILTER (WHERE end_date < start_date) FROM t""")
def _(spark, sf):
    df = read(spark, sf, "orders").select(F.col("o_orderdate").alias("start_date"), F.expr("timestampadd(DAY, cast(o_orderkey % 11 - 3 as int), o_orderdate)").alias("end_date"))
    return audit.temporal_checks(df, F.lit("1998-01-01").cast("timestamp"))


