"""Queries: corruption, generation, fidelity and privacy."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tablewright.functions.hashing import chosen, draw, poisson_cuts, unit
from tablewright.functions.numbers import ARABIC_DIGITS, WESTERN_DIGITS
from tablewright.operators import corrupt, synth
from tablewright.operators.corrupt import Rule
from tablewright.queries.profiles import rounded, union_all
from tablewright.queries.registry import ORACLES, query, read
from tablewright.queries.views import sql_chosen, sql_draw, sql_pick, sql_unit


def orders(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


_O = "o AS (SELECT o_orderkey AS row_id, o_totalprice AS price, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"


def sql_hit(seed: int, ratio: float) -> str:
    """CTE h(row_id, hit): exactly floor(n·ratio) rows by (draw, id)."""
    return f"h AS (SELECT row_id, row_number() OVER (ORDER BY {sql_draw('row_id', seed)}, row_id) <= floor(count(*) OVER () * {ratio} / 100.0) AS hit FROM o)"


def sql_outlier(c: str, seed: int) -> str:
    f = f"(5.0 + {sql_unit('row_id', seed + 11)} * 495.0)"
    return f"CASE WHEN ({sql_draw('row_id', seed + 12)}) % 2 = 0 THEN {c} * {f} ELSE CASE WHEN {c} <> 0 THEN {c} / {f} ELSE {f} END END"


def sql_typo(c: str, seed: int) -> str:
    at = f"CAST(({sql_draw('row_id', seed + 21)}) % greatest(length({c}) - 1, 1) AS BIGINT)"
    kind = f"({sql_draw('row_id', seed + 22)}) % 3"
    head, rest = f"substr({c}, 1, {at})", f"substr({c}, {at} + 1)"
    return (f"CASE WHEN length({c}) < 2 THEN {c} WHEN {kind} = 0 THEN {head} || substr({rest}, 2, 1) || substr({rest}, 1, 1) || substr({rest}, 3) WHEN {kind} = 1 THEN {head} || substr({rest}, 2) "
            f"ELSE {head} || {sql_pick('row_id', seed + 23, corrupt.LETTERS)} || {rest} END")


def sql_format(c: str, seed: int) -> str:
    kind, half = f"({sql_draw('row_id', seed + 31)}) % 3", f"CAST(floor(length({c}) / 2) AS BIGINT)"
    return f"CASE {kind} WHEN 0 THEN '   ' || {c} WHEN 1 THEN {c} || '   ' ELSE substr({c}, 1, {half}) || '  ' || substr({c}, {half} + 1) END"


@query("j1_rule_sequence", f"""WITH {_O}, a AS (SELECT row_id, row_number() OVER (ORDER BY {sql_draw('row_id', 1)}, row_id) <= floor(count(*) OVER () * 0.1) AS h1, row_number() OVER (ORDER BY {sql_draw('row_id', 2)}, row_id) <= floor(count(*) OVER () * 0.05) AS h2,
 row_number() OVER (ORDER BY {sql_draw('row_id', 3)}, row_id) <= floor(count(*) OVER () * 0.05) AS h3 FROM o)
SELECT row_id, CASE WHEN h1 THEN NULL ELSE price END AS price, CASE WHEN h2 THEN {sql_typo('priority', 2)} ELSE priority END AS priority, CASE WHEN h3 THEN {sql_format('status', 3)} ELSE status END AS status FROM o JOIN a USING (row_id)""")
def _(spark, sf):
    return corrupt.apply_rules(orders(spark, sf), "row_id", [Rule("price", "missing", 10, 1), Rule("priority", "typos", 5, 2), Rule("status", "format", 5, 3)])


@query("j2_missing", f"WITH {_O}, {sql_hit(4, 10)} SELECT row_id, CASE WHEN hit THEN NULL ELSE price END AS price FROM o JOIN h USING (row_id)")
def _(spark, sf):
    return corrupt.apply_rule(orders(spark, sf).select("row_id", "price"), "row_id", Rule("price", "missing", 10, 4))


@query("j3_outliers", f"WITH {_O}, {sql_hit(5, 5)} SELECT row_id, round(CASE WHEN hit THEN {sql_outlier('price', 5)} ELSE price END, 4) AS price FROM o JOIN h USING (row_id)")
def _(spark, sf):
    return rounded(corrupt.apply_rule(orders(spark, sf).select("row_id", "price"), "row_id", Rule("price", "outliers", 5, 5)), 4)


@query("j4_typos", f"WITH {_O}, {sql_hit(6, 20)} SELECT row_id, CASE WHEN hit THEN {sql_typo('priority', 6)} ELSE priority END AS priority FROM o JOIN h USING (row_id)")
def _(spark, sf):
    return corrupt.apply_rule(orders(spark, sf).select("row_id", "priority"), "row_id", Rule("priority", "typos", 20, 6))


@query("j5_format_noise", f"WITH {_O}, {sql_hit(7, 20)} SELECT row_id, CASE WHEN hit THEN {sql_format('priority', 7)} ELSE priority END AS priority FROM o JOIN h USING (row_id)")
def _(spark, sf):
    return corrupt.apply_rule(orders(spark, sf).select("row_id", "priority"), "row_id", Rule("priority", "format", 20, 7))


@query("j6_type_inconsistency", f"WITH {_O}, {sql_hit(8, 12)} SELECT row_id, CASE WHEN hit THEN {sql_pick('row_id', 49, corrupt.INCONSISTENT_TOKENS)} ELSE CAST(price AS VARCHAR) END AS price FROM o JOIN h USING (row_id)")
def _(spark, sf):
    return corrupt.apply_rule(orders(spark, sf).select("row_id", "price"), "row_id", Rule("price", "type", 12, 8))


@query("j7_duplicate_rows", f"WITH {_O} SELECT row_id, status, CAST(unnest(range(0, {' + '.join(f'CAST(d >= {c} AS INTEGER)' for c in poisson_cuts(0.3))} + 1)) AS INTEGER) AS copy_no FROM (SELECT row_id, status, {sql_draw('row_id', 9)} AS d FROM o)")
def _(spark, sf):
    return corrupt.duplicate_rows(orders(spark, sf).select("row_id", "status"), "row_id", 0.3, 9)


@query("j8_chaos", f"""WITH {_O} SELECT row_id, CASE WHEN {sql_chosen('row_id', 42, 0.15)} THEN NULL ELSE price END AS price,
CASE WHEN {sql_chosen('row_id', 46, 0.10)} THEN {sql_pick('row_id', 47, corrupt.CHAOS_TOKENS)} WHEN {sql_chosen('row_id', 45, 0.15)} THEN NULL ELSE priority END AS priority,
CASE WHEN {sql_chosen('row_id', 49, 0.10)} THEN {sql_pick('row_id', 50, corrupt.CHAOS_TOKENS)} WHEN {sql_chosen('row_id', 48, 0.15)} THEN NULL ELSE status END AS status FROM o""")
def _(spark, sf):
    return corrupt.chaos(orders(spark, sf), "row_id")


# ---- people ----------------------------------------------------------------------------------------
def people_ids(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))


TRUTH = f"""truth AS (SELECT row_id, 'USR-' || (row_id + 10000) AS user_id, substr(sha256('tx_' || row_id || '_42'), 1, 16) AS tx_hash, CAST(({sql_draw('row_id', 63)}) % 52 + 18 AS DOUBLE) AS age, CAST(({sql_draw('row_id', 64)}) % 22000 + 3000 AS DOUBLE) AS salary,
 {sql_pick('row_id', 65, synth.CITIES)} AS city, strftime(TIMESTAMP '2021-01-01' + row_id * INTERVAL 1 HOUR, '%Y-%m-%d') AS join_date, {sql_pick('row_id', 66, synth.FEEDBACK)} AS arabic_feedback FROM (SELECT c_custkey AS row_id FROM customer))"""
_NO_PAY = sql_chosen("row_id", 43, 0.10)
CORRUPTED = f"""flags AS (SELECT row_id, {sql_chosen('row_id', 42, 0.10)} AS no_age, {_NO_PAY} AS no_pay, {sql_chosen('row_id', 44, 0.02)} AND NOT {_NO_PAY} AS far, {sql_chosen('row_id', 45, 0.10)} AS late, {sql_chosen('row_id', 46, 0.10)} AS typo,
 {sql_chosen('row_id', 47, 0.15)} AND NOT {_NO_PAY} AS mark, {sql_chosen('row_id', 48, 0.10)} AS fold, ({sql_draw('row_id', 49)}) % 2 = 0 AS pre, ({sql_draw('row_id', 50)}) % 4 AS style, ({sql_draw('row_id', 51)}) % 2 = 0 AS low, ({sql_draw('row_id', 52)}) % 99 + 1 AS num FROM truth),
paid AS (SELECT t.*, f.* EXCLUDE (row_id), CAST(CAST(CASE WHEN far THEN salary * 10 ELSE salary END AS BIGINT) AS VARCHAR) AS whole, CAST(floor(length(city) / 2) AS BIGINT) AS half FROM truth t JOIN flags f USING (row_id)),
corrupted AS (SELECT row_id, user_id, tx_hash, CASE WHEN no_age THEN NULL ELSE age END AS age, CASE WHEN no_pay THEN NULL WHEN mark AND pre THEN '$' || whole WHEN mark THEN whole || ' EGP' ELSE whole || '.0' END AS salary,
 CASE WHEN typo THEN CASE WHEN low THEN lower(city) ELSE substr(city, 1, half) || CASE WHEN substr(city, half + 1, 1) <> 'u' THEN 'u' ELSE 'x' END || substr(city, half + 2) END ELSE city END AS city,
 CASE WHEN late THEN CASE style WHEN 0 THEN strftime(CAST(join_date AS DATE), '%d/%m/%Y') WHEN 1 THEN strftime(CAST(join_date AS DATE), '%m-%d-%Y') WHEN 2 THEN strftime(CAST(join_date AS DATE), '%d %b %Y') ELSE '{corrupt.UNKNOWN_DATE}' END ELSE join_date END AS join_date,
 CASE WHEN fold THEN translate(arabic_feedback, 'أ', 'ا') || ' ' || translate(CAST(num AS VARCHAR), '{WESTERN_DIGITS}', '{ARABIC_DIGITS}') ELSE arabic_feedback END AS arabic_feedback FROM paid)"""
INJECTED = "injected AS (" + union_all([f"SELECT row_id, '{c}' AS \"column\", '{k}' AS kind FROM flags WHERE {f}" for f, c, k in (
    ("no_age", "age", "age_missing"), ("no_pay", "salary", "salary_missing"), ("far", "salary", "salary_outliers"), ("late", "join_date", "join_date_corrupted"), ("typo", "city", "city_typos"),
    ("mark", "salary", "salary_currency_noise"), ("fold", "arabic_feedback", "arabic_num_corrupted"))]) + ")"


@query("j9_corrupt_people", f"WITH {TRUTH}, {CORRUPTED} SELECT * FROM corrupted")
def _(spark, sf):
    return corrupt.corrupt_people(synth.ground_truth(people_ids(spark, sf), "row_id"), "row_id")[0]


@query("j9_injected_cells", f"WITH {TRUTH}, {CORRUPTED}, {INJECTED} SELECT * FROM injected")
def _(spark, sf):
    return corrupt.corrupt_people(synth.ground_truth(people_ids(spark, sf), "row_id"), "row_id")[1]


@query("j10_ground_truth", f"WITH {TRUTH} SELECT * FROM truth")
def _(spark, sf):
    return synth.ground_truth(people_ids(spark, sf), "row_id")


# the recovery queries of the audit family on the same views
_FOLD = f"trim(regexp_replace(regexp_replace(translate(translate(lower(trim({{0}})), 'أإآة', 'اااه'), '{ARABIC_DIGITS}', '{WESTERN_DIGITS}'), '\\p{{{{Nd}}}}', '', 'g'), '\\s+', ' ', 'g'))"
_PARSED_DAY = "coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d-%m-%Y'), try_strptime(d, '%m-%d-%Y'), try_strptime(d, '%d-%b-%Y'))"
REPAIRED = f"""repaired AS (SELECT row_id, user_id, tx_hash, coalesce(age, 44.0) AS age, coalesce(TRY_CAST(regexp_replace(salary, '[^\\d.]', '', 'g') AS DOUBLE), 14000.0) AS salary,
 upper(substr(city, 1, 1)) || lower(substr(city, 2)) AS city, strftime({_PARSED_DAY}, '%Y-%m-%d') AS join_date, arabic_feedback FROM (SELECT *, regexp_replace(trim(join_date), '[./\\s\\\\]', '-', 'g') AS d FROM corrupted))"""


def _near(a: str, b: str) -> str:
    """15 % tolerance relative to the first value."""
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL ELSE abs({a} - {b}) / greatest(abs({a}), 1.0) <= 0.15 END"


def _day(c: str) -> str:
    return _PARSED_DAY.replace("(d,", f"(regexp_replace(trim({c}), '[./\\s\\\\]', '-', 'g'),")


def _equal(c: str, a: str, b: str) -> str:
    if c == "age":
        return _near(f"{a}.age", f"{b}.age")
    if c == "salary":
        x, y = f"TRY_CAST({a}.salary AS DOUBLE)", f"TRY_CAST({b}.salary AS DOUBLE)"
        return f"CASE WHEN {a}.salary IS NOT NULL AND {b}.salary IS NOT NULL AND ({x} IS NULL OR {y} IS NULL) THEN lower(CAST({a}.salary AS VARCHAR)) = lower(CAST({b}.salary AS VARCHAR)) ELSE {_near(x, y)} END"
    if c == "join_date":
        x, y = f"{a}.join_date", f"{b}.join_date"
        return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN {x} IS NULL AND {y} IS NULL WHEN {_day(x)} IS NOT NULL AND {_day(y)} IS NOT NULL THEN {_day(x)} = {_day(y)} ELSE {x} = {y} END"
    if c == "arabic_feedback":
        return f"{_FOLD.format(a + '.' + c)} = {_FOLD.format(b + '.' + c)}".replace("{{", "{").replace("}}", "}")
    return f"lower({a}.{c}) = lower({b}.{c})"


_CELLS = ["user_id", "tx_hash", "age", "salary", "city", "join_date", "arabic_feedback"]
_LONG = union_all([
    f"SELECT NOT ({_equal(c, 'r', 't')}) AS broken, {_equal(c, 'k', 't')} AS fixed, {_equal(c, 'k', 'r')} AS kept, k.{c} IS NULL AND t.{c} IS NOT NULL AS invalid FROM truth t JOIN corrupted r USING (row_id) JOIN repaired k USING (row_id)" for c in _CELLS])
ORACLES["i14_recovery_metrics"] = f"""WITH {TRUTH}, {CORRUPTED}, {REPAIRED}, l AS ({_LONG}), s AS (SELECT count(*) FILTER (WHERE broken) AS c, count(*) FILTER (WHERE broken AND fixed) AS f, count(*) FILTER (WHERE NOT broken) AS g, count(*) FILTER (WHERE NOT broken AND NOT kept) AS o, count(*) FILTER (WHERE invalid) AS i, count(*) AS n FROM l)
SELECT c AS corrupted_cells, f AS restored_cells, g AS safe_cells, o AS over_cleaned_cells, i AS invalid_cells, f / c * 100 AS exact_match_accuracy, o / g * 100 AS over_cleaning_rate, i / n * 100 AS corruption_rate FROM s"""


def _kind_sql() -> str:
    from tablewright.queries.audits import GROUPS

    parts = []
    for g, (kinds, cols) in GROUPS.items():
        hits = " + ".join(f"sum(CAST({_equal(c, 't', 'k')} AS INTEGER))" for c in cols)
        listed = ", ".join(f"'{k}'" for k in kinds)
        parts.append(f"SELECT '{g}' AS \"group\", CAST(coalesce({hits}, 0) AS BIGINT) AS matched, count(*) * {len(cols)} AS judged FROM (SELECT DISTINCT row_id FROM injected WHERE kind IN ({listed})) JOIN truth t USING (row_id) JOIN repaired k USING (row_id)")
    return f"WITH {TRUTH}, {CORRUPTED}, {INJECTED}, {REPAIRED} SELECT *, matched / judged * 100 AS recovered_pct FROM ({union_all(parts)})"


ORACLES["i15_recovery_by_kind"] = _kind_sql()


# ---- generators --------------------------------------------------------------------------------------
def people_table(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_name").alias("code"))


@query("c7_generator_profile")
def _(spark, sf):
    return synth.profile_table(people_table(spark, sf), "row_id")


@query("j11_independent_marginals")
def _(spark, sf):
    source = people_table(spark, sf)
    return synth.generate_independent(people_ids(spark, sf), "row_id", source, synth.generator_profile(source, "row_id"))


@query("j12_gaussian_copula")
def _(spark, sf):
    source = people_table(spark, sf).select("row_id", "balance", "segment", "nation")
    return synth.fit_copula(source, "row_id").sample(people_ids(spark, sf), "row_id")


@query("j13_sequences_and_templates", """SELECT p_partkey AS row_id, 'ID-PRT' || (p_partkey + 100) AS code, 'K' || chr(CAST(97 + p_partkey // 10000 % 26 AS INTEGER)) || '-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS serial FROM part""")
def _(spark, sf):
    k = F.col("row_id")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("row_id")).select("row_id", synth.sequence_value("PRT", 100, k).alias("code"), synth.template_value("K?-####", k).alias("serial"))


def _number(offset: int, low: int, span: int) -> str:
    return f"CAST(({sql_draw('row_id', offset)}) % {span} + {low} AS VARCHAR)"


@query("j14_masked_personal_values", f"""SELECT row_id, {sql_pick('row_id', 70, synth.FIRST_NAMES)} || ' ' || {sql_pick('row_id', 71, synth.LAST_NAMES)} AS name, lower({sql_pick('row_id', 80, synth.FIRST_NAMES)}) || '.' || lower({sql_pick('row_id', 81, synth.LAST_NAMES)}) || {_number(82, 1, 999)} || '@example.org' AS email,
'+1-' || {_number(93, 200, 700)} || '-' || {_number(94, 200, 700)} || '-' || {_number(95, 1000, 9000)} AS phone FROM (SELECT c_custkey AS row_id FROM customer)""")
def _(spark, sf):
    k = F.col("row_id")
    return people_ids(spark, sf).select("row_id", synth.masked_value("sensitive_name", k, 70).alias("name"), synth.masked_value("sensitive_email", k, 80).alias("email"), synth.masked_value("sensitive_phone", k, 90).alias("phone"))


SCHEMA = [
    {"name": "id", "type": "id"}, {"name": "name", "type": "name"}, {"name": "grade", "type": "category", "categories": ["A", "B", "C"]}, {"name": "years_of_experience", "type": "number", "min": 0, "max": 40},
    {"name": "salary", "type": "number", "min": 3000, "max": 25000}, {"name": "score", "type": "number", "min": 0, "max": 100, "is_float": True}, {"name": "hired", "type": "date"},
]


@query("j15_schema_generation")
def _(spark, sf):
    rules = [{"type": "conditional", "if_col": "grade", "if_op": "==", "if_val": "A", "then_col": "score", "then_val": 99}]
    return synth.generate_from_schema(people_ids(spark, sf), "row_id", SCHEMA, rules)


@query("j16_formula_rule", "SELECT p_partkey, p_size, p_retailprice * 2 + p_size AS p_retailprice FROM part")
def _(spark, sf):
    return synth.apply_formula(read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "p_retailprice * 2 + p_size")


@query("j17_conditional_rules", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'PROMO' ELSE p_type END AS p_type, p_brand, CASE WHEN p_size > 40 THEN p_retailprice * 0.9 ELSE p_retailprice END AS p_retailprice FROM part")
def _(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice", "p_size")
    df = synth.apply_conditional(df, "p_brand", "==", "Brand#2", "p_type", "PROMO")
    return synth.apply_conditional(df, "p_size", ">", "40", "p_retailprice", "p_retailprice * 0.9").drop("p_size")


def _sql_align(source: str, cause: str, effect: str, order: str = "") -> str:
    return f"a AS (SELECT row_id, {cause}, row_number() OVER (ORDER BY {cause}, row_id) AS p FROM {source}), b AS (SELECT {effect}, row_number() OVER (ORDER BY {effect} {order}) AS p FROM {source})"


@query("j18_correlation_rule", f"WITH t AS (SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part), {_sql_align('t', 'p_size', 'p_retailprice', 'DESC')} SELECT row_id, p_size, p_retailprice FROM a JOIN b USING (p)")
def _(spark, sf):
    df = read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_size", "p_retailprice")
    return synth.align_ranks(df, "row_id", "p_size", "p_retailprice", negative=True, noise=0.0)


@query("j19_generated_noise", f"""WITH {_O}, n AS (SELECT row_id, row_number() OVER (ORDER BY {sql_draw('row_id', 55)}, row_id) <= floor(count(*) OVER () * 5 / 100.0) AS h FROM o), m AS (SELECT row_id, row_number() OVER (ORDER BY {sql_draw('row_id', 56)}, row_id) <= floor(count(*) OVER () * 5 / 100.0) AS h FROM o),
p AS (SELECT o.row_id, CASE WHEN n.h THEN NULL ELSE price END AS price, CASE WHEN m.h THEN NULL ELSE status END AS status, priority FROM o JOIN n ON n.row_id = o.row_id JOIN m ON m.row_id = o.row_id),
x AS (SELECT row_id, row_number() OVER (ORDER BY {sql_draw('row_id', 5)}, row_id) <= floor(count(*) OVER () * 3 / 100.0) AS h FROM p WHERE price IS NOT NULL)
SELECT p.row_id, round(CASE WHEN x.h THEN price * {sql_pick('p.row_id', 105, [5.0, 10.0, -5.0])} ELSE price END, 4) AS price, status, priority FROM p LEFT JOIN x ON x.row_id = p.row_id""")
def _(spark, sf):
    kinds = {"price": "numerical", "status": "categorical", "priority": "sensitive_name"}
    return rounded(corrupt.generated_noise(orders(spark, sf), "row_id", kinds, 5.0, 3.0, exact=True), 4)


def synthetic_people(spark, sf):
    """A perturbed copy of the customers, portable to SQL."""
    k = F.col("row_id")
    return people_table(spark, sf).select(
        "row_id", F.round(F.col("balance") * (0.8 + unit(k, 31) * 0.4), 2).alias("balance"), F.when(chosen(k, 32, 0.3), F.lit("BUILDING")).otherwise(F.col("segment")).alias("segment"),
        F.pmod(draw(k, 33), F.lit(25).cast("bigint")).cast("double").alias("nation"), "code")


_PEOPLE = f"""orig AS (SELECT c_custkey AS row_id, c_acctbal AS balance, c_mktsegment AS segment, CAST(c_nationkey AS DOUBLE) AS nation, c_name AS code FROM customer),
syn AS (SELECT row_id, round(balance * (0.8 + {sql_unit('row_id', 31)} * 0.4), 2) AS balance, CASE WHEN {sql_chosen('row_id', 32, 0.3)} THEN 'BUILDING' ELSE segment END AS segment, CAST(({sql_draw('row_id', 33)}) % 25 AS DOUBLE) AS nation, code FROM orig)"""


def _ks(c: str) -> str:
    return (f"(SELECT round_even((1 - max(abs(fo / no - fs / ns))) * 100, 2) FROM (SELECT v, sum(sum(o)) OVER (ORDER BY v) AS fo, sum(sum(s)) OVER (ORDER BY v) AS fs FROM (SELECT {c} AS v, 1 AS o, 0 AS s FROM orig UNION ALL SELECT {c}, 0, 1 FROM syn) GROUP BY v), "
            "(SELECT (SELECT count(*) FROM orig) AS no, (SELECT count(*) FROM syn) AS ns))")


_TV = """(SELECT round_even((1 - sum(abs(coalesce(a, 0) - coalesce(b, 0))) / 2) * 100, 2) FROM (SELECT segment AS s, count(*) / (SELECT count(segment) FROM orig) AS a FROM orig WHERE segment IS NOT NULL GROUP BY segment) x
FULL JOIN (SELECT segment AS s, count(*) / (SELECT count(segment) FROM syn) AS b FROM syn WHERE segment IS NOT NULL GROUP BY segment) y ON x.s = y.s)"""


@query("j20_column_fidelity", f"WITH {_PEOPLE} SELECT 'balance' AS \"column\", {_ks('balance')} AS score UNION ALL SELECT 'nation', {_ks('nation')} UNION ALL SELECT 'segment', {_TV}")
def _(spark, sf):
    a, b = people_table(spark, sf), synthetic_people(spark, sf)
    return synth.numeric_fidelity(a, b, "balance").unionByName(synth.numeric_fidelity(a, b, "nation")).unionByName(synth.category_fidelity(a, b, ["segment"]))


@query("j21_fidelity_report", f"""WITH {_PEOPLE}, f AS (SELECT 'balance' AS "column", 'numerical' AS type, {_ks('balance')} AS fidelity_score UNION ALL SELECT 'nation', 'numerical', {_ks('nation')} UNION ALL SELECT 'segment', 'categorical', {_TV} UNION ALL SELECT 'code', 'sensitive_name', 100.0)
SELECT *, CASE WHEN fidelity_score >= 85 THEN 'excellent' WHEN fidelity_score >= 60 THEN 'acceptable' ELSE 'weak' END AS quality FROM f""")
def _(spark, sf):
    kinds = {"balance": "numerical", "nation": "numerical", "segment": "categorical", "code": "sensitive_name"}
    return synth.fidelity_report(people_table(spark, sf), synthetic_people(spark, sf), kinds)


_DCR = f"""b AS (SELECT min(balance) AS lb, max(balance) - min(balance) AS wb, min(nation) AS ln, max(nation) - min(nation) AS wn FROM orig), k AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS c FROM (SELECT DISTINCT segment FROM orig)), kt AS (SELECT max(c) AS top FROM k),
xo AS (SELECT (balance - lb) / wb AS x, (nation - ln) / wn AS y, c / top AS z FROM orig JOIN k USING (segment), b, kt), xs AS (SELECT row_id, (balance - lb) / wb AS x, (nation - ln) / wn AS y, coalesce(c, -1) / top AS z FROM syn LEFT JOIN k USING (segment), b, kt),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {sql_draw('row_id', 3)}, row_id) AS rn FROM xs)),
d AS (SELECT row_id, sqrt(min((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) + (p.z - o.z) * (p.z - o.z))) AS dcr FROM pick p, xo o GROUP BY row_id)"""


@query("j22_closest_records", f"WITH {_PEOPLE}, {_DCR} SELECT row_id, round(dcr, 6) AS dcr FROM d")
def _(spark, sf):
    return rounded(synth.closest_records(people_table(spark, sf), synthetic_people(spark, sf), "row_id", ["balance", "nation"], ["segment"]))


@query("j22_privacy_report", f"""WITH {_PEOPLE}, {_DCR}, m AS (SELECT avg(dcr) AS a FROM d), s AS (SELECT count(*) AS n, min(dcr) AS lo, max(dcr) AS hi, count(*) FILTER (WHERE dcr < a * 0.15) AS r, max(a) AS a FROM d, m),
p AS (SELECT *, round_even(r / n * 100, 2) AS pct, round_even(greatest(0, 100 - round_even(r / n * 100, 2)), 2) AS score FROM s)
SELECT n AS total_checked, round(a, 6) AS mean_dcr, round(lo, 6) AS min_dcr, round(hi, 6) AS max_dcr, round(a * 0.15, 6) AS risk_threshold, r AS at_risk_count, pct AS at_risk_pct, score AS privacy_score,
CASE WHEN score >= 95 THEN 'fully safe' WHEN score >= 80 THEN 'safe' WHEN score >= 60 THEN 'acceptable' WHEN score >= 40 THEN 'risky' ELSE 'high leak risk' END AS risk_level FROM p""")
def _(spark, sf):
    return rounded(synth.privacy_report(synth.closest_records(people_table(spark, sf), synthetic_people(spark, sf), "row_id", ["balance", "nation"], ["segment"])))


def _top(c: str, t: str) -> str:
    return f"(SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 5))"


@query("j23_data_dictionary", "SELECT 'p_size' AS \"column\", 'numerical' AS type, 0.0 AS null_pct, CAST(min(p_size) AS DOUBLE) AS min, CAST(max(p_size) AS DOUBLE) AS max, round_even(avg(p_size), 2) AS mean, NULL AS top_values FROM part "
       f"UNION ALL SELECT 'p_brand', 'categorical', 0.0, NULL, NULL, NULL, {_top('p_brand', 'part')} UNION ALL SELECT 'p_type', 'categorical', 0.0, NULL, NULL, NULL, {_top('p_type', 'part')}")
def _(spark, sf):
    return synth.data_dictionary(read(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type"), "p_partkey")


@query("j24_best_generator")
def _(spark, sf):
    return synth.best_generator(people_ids(spark, sf), "row_id", people_table(spark, sf).select("row_id", "balance", "segment", "nation"))


@query("j25_correlation_net", f"WITH t AS (SELECT c_custkey AS row_id, CAST(c_nationkey AS DOUBLE) AS experience, c_acctbal AS salary FROM customer), {_sql_align('t', 'experience', 'salary')} SELECT row_id, experience, CAST(round_even(salary, 0) AS BIGINT) AS salary FROM a JOIN b USING (p)")
def _(spark, sf):
    df = read(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("double").alias("experience"), F.col("c_acctbal").alias("salary"))
    return synth.enforce_correlation(df, "row_id", noise=0.0)


@query("j26_final_types", "SELECT p_partkey AS row_id, CAST(round_even(p_size + 0.4, 0) AS BIGINT) AS size, round(p_retailprice / 3, 2) AS price, p_brand AS brand, CAST(0 AS BIGINT) AS absent FROM part")
def _(spark, sf):
    df = read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_size") + 0.4).cast("string").alias("size"), (F.col("p_retailprice") / 3).alias("price"), F.col("p_brand").alias("brand"))
    specs = [{"name": "size", "type": "integer"}, {"name": "price", "type": "float"}, {"name": "brand", "type": "text"}, {"name": "absent", "type": "number"}]
    return synth.final_types(df, "row_id", specs)
