"""Dirty inputs derived from the given tables, as Spark frames and as the same views in SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.hashing import RANGE, draw, pick
from tablewright.functions.numbers import ARABIC_DIGITS, WESTERN_DIGITS
from tablewright.functions.tokens import CLEANER_TOKENS
from tablewright.queries.registry import read


# ---- SQL twins of the keyed draw -------------------------------------------------------------
def sql_draw(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST(CAST({key} AS BIGINT) AS VARCHAR) || ':{seed}'), 1, 15) AS BIGINT)"


def sql_chosen(key: str, seed: int, rate: float) -> str:
    return f"({sql_draw(key, seed)} < {int(round(rate * RANGE))})"


def sql_unit(key: str, seed: int) -> str:
    return f"(({sql_draw(key, seed)}) / {float(RANGE)})"


def sql_list(values: list) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def sql_pick(key: str, seed: int, options: list) -> str:
    return f"({sql_list(options)})[(({sql_draw(key, seed)}) % {len(options)}) + 1]"


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def modulo(key: Column, seed: int, n: int) -> Column:
    return F.pmod(draw(key, seed), F.lit(n).cast("bigint"))


# ---- dirty orders ------------------------------------------------------------------------------
def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, price, price_text, priority, status, date_text, order_date, cust_id."""
    k = F.col("o_orderkey")
    base = read(spark, folder, "orders").select(
        k.alias("row_id"), F.col("o_totalprice").alias("total"), F.floor("o_totalprice").cast("bigint").cast("string").alias("whole"),
        F.col("o_orderdate").alias("order_date"), F.col("o_custkey").alias("cust_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), modulo(k, 3, 12).alias("style"), modulo(k, 5, 6).alias("date_style"), draw(k, 4).alias("gap"),
        draw(k, 1).alias("lost"), draw(k, 2).alias("far"), pick(k, 6, CLEANER_TOKENS).alias("token_a"), pick(k, 7, CLEANER_TOKENS).alias("token_b"),
    )
    total, whole, style, day = F.col("total"), F.col("whole"), F.col("style"), F.col("order_date")
    price_text = (
        F.when(style == 0, F.col("token_a")).when(style == 1, F.concat(F.lit("$"), whole)).when(style == 2, F.concat(whole, F.lit(" EGP")))
        .when(style == 3, F.concat(F.floor(total / 1000).cast("bigint").cast("string"), F.lit("K"))).when(style == 4, F.concat(F.lit("("), whole, F.lit(")")))
        .when(style == 5, F.concat(whole, F.lit(" - "), F.floor(total * 2).cast("bigint").cast("string"), F.lit(" USD")))
        .when(style == 6, F.concat(F.pmod(F.col("row_id"), F.lit(100)).cast("string"), F.lit(".5%"))).when(style == 7, F.lit("1.5K - 3K"))
        .when(style == 8, F.concat(F.lit("Room "), whole)).when(style == 9, F.translate(whole, WESTERN_DIGITS, ARABIC_DIGITS)).when(style == 10, None)
        .otherwise(total.cast("string"))
    )
    date_style = F.col("date_style")
    date_text = (
        F.when(date_style == 0, F.date_format(day, "dd/MM/yyyy")).when(date_style == 1, F.date_format(day, "MM-dd-yyyy"))
        .when(date_style == 2, F.date_format(day, "dd MMM yyyy")).when(date_style == 3, F.lit("not known")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    )

    def under(column: str, rate: float) -> Column:
        return F.col(column) < int(round(rate * RANGE))

    priority = F.when(under("gap", 0.05), F.col("token_b")).when(under("gap", 0.10), None).otherwise(F.col("priority"))
    price = F.when(under("lost", 0.08), None).when(under("far", 0.02), total * 10).otherwise(total)
    return base.select(
        "row_id", price.alias("price"), price_text.alias("price_text"), priority.alias("priority"), "status", date_text.alias("date_text"), "order_date", "cust_id",
    )


_K = "o_orderkey"
_WHOLE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"
DIRTY_ORDERS = f"""dirty AS (
  SELECT {_K} AS row_id,
    CASE WHEN {sql_chosen(_K, 1, 0.08)} THEN NULL WHEN {sql_chosen(_K, 2, 0.02)} THEN o_totalprice * 10 ELSE o_totalprice END AS price,
    CASE ({sql_draw(_K, 3)}) % 12
      WHEN 0 THEN {sql_pick(_K, 6, CLEANER_TOKENS)}
      WHEN 1 THEN '$' || {_WHOLE}
      WHEN 2 THEN {_WHOLE} || ' EGP'
      WHEN 3 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || 'K'
      WHEN 4 THEN '(' || {_WHOLE} || ')'
      WHEN 5 THEN {_WHOLE} || ' - ' || CAST(CAST(floor(o_totalprice * 2) AS BIGINT) AS VARCHAR) || ' USD'
      WHEN 6 THEN CAST({_K} % 100 AS VARCHAR) || '.5%'
      WHEN 7 THEN '1.5K - 3K'
      WHEN 8 THEN 'Room ' || {_WHOLE}
      WHEN 9 THEN translate({_WHOLE}, '{WESTERN_DIGITS}', '{ARABIC_DIGITS}')
      WHEN 10 THEN NULL
      ELSE CAST(o_totalprice AS VARCHAR) END AS price_text,
    CASE WHEN {sql_chosen(_K, 4, 0.05)} THEN {sql_pick(_K, 7, CLEANER_TOKENS)} WHEN {sql_chosen(_K, 4, 0.10)} THEN NULL ELSE o_orderpriority END AS priority,
    o_orderstatus AS status,
    CASE ({sql_draw(_K, 5)}) % 6
      WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%m-%d-%Y') WHEN 2 THEN strftime(o_orderdate, '%d %b %Y')
      WHEN 3 THEN 'not known' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
    o_orderdate AS order_date, o_custkey AS cust_id
  FROM orders)"""


# ---- a later version of the same table ---------------------------------------------------------
def cleaned_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The dirty orders after a fixed repair: gaps filled, tokens replaced, some rows gone, one column gone."""
    df = dirty_orders(spark, folder)
    priority = F.when(F.col("priority").isin(CLEANER_TOKENS), None).otherwise(F.col("priority"))
    return df.where(draw(F.col("row_id"), 9) >= int(round(0.02 * RANGE))).select(
        "row_id", F.coalesce("price", F.lit(150000.0)).alias("price"), F.coalesce(priority, F.lit("3-MEDIUM")).alias("priority"), "status", "date_text",
        "order_date", F.col("cust_id").cast("string").alias("cust_id"), F.lit(1).alias("checked"),
    )


CLEANED_ORDERS = f"""cleaned AS (
  SELECT row_id, coalesce(price, 150000.0) AS price,
    coalesce(CASE WHEN priority IN {sql_in(CLEANER_TOKENS)} THEN NULL ELSE priority END, '3-MEDIUM') AS priority, status, date_text, order_date,
    CAST(cust_id AS VARCHAR) AS cust_id, 1 AS checked
  FROM dirty WHERE NOT {sql_chosen('row_id', 9, 0.02)})"""


# ---- contacts over customers -------------------------------------------------------------------
def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, id, email, phone, segment, balance, nation, customer_age."""
    k = F.col("c_custkey")
    number = k.cast("string")
    email = (
        F.when(modulo(k, 11, 8) == 0, F.concat(F.lit("user"), number, F.lit("#mail.com"))).when(modulo(k, 11, 8) == 1, None)
        .when(modulo(k, 11, 8) == 2, F.concat(F.lit("  USER"), number, F.lit("@Mail.COM "))).otherwise(F.concat(F.lit("user"), number, F.lit("@mail.com")))
    )
    phone = (
        F.when(modulo(k, 12, 6) == 0, F.concat(F.lit("+1-555-"), number)).when(modulo(k, 12, 6) == 1, F.concat(F.lit("(010) "), number, F.lit("-77")))
        .when(modulo(k, 12, 6) == 2, F.lit("12")).otherwise(F.concat(F.lit("2010"), number))
    )
    segment = F.when(draw(k, 13) < int(round(0.06 * RANGE)), None).otherwise(F.col("c_mktsegment"))
    return read(spark, folder, "customer").select(
        k.alias("row_id"), k.alias("id"), email.alias("email"), phone.alias("phone"), segment.alias("segment"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"), (modulo(k, 14, 140) - 10).cast("double").alias("customer_age"),
    )


_C = "c_custkey"
CONTACTS = f"""contacts AS (
  SELECT {_C} AS row_id, {_C} AS id,
    CASE ({sql_draw(_C, 11)}) % 8 WHEN 0 THEN 'user' || {_C} || '#mail.com' WHEN 1 THEN NULL WHEN 2 THEN '  USER' || {_C} || '@Mail.COM '
      ELSE 'user' || {_C} || '@mail.com' END AS email,
    CASE ({sql_draw(_C, 12)}) % 6 WHEN 0 THEN '+1-555-' || {_C} WHEN 1 THEN '(010) ' || {_C} || '-77' WHEN 2 THEN '12' ELSE '2010' || {_C} END AS phone,
    CASE WHEN {sql_chosen(_C, 13, 0.06)} THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS balance, c_nationkey AS nation,
    CAST(({sql_draw(_C, 14)}) % 140 - 10 AS DOUBLE) AS customer_age
  FROM customer)"""


# ---- repeated rows -----------------------------------------------------------------------------
def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse line items with many equal rows: row_id, name, status, flag, quantity, discount."""
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("flag"), F.floor(F.col("o_totalprice") / 20000).cast("bigint").alias("quantity"),
        F.year("o_orderdate").cast("bigint").alias("year"),
    )


REPEATED = """repeated AS (
  SELECT o_orderkey AS row_id, 'order ' || o_orderkey AS name, o_orderstatus AS status, o_orderpriority AS flag,
    CAST(floor(o_totalprice / 20000) AS BIGINT) AS quantity, CAST(year(o_orderdate) AS BIGINT) AS year
  FROM orders)"""
