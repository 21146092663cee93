"""Controlled corruption by keyed draws: which cells change depends on the row key and the seed only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import cell, chosen, draw, pick, poisson_cuts, unit
from tablewright.functions.numbers import ARABIC_DIGITS, WESTERN_DIGITS
from tablewright.operators.frames import field, settle, string_columns
from tablewright.operators.ordered import prefix_sums

# Injected tokens and formats.
INCONSISTENT_TOKENS = ["Unknown", "N/A", "Error", "???", "Invalid"]
CHAOS_TOKENS = ["ERROR", "N/A", "??", "---", "UNKNOWN", "#VALUE!", "NULL"]
LETTERS = list(string.ascii_letters)
OUTLIER_MULTIPLIERS = [5.0, 10.0, -5.0]
UNKNOWN_DATE = "غير معروف"


@dataclass(frozen=True)
class Rule:
    """One corruption step: `problem` is missing, outliers, typos, format, type or duplicates; `ratio` in percent."""

    column: str | None
    problem: str
    ratio: float
    seed: int = 1


def exactly(df: DataFrame, row_id: str, n: int, seed: int) -> Column:
    """Predicate true for exactly n rows: the n smallest (draw, row id). Scalars only reach the driver."""
    if n <= 0:
        return F.lit(False)
    drawn = df.select(F.col(row_id).alias("id"), draw(F.col(row_id), seed).alias("d"))
    cells = drawn.groupBy(cell(F.col("d")).alias("c")).agg(F.count("*").alias("n"))
    edge = prefix_sums(cells, "c", {"before": F.col("n")}).where((F.col("before") < n) & (F.col("before") + F.col("n") >= n)).first()
    if edge is None:
        return F.lit(True)
    # a cell holds about a millionth of the rows
    inside = drawn.where(cell(F.col("d")) == edge["c"]).orderBy("d", "id").limit(int(n - edge["before"]))
    last = inside.agg(F.max(F.struct("d", "id")).alias("last")).first()["last"]
    value = draw(F.col(row_id), seed)
    return (value < last["d"]) | ((value == last["d"]) & (F.col(row_id) <= last["id"]))


def selected(df: DataFrame, row_id: str, ratio: float, seed: int, exact: bool = True) -> Column:
    """Rows to corrupt: exactly floor(rows·ratio) of them, or about that share without a counting pass."""
    if not 0 <= ratio <= 100:
        raise ValueError("ratio must be between 0 and 100")
    if not exact:
        return chosen(F.col(row_id), seed, ratio / 100.0)
    return exactly(df, row_id, int(df.count() * ratio / 100.0), seed)


def outlier_value(col: Column, key: Column, seed: int) -> Column:
    """Multiply or divide by a factor in [5, 500)."""
    factor = F.lit(5.0) + unit(key, seed + 11) * 495.0
    shrunk = F.when(col != 0, col / factor).otherwise(factor)
    return F.when(F.pmod(draw(key, seed + 12), F.lit(2).cast("bigint")) == 0, col * factor).otherwise(shrunk)


def typo_value(col: Column, key: Column, seed: int) -> Column:
    """Swap two neighbours, drop a character or add a letter; texts under two characters stay."""
    size = F.length(col)
    at = F.pmod(draw(key, seed + 21), F.greatest(size - 1, F.lit(1)).cast("bigint")).cast("int")
    head, rest = F.substring(col, F.lit(1), at), F.substring(col, at + 1, size)
    first, second = F.substring(rest, F.lit(1), F.lit(1)), F.substring(rest, F.lit(2), F.lit(1))
    kind = F.pmod(draw(key, seed + 22), F.lit(3).cast("bigint"))
    swapped = F.concat(head, second, first, F.substring(rest, F.lit(3), size))
    dropped = F.concat(head, F.substring(rest, F.lit(2), size))
    added = F.concat(head, pick(key, seed + 23, LETTERS), rest)
    return F.when(size < 2, col).when(kind == 0, swapped).when(kind == 1, dropped).otherwise(added)


def format_value(col: Column, key: Column, seed: int) -> Column:
    """Leading, trailing or middle spaces."""
    half = F.floor(F.length(col) / 2).cast("int")
    kind = F.pmod(draw(key, seed + 31), F.lit(3).cast("bigint"))
    middle = F.concat(F.substring(col, F.lit(1), half), F.lit("  "), F.substring(col, half + 1, F.length(col)))
    return F.when(kind == 0, F.concat(F.lit("   "), col)).when(kind == 1, F.concat(col, F.lit("   "))).otherwise(middle)


def apply_rules(df: DataFrame, row_id: str, rules: list[Rule], exact: bool = True) -> DataFrame:
    """Apply the rules in order."""
    for rule in rules:
        df = apply_rule(df, row_id, rule, exact)
    return df


def apply_rule(df: DataFrame, row_id: str, rule: Rule, exact: bool = True) -> DataFrame:
    if rule.problem == "duplicates":
        return duplicate_rows(df, row_id, rule.ratio / 100.0, rule.seed)
    if rule.column not in df.columns:
        raise ValueError(f"column {rule.column!r} not found")
    key, col, kind = F.col(row_id), F.col(rule.column), field(df, rule.column)
    if rule.problem == "outliers" and not isinstance(kind, T.NumericType):
        raise ValueError(f"outliers need a numeric column, got {rule.column!r}")
    text = col.cast("string")
    if rule.problem == "missing":
        value = F.lit(None).cast(kind)
    elif rule.problem == "outliers":
        value, col = outlier_value(col.cast("double"), key, rule.seed), col.cast("double")
    elif rule.problem == "typos":
        value, col = typo_value(text, key, rule.seed), text
    elif rule.problem == "format":
        value, col = format_value(text, key, rule.seed), text
    elif rule.problem == "type":
        value, col = pick(key, rule.seed + 41, INCONSISTENT_TOKENS), text
    else:
        raise ValueError(f"unknown problem {rule.problem!r}")
    return df.withColumn(rule.column, F.when(selected(df, row_id, rule.ratio, rule.seed, exact), value).otherwise(col))


def duplicate_rows(df: DataFrame, row_id: str, ratio: float, seed: int) -> DataFrame:
    """Append copies drawn with replacement: each row gets a Poisson(ratio) number of copies by keyed draw.

    Adds `copy_no` (0 for the original).
    """
    u = draw(F.col(row_id), seed)
    copies = sum(((u >= cut).cast("int") for cut in poisson_cuts(ratio)), F.lit(0))
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), copies)))


def chaos(df: DataFrame, row_id: str, missing_pct: float = 15.0, noise_pct: float = 10.0, seed: int = 42) -> DataFrame:
    """NULL over all cells and error tokens over text cells, each cell on its own keyed draw."""
    missing, noise = min(max(missing_pct / 100, 0.0), 0.99), min(max(noise_pct / 100, 0.0), 0.99)
    texts = set(string_columns(df))
    key, changed = F.col(row_id), {}
    for i, c in enumerate(c for c in df.columns if c != row_id):
        value = F.when(~chosen(key, seed + 3 * i, missing), F.col(c))
        if c in texts:
            value = F.when(chosen(key, seed + 3 * i + 1, noise), pick(key, seed + 3 * i + 2, CHAOS_TOKENS)).otherwise(value)
        changed[c] = value
    return df.withColumns(changed)


def mass_outliers(df: DataFrame, row_id: str, columns: list[str], pct: float, seed: int = 7, exact: bool = False) -> DataFrame:
    """Multiply a share of the known cells of each column by 5, 10 or −5."""
    for i, c in enumerate(columns):
        hit = (
            exactly(df.where(F.col(c).isNotNull()), row_id, int(df.where(F.col(c).isNotNull()).count() * pct / 100), seed + i)
            if exact else chosen(F.col(row_id), seed + i, pct / 100)
        )
        df = df.withColumn(c, F.when(hit, F.col(c) * pick(F.col(row_id), seed + 100 + i, OUTLIER_MULTIPLIERS)).otherwise(F.col(c).cast("double")))
    return df


def generated_noise(
    df: DataFrame, row_id: str, kinds: dict[str, str], null_pct: float, outlier_pct: float, seed: int = 5, exact: bool = False
) -> DataFrame:
    """NULL into every column that is not sensitive, then outliers into the numeric ones."""
    for i, (c, kind) in enumerate(kinds.items()):
        if null_pct > 0 and not kind.startswith("sensitive"):
            df = df.withColumn(c, F.when(~selected(df, row_id, null_pct, seed + 50 + i, exact), F.col(c)))
    if outlier_pct > 0:
        df = mass_outliers(df, row_id, [c for c, k in kinds.items() if k == "numerical"], outlier_pct, seed, exact)
    return df


def corrupt_people(
    df: DataFrame, row_id: str, missing: float = 0.10, outliers: float = 0.02, dates: float = 0.10, typos: float = 0.10, currency: float = 0.15,
    digits: float = 0.10, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Corrupt age, salary, join_date, city and arabic_feedback; returns the frame and the table (row_id, column, kind) of hit cells."""
    key = F.col(row_id)
    no_pay = chosen(key, seed + 1, missing)
    marked_rows = df.withColumns({
        "__no_age": chosen(key, seed, missing), "__no_pay": no_pay, "__far": chosen(key, seed + 2, outliers) & ~no_pay, "__late": chosen(key, seed + 3, dates),
        "__typo": chosen(key, seed + 4, typos), "__mark": chosen(key, seed + 5, currency) & ~no_pay, "__fold": chosen(key, seed + 6, digits),
        "__prefix": F.pmod(draw(key, seed + 7), F.lit(2).cast("bigint")) == 0, "__style": F.pmod(draw(key, seed + 8), F.lit(4).cast("bigint")),
        "__lower": F.pmod(draw(key, seed + 9), F.lit(2).cast("bigint")) == 0, "__number": (F.pmod(draw(key, seed + 10), F.lit(99).cast("bigint")) + 1).cast("string"),
    })
    rows = marked_rows.withColumn("__pay", F.when(F.col("__far"), F.col("salary") * 10.0).otherwise(F.col("salary")))
    rows = rows.withColumn("__whole", F.floor("__pay").cast("bigint").cast("string"))
    pay, whole, style, day = F.col("__pay"), F.col("__whole"), F.col("__style"), F.to_date("join_date")
    pay_text = F.when(pay == F.floor(pay), F.concat(whole, F.lit(".0"))).otherwise(pay.cast("string"))
    salary = (
        F.when(F.col("__no_pay"), None).when(F.col("__mark") & F.col("__prefix"), F.concat(F.lit("$"), whole))
        .when(F.col("__mark"), F.concat(whole, F.lit(" EGP"))).otherwise(pay_text)
    )
    date_text = (
        F.when(style == 0, F.date_format(day, "dd/MM/yyyy")).when(style == 1, F.date_format(day, "MM-dd-yyyy"))
        .when(style == 2, F.date_format(day, "dd MMM yyyy")).otherwise(F.lit(UNKNOWN_DATE))
    )
    half = F.floor(F.length("city") / 2).cast("int")
    middle = F.substring("city", half + 1, F.lit(1))
    swapped = F.concat(F.substring("city", F.lit(1), half), F.when(middle != "u", "u").otherwise("x"), F.substring("city", half + 2, F.length("city")))
    feedback = F.concat(F.translate("arabic_feedback", "أ", "ا"), F.lit(" "), F.translate("__number", WESTERN_DIGITS, ARABIC_DIGITS))
    changed = {
        "age": F.when(~F.col("__no_age"), F.col("age")),
        "salary": salary,
        "join_date": F.when(F.col("__late"), date_text).otherwise(F.col("join_date")),
        "city": F.when(F.col("__typo"), F.when(F.col("__lower"), F.lower("city")).otherwise(swapped)).otherwise(F.col("city")),
        "arabic_feedback": F.when(F.col("__fold"), feedback).otherwise(F.col("arabic_feedback")),
    }
    out = settle(rows.withColumns(changed).select(*df.columns), list(changed))
    marks = [
        ("__no_age", "age", "age_missing"), ("__no_pay", "salary", "salary_missing"), ("__far", "salary", "salary_outliers"), ("__late", "join_date", "join_date_corrupted"),
        ("__typo", "city", "city_typos"), ("__mark", "salary", "salary_currency_noise"), ("__fold", "arabic_feedback", "arabic_num_corrupted"),
    ]
    cells = F.array_compact(F.array(*[F.when(F.col(hit), F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"))) for hit, c, k in marks]))
    injected = marked_rows.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("cell")).select("row_id", "cell.*")
    return out, injected
