"""Synthetic tables: profiles, generators, rules, fidelity and privacy.

All random values are keyed draws on the output row id, so a table can be regenerated identically
on any partitioning.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import chosen, draw, pick, unit
from tablewright.functions.normal import normal_cdf, normal_quantile
from tablewright.functions.patterns import guard_phone
from tablewright.operators.corrupt import exactly
from tablewright.operators.frames import field, is_integer, melt, numeric_columns, settle, spread, with_few
from tablewright.operators.ordered import prefix_sums, row_positions
from tablewright.operators.profile import (column_counts, correlation_matrix, id_sequence, pattern_template, sensitive_types, value_counts)
from tablewright.operators.quantiles import exact_quantiles, modes, quantile_grid
from tablewright.session import checkpointed

# Ground-truth vocabularies and the name hints of the correlation safety net.
CITIES = ["Cairo", "Alexandria", "Giza", "Luxor", "Aswan"]
FEEDBACK = ["وصل الطلب في موعده", "اللون مختلف عن الصورة", "السعر مناسب والجودة جيدة", "لم يعمل الجهاز من أول يوم", "سأشتري منه مرة أخرى"]
CAUSE_NAMES = ["experience", "years_of_experience", "age", "year", "car_year", "service_years", "years", "tenure"]
EFFECT_NAMES = ["salary", "income", "price", "sales", "annual_sales", "revenue", "cost", "compensation"]
INVERSE_NAMES = ["remaining", "depreciation", "life_expectancy", "unused"]
FIRST_NAMES = ["Adam", "Bella", "Carl", "Dina", "Elias", "Farah", "Gamal", "Hana", "Ivan", "Jana", "Karim", "Lina", "Mona", "Nabil", "Omar", "Petra"]
LAST_NAMES = ["Abbott", "Barlow", "Castle", "Dalton", "Easton", "Fowler", "Garner", "Hassan", "Ismail", "Jansen", "Keller", "Larsen", "Mansour", "Nolan"]
STREETS = ["Oak Street", "River Road", "Hill Avenue", "Garden Lane", "Station Road", "Market Square", "Lake Drive", "Mill Way"]
WORDS = ["alpha", "bravo", "copper", "delta", "ember", "forest", "granite", "harbor", "indigo", "jasper", "kernel", "lumen", "meadow", "nectar"]
COPULA_STEPS = 4096
#: Rows of one category and one number each that are sent to all tasks; more are joined by a shuffle.
CODES_SENT = 100_000


def ground_truth(ids: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """People table over the given ids: user_id, tx_hash, age, salary, city, join_date (hourly steps), arabic_feedback."""
    key = F.col(row_id)
    start = F.lit("2021-01-01").cast("timestamp")
    return ids.select(
        key,
        F.concat(F.lit("USR-"), (key + 10000).cast("string")).alias("user_id"),
        F.substring(F.sha2(F.concat(F.lit("tx_"), key.cast("string"), F.lit(f"_{seed}")), 256), 1, 16).alias("tx_hash"),
        (F.pmod(draw(key, seed + 21), F.lit(52).cast("bigint")) + 18).cast("double").alias("age"),
        (F.pmod(draw(key, seed + 22), F.lit(22000).cast("bigint")) + 3000).cast("double").alias("salary"),
        pick(key, seed + 23, CITIES).alias("city"),
        F.date_format(F.timestamp_seconds(F.unix_seconds(start) + key * 3600), "yyyy-MM-dd").alias("join_date"),
        pick(key, seed + 24, FEEDBACK).alias("arabic_feedback"),
    )


def normal_draw(key: Column, seed: int) -> Column:
    """Standard normal value from a keyed draw. A large expression: settle() it before it is filtered or reused."""
    u = (draw(key, seed) + 0.5) / F.lit(float(1 << 60))
    return normal_quantile(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), u)))


def generator_profile(df: DataFrame, row_id: str) -> dict[str, dict]:
    """Per column: type, null percent, and the parameters its generator needs. Bounded by the schema and the guards."""
    columns = [c for c in df.columns if c != row_id]
    kinds = {r["column"]: r["kind"] for r in sensitive_types(df, row_id).collect()}  # one row per column
    counts = column_counts(df, columns)
    rows = counts["*"]["rows"]
    numbers = [c for c in columns if isinstance(field(df, c), T.NumericType)]
    stats = df.agg(F.count("*"), *[F.struct(F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), F.max(c).cast("double")).alias(c) for c in numbers]).first()
    profile: dict[str, dict] = {}
    for c in columns:
        info: dict = {"type": kinds[c], "null_pct": counts[c]["nulls"] / max(rows, 1) * 100}
        distinct = counts[c]["distinct"]
        if c in numbers:
            mean, std, low, high = stats[c]
            info.update(type="numerical", mean=mean or 0.0, std=std or 0.0, min=low or 0.0, max=high or 0.0, is_int=is_integer(field(df, c)))
            if info["is_int"] and distinct == rows:
                info = {"type": "id_sequence", "null_pct": info["null_pct"], "prefix": "", "min": int(low)}
        elif distinct == rows and isinstance(field(df, c), T.StringType):
            sequence = id_sequence(df, c).first()
            if sequence["is_sequence"] and sequence["prefix"]:
                info = {"type": "id_sequence", "null_pct": info["null_pct"], "prefix": sequence["prefix"], "min": sequence["start"]}
        if info["type"] == "categorical" and distinct > 20 and distinct / rows > 0.05:
            template = pattern_template(df, c).first()["template"]
            if "#" in template or "?" in template:
                info.update(type="pattern_sequence", template=template)
        profile[c] = info
    return profile


def profile_table(df: DataFrame, row_id: str) -> DataFrame:
    """The generator profile as rows (column, type, null_pct, mean, std, min, max, prefix, template)."""
    keys = ["mean", "std", "min", "max"]
    rows = [
        (c, i["type"], float(i["null_pct"]), *[float(i[k]) if i.get(k) is not None else None for k in keys], i.get("prefix"), i.get("template"))
        for c, i in generator_profile(df, row_id).items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, type string, null_pct double, mean double, std double, min double, max double, prefix string, template string")


def weighted_ranges(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, low, high): consecutive shares of [0, 1) in value order, from distributed prefix sums."""
    total = counts.agg(F.sum(weight)).first()[0] or 1
    coded = counts.withColumn("__code", F.xxhash64(value).cast("double"))
    placed = prefix_sums(coded, "__code", {"__before": F.col(weight)}, ties=[value])
    return placed.select(value, (F.col("__before") / float(total)).alias("low"), ((F.col("__before") + F.col(weight)) / float(total)).alias("high"))


def assign_by_share(df: DataFrame, share: Column, ranges: DataFrame, value: str, name: str, cells: int = 1024) -> DataFrame:
    """Attach the value whose [low, high) holds the row's share. An equi-join on a uniform grid, not a range scan."""
    first, last = F.floor(F.col("low") * cells), F.floor(F.least(F.col("high"), F.lit(1 - 1e-12)) * cells)
    gridded = ranges.where("high > low").select(F.col(value).alias(name), "low", "high", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("__cell"))
    rows = df.withColumn("__share", share).withColumn("__cell", F.floor(F.col("__share") * cells).cast("int"))
    joined = rows.join(gridded, (rows["__cell"] == gridded["__cell"]) & (rows["__share"] >= gridded["low"]) & (rows["__share"] < gridded["high"]), "left")
    return joined.select(*df.columns, name)


def masked_value(kind: str, key: Column, seed: int) -> Column:
    """Generated personal value: name, email, phone, address or national id."""
    first, last = pick(key, seed, FIRST_NAMES), pick(key, seed + 1, LAST_NAMES)

    def number(offset: int, low: int, span: int) -> Column:
        return (F.pmod(draw(key, seed + offset), F.lit(span).cast("bigint")) + low).cast("string")

    if kind == "sensitive_email":
        return F.concat(F.lower(first), F.lit("."), F.lower(last), number(2, 1, 999), F.lit("@example.org"))
    if kind == "sensitive_phone":
        return F.concat(F.lit("+1-"), number(3, 200, 700), F.lit("-"), number(4, 200, 700), F.lit("-"), number(5, 1000, 9000))
    if kind == "sensitive_address":
        return F.concat(number(6, 1, 900), F.lit(" "), pick(key, seed + 7, STREETS), F.lit(", "), pick(key, seed + 8, CITIES))
    if kind == "sensitive_id":
        return F.concat(number(9, 100, 800), F.lit("-"), number(10, 10, 90), F.lit("-"), number(11, 1000, 9000))
    return F.concat(first, F.lit(" "), last)


def template_value(template: str, index: Column) -> Column:
    """Write a row index into a template: # takes a digit, ? a lower-case letter, from the right; unique while the template has room."""
    parts, place = [], F.lit(1).cast("bigint")
    for ch in reversed(template):
        if ch in "#?":
            base = 10 if ch == "#" else 26
            slot = F.pmod(F.floor(index / place), F.lit(base).cast("bigint"))
            letter = F.char(slot + (48 if ch == "#" else 97))
            parts.append(letter)
            place = place * base
        else:
            parts.append(F.lit(ch))
    return F.concat(*reversed(parts)) if parts else F.lit("")


def sequence_value(prefix: str, start: int, index: Column, lead: str = "ID-") -> Column:
    return F.concat(F.lit(f"{lead}{prefix}"), (index + start).cast("string"))


def generate_independent(ids: DataFrame, row_id: str, source: DataFrame, profile: dict[str, dict], seed: int = 42) -> DataFrame:
    """One row per id: every column from its own marginal, with the source's NULL rate."""
    key, out = F.col(row_id), spread(ids.select(row_id), row_id)
    for i, (c, info) in enumerate(profile.items()):
        s, kind = seed + 37 * i, info["type"]
        if kind == "numerical":
            out = settle(out.withColumn("__z", normal_draw(key, s)), ["__z"])
            value = F.lit(info["mean"]) + F.col("__z") * (info["std"] if info["std"] > 0 else 1.0)
            value = F.greatest(F.lit(info["min"]), F.least(F.lit(info["max"]), value))
            out = out.withColumn(c, F.bround(value, 0).cast("bigint") if info["is_int"] else value).drop("__z")
        elif kind == "id_sequence":
            out = out.withColumn(c, sequence_value(info["prefix"], info["min"], key))
        elif kind == "pattern_sequence":
            out = out.withColumn(c, template_value(info["template"], key))
        elif kind.startswith("sensitive"):
            out = out.withColumn(c, masked_value(kind, key, s))
        else:
            counts = source.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias(c)).agg(F.count("*").alias("n"))
            out = assign_by_share(out, unit(key, s), weighted_ranges(counts, c, "n"), c, c)
        if info["null_pct"] > 0:
            out = out.withColumn(c, F.when(~chosen(key, s + 9, info["null_pct"] / 100), F.col(c)))
    return out


class CopulaModel:
    """Fitted Gaussian copula: marginals as quantile grids or category shares, dependence as a covariance matrix."""

    def __init__(self, columns: list[str], kinds: dict[str, str], grids: dict[str, list[float]], shares: dict[str, DataFrame], mean: np.ndarray, cov: np.ndarray):
        self.columns, self.kinds, self.grids, self.shares, self.mean, self.cov = columns, kinds, grids, shares, mean, cov

    def sample(self, ids: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
        """One row per id: correlated normals, mapped through the normal distribution function to each marginal."""
        key = F.col(row_id)
        lower = np.linalg.cholesky(self.cov)
        noise = [f"__e{j}" for j in range(len(self.columns))]
        out = settle(spread(ids.select(row_id), row_id).select(row_id, *[normal_draw(key, seed + 1009 * (j + 1)).alias(e) for j, e in enumerate(noise)]), noise)
        shares = {}
        for i, c in enumerate(self.columns):
            z = F.lit(float(self.mean[i]))
            for j in range(i + 1):
                z = z + F.col(f"__e{j}") * float(lower[i, j])
            shares[c] = z
        out = settle(out.select(row_id, *[shares[c].alias(f"__u_{c}") for c in self.columns]), [f"__u_{c}" for c in self.columns])
        out = out.withColumns({f"__u_{c}": F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), normal_cdf(F.col(f"__u_{c}")))) for c in self.columns})
        out = settle(out, [f"__u_{c}" for c in self.columns])
        for c in self.columns:
            if self.kinds[c] == "numerical":
                grid = self.grids[c]
                table = F.from_json(F.lit(json.dumps(grid)), "array<double>")  # fixed size: COPULA_STEPS + 1 numbers
                at = F.col(f"__u_{c}") * float(len(grid) - 1)
                low, high = F.element_at(table, F.floor(at).cast("int") + 1), F.element_at(table, F.ceil(at).cast("int") + 1)
                out = settle(out.withColumn(c, low + (high - low) * (at - F.floor(at))), [c])
            else:
                out = assign_by_share(out, F.col(f"__u_{c}"), self.shares[c], c, c)
        return out.select(row_id, *self.columns)


def fit_copula(df: DataFrame, row_id: str, columns: list[str] | None = None, steps: int = COPULA_STEPS) -> CopulaModel:
    """Fit on all rows. Average ranks come from distinct values and prefix sums; gaps take the median or the mode."""
    columns = columns or [c for c in df.columns if c != row_id]
    numbers = [c for c in columns if isinstance(field(df, c), T.NumericType)]
    texts = [c for c in columns if c not in numbers]
    middle = exact_quantiles(df, {c: [0.5] for c in numbers})
    common = modes(df.select(*[F.col(c).cast("string").alias(c) for c in texts]), texts) if texts else {}
    filled = df.select(
        row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(middle[c][0.5] or 0.0)).alias(c) for c in numbers],
        *[F.coalesce(F.col(c).cast("string"), F.lit(common[c] or "missing")).alias(c) for c in texts],
    )
    filled = checkpointed(spread(filled, row_id))  # each column's counts and the joins read this
    total = filled.count()
    grids, shares, scores = {}, {}, filled
    for c in columns:
        counts = filled.groupBy(c).agg(F.count("*").alias("__n"))
        if c in numbers:
            placed = prefix_sums(counts, c, {"__before": F.col("__n")})
            grids[c] = quantile_grid(filled, c, max(1, min(steps, total - 1)))
        else:
            # text order: rank of the text among distinct values, through a prefix sum over coded prefixes
            placed = _text_prefix(counts, c)
            shares[c] = placed.select(c, (F.col("__before") / float(total)).alias("low"), ((F.col("__before") + F.col("__n")) / float(total)).alias("high"))
        u = (F.col("__before") + (F.col("__n") + 1) / 2 - 0.5) / float(total)
        clipped = settle(placed.select(c, F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), u)).alias("__u")), ["__u"])
        places = checkpointed(clipped.select(c, normal_quantile(F.col("__u")).alias(f"__z_{c}")))
        # few values are sent, so that rows of one value are not one task
        scores = scores.join(with_few(places, CODES_SENT), c)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = scores.agg(
        *[F.avg(f"__z_{c}").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_samp(f"__z_{columns[i]}", f"__z_{columns[j]}").alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    cov = np.eye(len(columns)) * 1e-6
    for i, j in pairs:
        cov[i, j] += row[f"c{i}_{j}"] or 0.0
        if i != j:
            cov[j, i] = cov[i, j]
    return CopulaModel(columns, {c: "numerical" if c in numbers else "categorical" for c in columns}, grids, shares, mean, cov)


def _text_prefix(counts: DataFrame, column: str) -> DataFrame:
    """Prefix counts in text order: range-bucketed by the six bytes after the shared prefix, sorted whole inside a bucket."""
    ends = counts.agg(F.min(column), F.max(column)).first()
    shared = 0
    if ends[0] is not None:
        a, b = ends[0].encode(), ends[1].encode()
        while shared < min(len(a), len(b)) and a[shared] == b[shared]:
            shared += 1
    code = F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), shared + 1, 6)), 12, "0"), 16, 10).cast("double")
    return prefix_sums(counts.withColumn("__code", code), "__code", {"__before": F.col("__n")}, ties=[column])


def checked_expression(df: DataFrame, text: str) -> Column:
    """SQL expression whose column references all exist in the frame; analysis errors are raised here."""
    df.limit(0).selectExpr(text)
    return F.expr(text)


def apply_formula(df: DataFrame, target: str, expression: str) -> DataFrame:
    return df.withColumn(target, checked_expression(df, expression))


def apply_conditional(df: DataFrame, if_col: str, if_op: str, if_val, then_col: str, then_val) -> DataFrame:
    """Set then_col (literal or expression) where the comparison holds."""
    left = F.col(if_col)
    try:
        number = float(if_val)
        left, right = left.try_cast("double"), F.lit(number)
    except (TypeError, ValueError):
        right = F.lit(str(if_val))
    tests = {"==": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}
    text = str(then_val)
    kind = field(df, then_col)
    refers = any(c in text for c in df.columns) or (any(ch in text for ch in "+*/%") and isinstance(kind, T.NumericType))
    value = checked_expression(df, text).cast(kind) if refers else F.lit(then_val).cast(kind)
    return df.withColumn(then_col, F.when(F.coalesce(tests[if_op], F.lit(False)), value).otherwise(F.col(then_col)))


def align_ranks(
    df: DataFrame, row_id: str, cause: str, effect: str, negative: bool = False, noise: float = 0.10, low: float | None = None,
    high: float | None = None, whole: bool = False, seed: int = 9,
) -> DataFrame:
    """Re-order the values of `effect` so their ranks follow (or oppose) `cause`, add noise, clip to the bounds.

    Both columns get distributed positions and meet on them; nothing is sorted in one task.
    """
    base = df.withColumns({cause: F.coalesce(F.col(cause).cast("double"), F.lit(0.0)), effect: F.coalesce(F.col(effect).cast("double"), F.lit(0.0))})
    total, std, least, most = base.agg(F.count("*"), F.stddev_pop(effect), F.min(effect), F.max(effect)).first()
    left = row_positions(base.drop(effect), cause, row_id, "__pos")
    right = row_positions(base.select(row_id, effect), effect, row_id, "__pos").select("__pos", effect)
    if negative:
        right = right.withColumn("__pos", F.lit(total - 1) - F.col("__pos"))
    value = F.col(effect)
    if noise:
        left = settle(left.withColumn("__z", normal_draw(F.col(row_id), seed)), ["__z"])
        value = value + F.col("__z") * ((std or 1.0) * noise)
    value = F.greatest(F.lit(float(least if low is None else low)), F.least(F.lit(float(most if high is None else high)), value))
    if whole:
        value = F.bround(value, 0).cast("bigint")
    return left.join(right, "__pos").withColumn(effect, value).select(*df.columns)


def enforce_correlation(df: DataFrame, row_id: str, noise: float = 0.10, floats: list[str] = ()) -> DataFrame:
    """Align the first experience-like and pay-like numeric columns when their correlation is under 0.5."""
    numbers = numeric_columns(df, [row_id])
    cause = next((c for c in numbers if any(k in c.lower() for k in CAUSE_NAMES)), None)
    effect = next((c for c in numbers if any(k in c.lower() for k in EFFECT_NAMES)), None)
    if not cause or not effect or cause == effect:
        return df
    r = df.agg(F.corr(F.col(cause).cast("double"), F.col(effect).cast("double"))).first()[0]
    if r is not None and r == r and abs(r) >= 0.5:
        return df
    negative = any(k in c.lower() for k in INVERSE_NAMES for c in (cause, effect))
    return align_ranks(df, row_id, cause, effect, negative, noise, whole=effect not in floats)


def apply_table_rules(df: DataFrame, row_id: str, rules: list[dict]) -> DataFrame:
    """Formulas and conditionals in order, then correlations, then the phone guard."""
    for rule in rules:
        if rule["type"] == "formula":
            df = apply_formula(df, rule["target"], rule["expression"])
        elif rule["type"] == "conditional":
            df = apply_conditional(df, rule["if_col"], rule["if_op"], rule["if_val"], rule["then_col"], rule["then_val"])
    for rule in rules:
        if rule["type"] == "correlation":
            df = align_ranks(df, row_id, rule["col1"], rule["col2"], rule.get("direction") == "negative", rule.get("noise", 0.10), rule.get("min"), rule.get("max"))
    return df.withColumns({f.name: guard_phone(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)})


def _schema_column(spec: dict, key: Column, seed: int) -> Column:
    kind, low_name = spec.get("type", "text"), spec.get("name", "column").lower()
    if spec.get("categories"):
        return pick(key, seed, list(spec["categories"]))
    if kind == "id":
        return key + 1
    if kind == "category":
        return pick(key, seed, ["Category A", "Category B", "Category C"])
    if kind in ("name", "email", "phone", "address"):
        return masked_value(f"sensitive_{kind}", key, seed)
    if kind in ("number", "integer", "float"):
        low, high = int(spec.get("min", 0)), int(spec.get("max", 100))
        if spec.get("is_float") or kind == "float":
            return F.round(F.lit(float(low)) + unit(key, seed) * float(high - low), 2)
        return F.pmod(draw(key, seed), F.lit(high - low + 1).cast("bigint")) + low
    if kind == "date":
        return F.date_format(F.date_sub(F.lit(spec.get("today", "2025-01-01")).cast("date"), F.pmod(draw(key, seed), F.lit(1826).cast("bigint")).cast("int")), "yyyy-MM-dd")
    for hint, guess in (("email", "email"), ("name", "name"), ("phone", "phone"), ("mobile", "phone"), ("tel", "phone"), ("address", "address"), ("street", "address")):
        if hint in low_name:
            return masked_value(f"sensitive_{guess}", key, seed)
    if "city" in low_name:
        return pick(key, seed, CITIES)
    return F.concat_ws(" ", *[pick(key, seed + 60 + i, WORDS) for i in range(10 if kind == "text" else 1)])


def generate_from_schema(ids: DataFrame, row_id: str, columns: list[dict], rules: list[dict] = (), seed: int = 42, noise: float = 0.10) -> DataFrame:
    """Table from column specs: values, correlation safety net, rules, final typing."""
    key = F.col(row_id)
    table = ids.select(row_id, *[_schema_column(s, key, seed + 101 * i).alias(s["name"]) for i, s in enumerate(columns)])
    floats = [s["name"] for s in columns if s.get("is_float") or s.get("type") == "float"]
    table = enforce_correlation(table, row_id, noise, floats)
    table = apply_table_rules(table, row_id, list(rules))
    return final_types(table, row_id, columns)


def final_types(df: DataFrame, row_id: str, columns: list[dict]) -> DataFrame:
    """Whole numbers with NULL as 0, decimals to two places, columns in spec order."""
    out = [F.col(row_id)]
    for spec in columns:
        name, kind = spec["name"], spec.get("type", "")
        value = F.col(name) if name in df.columns else F.lit(None).cast("string")
        if kind in ("integer", "id") or (kind == "number" and not spec.get("is_float")):
            value = F.coalesce(F.bround(value.try_cast("double"), 0).cast("bigint"), F.lit(0).cast("bigint"))
        elif kind == "float" or (kind == "number" and spec.get("is_float")):
            value = F.round(value.try_cast("double"), 2)
        out.append(value.alias(name))
    return df.select(*out)


def numeric_fidelity(original: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(column, score): 100·(1 − KS distance) from one pass over distinct values and prefix sums."""
    sides = original.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("s")).unionByName(
        synthetic.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("s")))
    counts = sides.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.sum("o").alias("o"), F.sum("s").alias("s"))
    n_o, n_s = counts.agg(F.coalesce(F.sum("o"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    if not n_o or not n_s:
        return original.sparkSession.createDataFrame([(column, 0.0)], "column string, score double")
    placed = prefix_sums(counts, "v", {"po": F.col("o"), "ps": F.col("s")})
    gap = F.abs((F.col("po") + F.col("o")) / float(n_o) - (F.col("ps") + F.col("s")) / float(n_s))
    return placed.agg(F.bround((F.lit(1.0) - F.max(gap)) * 100, 2).alias("score")).select(F.lit(column).alias("column"), "score")


def category_fidelity(original: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column, score): 100·(1 − half the L1 distance of the frequencies), all columns in one pass."""
    one = value_counts(original, columns).select("column", "value", F.col("ratio").alias("a"))
    two = value_counts(synthetic, columns).select("column", "value", F.col("ratio").alias("b"))
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return one.join(two, ["column", "value"], "full_outer").groupBy("column").agg(F.bround((F.lit(1.0) - F.sum(gap) / 2) * 100, 2).alias("score"))


def fidelity_report(original: DataFrame, synthetic: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, type, score, quality) with bands at 85 and 60; sensitive columns score 100."""
    spark = original.sparkSession
    shared = [c for c in original.columns if c in synthetic.columns and c in kinds]
    report = None
    for c in [c for c in shared if kinds[c] == "numerical"]:
        part = numeric_fidelity(original, synthetic, c)
        report = part if report is None else report.unionByName(part)
    texts = [c for c in shared if kinds[c] == "categorical"]
    if texts:
        part = category_fidelity(original, synthetic, texts)
        report = part if report is None else report.unionByName(part)
    rest = [(c, 100.0 if kinds[c].startswith("sensitive") else 0.0) for c in shared if kinds[c] not in ("numerical", "categorical")]
    if rest:
        part = spark.createDataFrame(rest, "column string, score double")
        report = part if report is None else report.unionByName(part)
    typed = spark.createDataFrame([(c, kinds[c]) for c in shared], "column string, type string")
    return report.join(typed, "column").select(
        "column", "type", F.col("score").alias("fidelity_score"),
        F.when(F.col("score") >= 85, "excellent").when(F.col("score") >= 60, "acceptable").otherwise("weak").alias("quality"),
    )


def closest_records(
    original: DataFrame, synthetic: DataFrame, row_id: str, numbers: list[str], texts: list[str] = (), sample_size: int | None = None, seed: int = 3
) -> DataFrame:
    """(row_id, dcr): distance of each checked synthetic row to its closest original row.

    Both sides are scaled on the original's bounds and codes. Every synthetic row is checked against the
    cells of originals that can hold a closer one. With a `sample_size` only so many are: they are broadcast, and every task reduces its
    originals to one minimum per checked row before the shuffle.
    """
    bounds = original.agg(F.count("*"), *[F.struct(F.min(F.coalesce(c, F.lit(0))), F.max(F.coalesce(c, F.lit(0)))).alias(c) for c in numbers]).first()
    missing = "__MISSING__"
    codes = {}
    for c in texts:
        counts = original.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c)).agg(F.count("*").alias("n"))
        table = checkpointed(_text_prefix(counts.withColumn("__n", F.lit(1)), c).select(c, F.col("__before").alias(f"__code_{c}")))
        # small tables are sent, so that a value most rows hold is not one task
        codes[c] = F.broadcast(table) if table.count() <= CODES_SENT else table

    def scaled(df: DataFrame) -> DataFrame:
        out = df.select(row_id, *numbers, *[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in texts])
        values = []
        for c in numbers:
            low, high = bounds[c]
            values.append(((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(low)) / (float(high - low) or 1.0)).alias(f"x_{c}"))
        for c in texts:
            out = out.join(codes[c], c, "left")
            top = codes[c].agg(F.max(f"__code_{c}")).first()[0] or 1
            values.append((F.coalesce(F.col(f"__code_{c}"), F.lit(-1)) / float(top)).alias(f"x_{c}"))
        return out.select(row_id, *values)

    features = [f"x_{c}" for c in (*numbers, *texts)]
    target, points = scaled(synthetic), scaled(original)
    if sample_size is None:
        from tablewright.operators.neighbours import nearest_rows

        near = nearest_rows(target, points.withColumnRenamed(row_id, "__other"), row_id, "__other", features, k=1)
        return near.select(F.col("query").alias(row_id), F.col("distance").alias("dcr"))
    size = target.count()
    if size > sample_size:
        target = target.where(exactly(target, row_id, sample_size, seed))
    checked = target.toPandas().sort_values(row_id)  # at most sample_size rows
    ids, rows = checked[row_id].to_numpy(), checked[features].to_numpy(float)
    shared = original.sparkSession.sparkContext.broadcast(rows)

    def nearest(batches):
        best = np.full(len(shared.value), np.inf)
        for batch in batches:
            block = batch[features].to_numpy(float)
            for start in range(0, len(block), 4096):
                part = block[start:start + 4096]
                for i, row in enumerate(shared.value):
                    best[i] = min(best[i], ((part - row) ** 2).sum(1).min())
        yield pd.DataFrame({"place": np.arange(len(best)), "squared": best})

    minima = points.select(*features).mapInPandas(nearest, "place bigint, squared double").groupBy("place").agg(F.sqrt(F.min("squared")).alias("dcr"))
    labels = original.sparkSession.createDataFrame(pd.DataFrame({"place": np.arange(len(ids)), row_id: ids}))
    return minima.join(labels, "place").select(row_id, "dcr")


def privacy_report(distances: DataFrame) -> DataFrame:
    """One row: mean, min and max distance, risk threshold (0.15·mean), rows at risk, privacy score and band."""
    mean = distances.agg(F.avg("dcr")).first()[0] or 0.0
    limit = mean * 0.15
    stats = distances.agg(
        F.count("*").alias("total_checked"), F.lit(mean).alias("mean_dcr"), F.min("dcr").alias("min_dcr"), F.max("dcr").alias("max_dcr"),
        F.lit(limit).alias("risk_threshold"), F.count_if(F.col("dcr") < limit).alias("at_risk_count"),
    )
    scored = stats.withColumn("at_risk_pct", F.bround(F.col("at_risk_count") / F.col("total_checked") * 100, 2))
    scored = scored.withColumn("privacy_score", F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - F.col("at_risk_pct")), 2))
    level = (
        F.when(F.col("privacy_score") >= 95, "fully safe").when(F.col("privacy_score") >= 80, "safe")
        .when(F.col("privacy_score") >= 60, "acceptable").when(F.col("privacy_score") >= 40, "risky").otherwise("high leak risk")
    )
    return scored.withColumn("risk_level", level)


def data_dictionary(df: DataFrame, row_id: str) -> DataFrame:
    """(column, type, null_pct, min, max, mean, top_values): five most frequent categories joined by commas."""
    columns = [c for c in df.columns if c != row_id]
    numbers = [c for c in columns if isinstance(field(df, c), T.NumericType)]
    texts = [c for c in columns if isinstance(field(df, c), T.StringType)]
    stats = df.agg(
        F.count("*").alias("__rows"), *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean")).alias(f"s_{c}") for c in numbers],
    )
    blank = F.lit(None).cast("double")
    rows = melt(stats, [(c, {
        "type": F.lit("numerical" if c in numbers else "categorical" if c in texts else "datetime"),
        "null_pct": (F.col("__rows") - F.col(f"n_{c}")) / F.col("__rows") * 100,
        "min": F.col(f"s_{c}.min") if c in numbers else blank, "max": F.col(f"s_{c}.max") if c in numbers else blank,
        "mean": F.bround(f"s_{c}.mean", 2) if c in numbers else blank,
    }) for c in columns])
    from pyspark.sql.window import Window

    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    top = value_counts(df, texts).withColumn("r", F.row_number().over(order)).where("r <= 5")  # the rank limit is applied before the shuffle too
    listed = top.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]), ", ").alias("top_values"))
    return rows.join(listed, "column", "left")


def best_generator(ids: DataFrame, row_id: str, source: DataFrame, seed: int = 42) -> DataFrame:
    """(generator, mean_fidelity, chosen): independent marginals against the copula."""
    profile = {c: i for c, i in generator_profile(source, row_id).items() if i["type"] in ("numerical", "categorical")}
    kinds = {c: i["type"] for c, i in profile.items()}
    tables = {
        "independent": generate_independent(ids, row_id, source, profile, seed),
        "copula": fit_copula(source, row_id, list(profile)).sample(ids, row_id, seed),
    }
    result = None
    for name, table in tables.items():
        table = checkpointed(table)  # judged column by column
        part = fidelity_report(source, table, kinds).agg(F.avg("fidelity_score").alias("mean_fidelity")).select(F.lit(name).alias("generator"), "mean_fidelity")
        result = part if result is None else result.unionByName(part)
    scores = result.collect()  # two rows
    best = max(scores, key=lambda r: (r["mean_fidelity"], r["generator"]))
    return source.sparkSession.createDataFrame(
        [(r["generator"], r["mean_fidelity"], r["generator"] == best["generator"]) for r in scores],
        "generator string, mean_fidelity double, chosen boolean")
