"""Operational reports over fact tables: every one starts from the tenant predicate, which reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.numbers import size_text

# Label used when no accuracy is known, and status sets.
DEFAULT_ACCURACY = 98.4
ACTIVE = ["pending", "processing", "running"]


def for_tenant(df: DataFrame, tenant: object, column: str = "user_id") -> DataFrame:
    return df.where(F.col(column) == F.lit(tenant))


def kpis(jobs: DataFrame, done: str = "completed", kinds: tuple[str, ...] = ("cleaning", "synthetic", "automl"), active: list[str] = ACTIVE) -> DataFrame:
    """One row from one pass: finished jobs per kind, stored bytes (and as text), mean accuracy, active jobs."""
    finished = F.col("status") == done
    stats = jobs.agg(
        *[F.count_if(finished & (F.col("task_type") == k)).alias(f"total_{k}") for k in kinds],
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.round(F.avg("accuracy_rate"), 2), F.lit(DEFAULT_ACCURACY)).alias("avg_accuracy"),
        F.count_if(F.col("status").isin(active)).alias("active_jobs"),
    )
    return stats.withColumn("storage_used", size_text(F.col("total_bytes")))


def latest_per(df: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """Newest row per key by a max over structs; combined map-side, so a heavy key costs one row per task."""
    rest = [c for c in df.columns if c not in (key, when, tie)]
    best = df.groupBy(key).agg(F.max(F.struct(when, tie, *rest)).alias("__row"))
    return best.select(key, "__row.*").select(*df.columns)


def most_recent(df: DataFrame, when: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(when), F.desc(tie)).limit(n)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def daily_timeline(df: DataFrame, when: str, last_day: Column, days: int = 7) -> DataFrame:
    """(day, n) for the days up to last_day, zero where nothing happened. The date filter reaches the scan."""
    spark = df.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    window = df.where((F.col(when) >= F.date_sub(last_day, days - 1).cast("timestamp")) & (F.col(when) < F.date_add(last_day, 1).cast("timestamp")))
    counts = window.groupBy(F.to_date(when).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def token_sums(usage: DataFrame, key: str) -> DataFrame:
    return usage.groupBy(key).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"),
        F.count("*").alias("calls"))


def joined_count(facts: DataFrame, logs: DataFrame, key: str, tenant: object, tenant_col: str = "user_id") -> DataFrame:
    """Facts whose log belongs to the tenant."""
    return facts.join(for_tenant(logs, tenant, tenant_col).select(key), key).agg(F.count("*").alias("n"))


def answers_wide(df: DataFrame, answers: str, keep: list[str], max_keys: int = 500) -> DataFrame:
    """JSON object column to one text column per key found anywhere; the key list is bounded and checked."""
    parsed = df.withColumn("__map", F.from_json(answers, "map<string,string>"))
    keys = [r["k"] for r in parsed.select(F.explode(F.map_keys("__map")).alias("k")).distinct().orderBy("k").limit(max_keys + 1).collect()]
    if len(keys) > max_keys:
        raise ValueError(f"more than {max_keys} answer keys")
    return parsed.select(*keep, *[F.try_element_at("__map", F.lit(k)).alias(k) for k in keys])


def history(jobs: DataFrame, when: str, tie: str, columns: dict[str, Column]) -> DataFrame:
    """Formatted rows, newest first."""
    return jobs.orderBy(F.desc(when), F.desc(tie)).select(*[v.alias(k) for k, v in columns.items()])


def admin_totals(users: DataFrame, jobs: DataFrame, status: str = "status") -> DataFrame:
    """(entity, status, n): all users, all jobs and jobs per status in one long table."""
    total_users = users.agg(F.count("*").alias("n")).select(F.lit("users").alias("entity"), F.lit("all").alias("status"), "n")
    per = jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("jobs").alias("entity"), F.lit("all").alias("status"), "n")
    return total_users.unionByName(total).unionByName(per.select(F.lit("jobs").alias("entity"), "status", "n"))


def last_messages(df: DataFrame, session: str, order: str, role: str, n: int = 6, roles: dict[str, str] | None = None) -> DataFrame:
    """The newest n messages per session in time order with mapped roles; Spark limits each group before the shuffle too."""
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    kept = df.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= n)
    label = F.col(role)
    for old, new in (roles or {}).items():
        label = F.when(F.col(role) == old, new).otherwise(label)
    return kept.withColumn(role, label).drop("__r").orderBy(session, order)
