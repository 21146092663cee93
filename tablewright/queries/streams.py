"""Queries: streaming operators run to completion over the given tables, and their batch twins."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.queries.registry import query, read
from tablewright.queries.tables import scratch
from tablewright.streaming import operators as streaming


def event_stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    schema = read(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def closed_stream(spark: SparkSession, sf: str, seconds: int) -> DataFrame:
    """The events with a heartbeat behind the last one, so that the watermark passes all of them and every window ends."""
    events = read(spark, sf, "events")
    last = events.agg(F.max("ts")).first()[0]
    target = scratch(spark, f"heartbeat-{uuid4().hex[:8]}")
    beat = F.lit(last).cast("timestamp") + F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(seconds))
    spark.range(1).select(*[(beat if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(target)
    return event_stream(spark, sf).unionByName(spark.readStream.schema(events.schema).parquet(target))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain the source into a Parquet table with a checkpoint and read it back."""
    spark = stream.sparkSession
    target = scratch(spark, f"stream-{uuid4().hex[:8]}")
    job = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", target + "-checkpoint").trigger(availableNow=True).start(target)
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def run_updates(stream: DataFrame, key: list[str]) -> DataFrame:
    """Drain the source in update mode, each batch's changed rows in a folder of its number; the last row of a key counts."""
    spark = stream.sparkSession
    target = scratch(spark, f"stream-{uuid4().hex[:8]}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    job = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", target + "-checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    last = spark.read.parquet(target).groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("last"))
    return last.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


@query("m1_rate_upper_bound", """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) AS earlier,
count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) >= 2 AS over_limit FROM events""")
def _(spark, sf):
    return streaming.rate_upper_bound(read(spark, sf, "events"), limit=2)


def run_stateful(stream: DataFrame) -> DataFrame:
    """run() with the RocksDB state store for the duration of the query."""
    spark, setting = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, streaming.ROCKSDB)
    try:
        return run(stream)
    finally:
        spark.conf.set(setting, before)


_RECENT = "list_filter(s.h, lambda x: o.t - x < 3600000000)"


@query("m1_rate_gate", f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT user_id, event_id, rn, true AS accepted, [t] AS h FROM o WHERE rn = 1
UNION ALL SELECT o.user_id, o.event_id, o.rn, len({_RECENT}) < 3, CASE WHEN len({_RECENT}) < 3 THEN list_append({_RECENT}, o.t) ELSE {_RECENT} END FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1)
SELECT user_id, event_id, accepted FROM s""")
def _(spark, sf):
    return run_stateful(streaming.rate_gate(closed_stream(spark, sf, 3600), limit=3, seconds=3600))


# a miss starts an hour of hits: each next miss of a key is its first event an hour or more after the last one
@query("m2_cache_gate", """WITH RECURSIVE m AS (SELECT user_id, event_type, min(ts) AS at FROM events GROUP BY ALL
UNION ALL SELECT m.user_id, m.event_type, (SELECT min(ts) FROM events e WHERE e.user_id = m.user_id AND e.event_type = m.event_type AND e.ts >= m.at + INTERVAL 1 HOUR) FROM m WHERE m.at IS NOT NULL)
SELECT e.user_id, e.event_type, e.event_id, m.at IS NOT NULL AS miss FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.event_type = e.event_type AND m.at = e.ts""")
def _(spark, sf):
    return run_stateful(streaming.cache_gate(closed_stream(spark, sf, 3600), ["user_id", "event_type"]))


@query("m2_cache_misses", """WITH RECURSIVE m AS (SELECT user_id, event_type, min(ts) AS at FROM events GROUP BY ALL
UNION ALL SELECT m.user_id, m.event_type, (SELECT min(ts) FROM events e WHERE e.user_id = m.user_id AND e.event_type = m.event_type AND e.ts >= m.at + INTERVAL 1 HOUR) FROM m WHERE m.at IS NOT NULL)
SELECT e.user_id, e.event_type, e.event_id FROM events e JOIN m ON m.user_id = e.user_id AND m.event_type = e.event_type AND m.at = e.ts""")
def _(spark, sf):
    return run_stateful(streaming.cache_misses(closed_stream(spark, sf, 3600), ["user_id", "event_type"]))


@query("m3_daily_activity", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    batch = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.daily_activity(batch, "ts").withColumn("day", F.col("day").cast("string"))


@query("m3_daily_activity_stream", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    stream = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    # days are few, and the last ones never close: each batch brings the days it changed up to date
    return run_updates(streaming.daily_activity(stream, "ts").withColumn("day", F.col("day").cast("string")), ["day"])


@query("m4_batch_quality")
def _(spark, sf):
    target = scratch(spark, "quality")
    stream = event_stream(spark, sf).select("event_id", "user_id", "event_type", "value")
    stream.writeStream.foreachBatch(streaming.quality_appender(target)).option("checkpointLocation", target + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def arriving(spark: SparkSession, sf: str, batches: int) -> DataFrame:
    """The events as a stream of several batches."""
    target = scratch(spark, f"arriving-{uuid4().hex[:8]}")
    rows = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    # a file each by event id: every batch has some of all times
    rows.repartition(batches, F.pmod("event_id", F.lit(batches))).write.parquet(target)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(target)


@query("m4_rolling_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, {f'count({c})' if c != 'event_type' else '0'} AS n, """
    + ", ".join(f"round({f}({c}), 4) AS {n}" if c != "event_type" else f"CAST(NULL AS DOUBLE) AS {n}" for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "low"), ("max", "high")))
    + " FROM events" for c in ("event_id", "user_id", "event_type", "value")))
def _(spark, sf):
    target = scratch(spark, f"rolling-{uuid4().hex[:8]}")
    arriving(spark, sf, 4).writeStream.foreachBatch(streaming.profile_appender(target)).option("checkpointLocation", target + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    rolling = streaming.rolling_profile(spark.read.parquet(target))
    last = rolling.join(rolling.agg(F.max("batch_id").alias("batch_id")), "batch_id")  # what all batches together say
    return last.select("column", "rows", "n", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("mean", "std", "low", "high")])
