"""Structured Streaming operators, each with a batch twin where event order allows one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tablewright.functions.tokens import is_dirty
from tablewright.operators.frames import field, melt, numeric_columns
from tablewright.operators.profile import cell_key, quality_score

# The rate limit.
RATE_LIMIT = 30
RATE_SECONDS = 60
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EventGate(StatefulProcessor):
    """Admit an event when fewer than `limit` admitted ones of its key lie in the `seconds` before it, in event order.

    Arriving events wait in the state until the watermark passes them, so events of later batches that come in time take their
    place before them. Then they are judged by time and event id. State: the waiting events of a key and at most `limit`
    admitted times. A timer at the next waiting event or at the end of the last admitted one's window brings the key up to date;
    when nothing waits and all windows have ended, the state of the key is cleared.
    """

    def __init__(self, limit: int, seconds: int, key: list[str], verdict: str):
        self.limit, self.micros, self.key, self.verdict = limit, seconds * 1_000_000, key, verdict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        whole = T.LongType()
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("at", whole), T.StructField("event_id", whole)]))
        self.admitted = handle.getValueState("admitted", T.StructType([T.StructField("times", T.ArrayType(whole))]))

    def handleInputRows(self, key, rows, timerValues):
        arrived = [(int(at), int(event)) for f in rows for at, event in zip(f["at"], f["event_id"], strict=True)]
        if arrived:
            self.waiting.appendList(arrived)
            self._wake(min(at for at, _ in arrived), timerValues)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        times = list(self.admitted.get()[0]) if self.admitted.exists() else []
        due = [w for w in waiting if w[0] <= now]
        verdicts = []
        for at, _ in due:
            times = [t for t in times if at - t < self.micros]
            verdicts.append(len(times) < self.limit)
            if verdicts[-1]:
                times.append(at)
        later = waiting[len(due):]
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        open_times = [t for t in times if t + self.micros > now]
        if open_times:
            self.admitted.update((open_times,))
        elif self.admitted.exists():
            self.admitted.clear()
        if later or open_times:
            self._wake(min([at for at, _ in later[:1]] + [t + self.micros for t in open_times[-1:]]), timerValues)
        if due:
            out = pd.DataFrame({"event_id": [event for _, event in due], self.verdict: verdicts})
            for name, value in reversed(list(zip(self.key, key, strict=True))):
                out.insert(0, name, value)
            yield out

    def _wake(self, at: int, timerValues) -> None:
        """Timers have milliseconds: the first one that is not before the moment, and not one that has passed."""
        self.handle.registerTimer(max(-(-at // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def _gated(events: DataFrame, key: list[str], limit: int, seconds: int, lateness: str, verdict: str) -> DataFrame:
    kinds = dict(events.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + f", event_id bigint, {verdict} boolean"
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rows = rows.select(*key, "event_id", "ts", F.unix_micros("ts").alias("at"))
    # heartbeats have moved the watermark and go no further; a condition that also reads the time is not moved before it
    rows = rows.where(F.when(F.col("ts").isNotNull(), F.col("event_id")).isNotNull())
    return rows.groupBy(*key).transformWithStateInPandas(EventGate(limit, seconds, key, verdict), schema, "Append", "EventTime")


def cache_gate(events: DataFrame, key: list[str], seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """(key…, event_id, miss): exact time-to-live cache on a stream; an event is a miss when no miss of its key lies in the last
    `seconds`. Verdicts come when the watermark passes an event; rows that come after that are dropped; rows without an event id
    are heartbeats. Keys must be known. Needs the RocksDB state store."""
    return _gated(events, key, 1, seconds, lateness, "miss")


def rate_gate(events: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, accepted) over a stream of (user_id, event_id, ts): accepted when fewer than `limit` accepted events of
    the user lie in the last `seconds`. Verdicts, late rows and heartbeats as in cache_gate. Needs the RocksDB state store."""
    return _gated(events, ["user_id"], limit, seconds, lateness, "accepted")


def rate_upper_bound(events: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """Batch twin on arrivals: earlier events of the key within the window, and whether the limit is reached.

    Counts rejected arrivals too, so it bounds the stateful count from above. A key is cut into
    slots of one window length and an event only meets its own and the previous slot, so a heavy
    key spreads over its slots.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = F.floor(micros / F.lit(seconds * 1_000_000))
    rows = events.select("user_id", "event_id", micros.alias("__t"), slot.alias("__slot"))
    seen = rows.withColumn("__home", F.explode(F.array(F.col("__slot"), F.col("__slot") + 1)))
    window = Window.partitionBy("user_id", "__home").orderBy("__t").rangeBetween(-(seconds * 1_000_000 - 1), -1)
    counted = seen.withColumn("earlier", F.count("*").over(window)).where(F.col("__home") == F.col("__slot"))
    return counted.select("user_id", "event_id", "earlier", (F.col("earlier") >= limit).alias("over_limit"))


def cache_misses(queries: DataFrame, key: list[str], lateness: str = "10 minutes") -> DataFrame:
    """The queries that the cache can not serve: the misses of cache_gate, by key and event id."""
    return cache_gate(queries, key, lateness=lateness).where("miss").drop("miss")


def daily_activity(events: DataFrame, when: str, lateness: str = "1 day") -> DataFrame:
    """(day, n) per tumbling day; rows later than the watermark are dropped in a stream."""
    counted = events.withWatermark(when, lateness).groupBy(F.window(when, "1 day")).agg(F.count("*").alias("n"))
    return counted.select(F.to_date(F.col("window.start")).alias("day"), "n")


def quality_appender(target: str, columns: list[str] | None = None):
    """foreachBatch function that appends the quality score of each arriving batch, keyed by batch id.

    A batch replayed after a failure overwrites its own folder, so each batch id is stored once.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns) if columns else batch
        if rows.limit(1).count() == 0:
            return
        rows = rows.persist()
        scored = quality_score(rows).withColumn("row_count", F.lit(rows.count()))
        scored.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        rows.unpersist()

    return append


def profile_part(rows: DataFrame) -> DataFrame:
    """One row a column that parts can be merged from: rows, dirty cells, values, mean, squares around it, bounds, distinct sketch."""
    numeric, entries, aggregates = set(numeric_columns(rows)), [], [F.count("*").alias("rows")]
    for k, c in enumerate(rows.columns):
        value = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        value = F.when(~F.isnan(value), value)
        aggregates.append(F.struct(
            F.count_if(is_dirty(F.col(c), field(rows, c))).alias("dirty"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
            F.min(value).alias("low"), F.max(value).alias("high"), F.hll_sketch_agg(cell_key(rows, c)).alias("sketch")).alias(f"s{k}"))
        s = f"s{k}"
        entries.append((c, {
            "rows": F.col("rows"), "dirty": F.col(f"{s}.dirty"), "n": F.col(f"{s}.n"), "mean": F.col(f"{s}.mean"),
            "squares": F.col(f"{s}.variance") * F.col(f"{s}.n"), "low": F.col(f"{s}.low"), "high": F.col(f"{s}.high"), "sketch": F.col(f"{s}.sketch"),
        }))
    return melt(rows.agg(*aggregates), entries)


def profile_appender(target: str, columns: list[str] | None = None):
    """foreachBatch function that writes the profile part of each batch, keyed by batch id; a replayed batch overwrites its own."""

    def append(batch: DataFrame, batch_id: int) -> None:
        part = profile_part(batch.select(*columns) if columns else batch)
        part.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return append


def rolling_profile(parts: DataFrame, batches: int | None = None) -> DataFrame:
    """One row a batch and column: the profile of all rows so far, or of those of the last `batches` batches.

    Merged from the parts alone: counts add up, means and squares around them by the rule for joining two samples, sketches by
    their union. Equals the profile of the same rows at once, but for rounding and the error of the sketch.
    """
    first = -(batches - 1) if batches else Window.unboundedPreceding
    ordered = Window.partitionBy("column").orderBy("batch_id")
    numbered = parts.withColumn("__k", F.row_number().over(ordered))
    ends = numbered.select("batch_id", "column", F.col("__k").alias("__end"))
    # a part belongs to all later batches of its window; parts are a row a batch and column
    low = F.col("__end") + (first if batches else 0)
    inside = (F.col("p.__k") <= F.col("__end")) & ((F.col("p.__k") >= low) if batches else F.lit(True))
    held = ends.join(numbered.alias("p"), (ends["column"] == F.col("p.column")) & inside).select(ends["batch_id"], ends["column"], "rows", "dirty", "n", "mean", "squares", "low", "high", "sketch")
    merged = held.groupBy("batch_id", "column").agg(
        F.sum("rows").alias("rows"), F.sum("dirty").alias("dirty"), F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "mean", "squares")).alias("samples"),  # one a batch of the window
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    apart = F.aggregate("samples", F.lit(0.0), lambda total, x: total + F.when(x["n"] > 0, x["squares"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean"))).otherwise(0.0))
    std = F.when(F.col("n") > 1, F.sqrt(F.try_divide(apart, F.col("n") - 1)))
    return merged.select("batch_id", "column", "rows", "dirty", F.try_divide(F.lit(100.0) * F.col("dirty"), F.col("rows")).alias("dirty_pct"), "n", "mean", std.alias("std"), "low", "high", "distinct")
