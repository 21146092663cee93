"""Stateful streams against brute force."""

from tablewright.queries.registry import read
from tablewright.queries.streams import arriving, closed_stream, run_stateful
from tablewright.streaming import operators as streaming

FOLDER = "/root/testdata/sf0.001"


def test_rate_gate_counts_accepted_requests_only(spark):
    limit, seconds = 2, 7200
    got = {r["event_id"]: r["accepted"] for r in run_stateful(streaming.rate_gate(closed_stream(spark, FOLDER, seconds), limit, seconds)).collect()}
    rows = sorted((r["user_id"], r["ts"], r["event_id"]) for r in read(spark, FOLDER, "events").collect())
    history, want = {}, {}
    for user, at, event in rows:
        recent = [t for t in history.get(user, []) if (at - t).total_seconds() < seconds]
        want[event] = len(recent) < limit
        history[user] = recent + [at] if want[event] else recent
    assert got == want and not all(want.values())


def test_upper_bound_never_undercounts(spark):
    events = read(spark, FOLDER, "events")
    rows = sorted((r["user_id"], r["ts"], r["event_id"]) for r in events.collect())
    want = {e: sum(1 for u2, t2, _ in rows if u2 == u and 0 < (t - t2).total_seconds() < 3600) for u, t, e in rows}
    got = {r["event_id"]: r["earlier"] for r in streaming.rate_upper_bound(events, 30, 3600).collect()}
    assert got == want


def gate(rows, limit, seconds):
    history, want = {}, {}
    for user, at, event in sorted(rows):
        recent = [t for t in history.get(user, []) if at - t < seconds]
        want[event] = len(recent) < limit
        history[user] = recent + [at] if want[event] else recent
    return want


def test_late_events_take_their_place_and_state_ends(spark, tmp_path):
    """Batches out of order: rows within the watermark count as if they had come in time, later ones are dropped, nothing is kept."""
    minute = 60
    batches = [
        [(1, 100 * minute, 1), (1, 101 * minute, 2), (2, 100 * minute, 3), (1, 103 * minute, 4)],
        [(1, 99 * minute, 5), (2, 101 * minute, 6), (3, 104 * minute, 7), (1, 102 * minute, 8)],  # before rows of the first batch
        [(1, 140 * minute, 9), (4, 135 * minute, 10)],
        [(1, 90 * minute, 11), (1, 120 * minute, 12), (2, 139 * minute, 13)],  # the watermark is at 130 minutes: two rows are too late
        [(None, 1000 * minute, None)],
    ]
    schema, source, target = "user_id long, at long, event_id long", tmp_path / "in", tmp_path / "out"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, streaming.ROCKSDB)
    progress = None
    try:
        for k, rows in enumerate(batches):
            made = spark.createDataFrame([(u, at, e) for u, at, e in rows], schema).selectExpr("user_id", "event_id", "timestamp_seconds(at) as ts")
            made.coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(made.schema).parquet(str(source))
            gated = streaming.rate_gate(stream, limit=2, seconds=5 * minute)
            job = gated.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(target))
            job.awaitTermination()
            progress = job.lastProgress
    finally:
        spark.conf.set(setting, before)
    got = {r["event_id"]: r["accepted"] for r in spark.read.schema("user_id long, event_id long, accepted boolean").parquet(str(target)).collect()}
    in_time = [r for b in batches for r in b if r[2] not in (None, 11, 12)]
    assert got == gate(in_time, 2, 5 * minute) and not all(got.values())
    assert progress.stateOperators[0].numRowsTotal == 0


def test_rolling_profile_equals_the_profile_of_all_rows_so_far(spark, tmp_path):
    target = str(tmp_path / "parts")
    arriving(spark, FOLDER, 3).writeStream.foreachBatch(streaming.profile_appender(target)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    events = read(spark, FOLDER, "events")
    rolling = streaming.rolling_profile(spark.read.parquet(target))
    whole = events.selectExpr("count(*)", "avg(value)", "stddev_samp(value)", "min(value)", "max(value)", "count(distinct user_id)").first()
    last = rolling.where("batch_id = 2 and column = 'value'").first()
    assert (last["rows"], last["low"], last["high"]) == (whole[0], whole[3], whole[4])
    assert abs(last["mean"] - whole[1]) < 1e-9 and abs(last["std"] - whole[2]) < 1e-9
    users = rolling.where("batch_id = 2 and column = 'user_id'").first()["distinct"]
    assert abs(users - whole[5]) <= 0.05 * whole[5]
    assert [r["rows"] for r in rolling.where("column = 'value'").orderBy("batch_id").collect()][-1] == whole[0]
    one = streaming.rolling_profile(spark.read.parquet(target), batches=1).where("column = 'value'")
    assert one.agg({"rows": "sum"}).first()[0] == whole[0] and one.count() == 3
