import os

from pyspark.sql import functions as F

from brisa.operators.throughput import throughput_log, throughput_screen
from brisa.plans.adapters import events_readings, lineitem_readings
from brisa.plans.pipeline import clean_job, frame_summary, load_frames
from brisa.sources.kafka import read_frames, write_frames
from brisa.streaming.pipelines import (
    RateListener,
    read_throughput_log,
    read_throughput_table,
    run_to_completion,
    start_clean_stream,
    start_throughput_log,
    start_throughput_table,
)
from tests.conftest import SF001


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_clean_stream_equals_batch(spark, scratch):
    inbox = os.path.join(scratch, "in")
    frames = load_frames(lineitem_readings(spark, SF001))
    write_frames(frames, "files", inbox)
    listener = RateListener(printer=lambda _: None)
    spark.streams.addListener(listener)
    try:
        q = start_clean_stream(read_frames(spark, "files", inbox, stream=True),
                               os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"))
        run_to_completion(q)
    finally:
        spark.streams.removeListener(listener)
    streamed = frame_summary(read_frames(spark, "files", os.path.join(scratch, "out")))
    batch = frame_summary(clean_job(read_frames(spark, "files", inbox)))
    assert _sorted(streamed.select("topic", "partition", "payload_bytes")) == \
        _sorted(batch.select("topic", "partition", "payload_bytes"))


def test_observers_count_every_message_in_one_batch_and_in_many(spark, scratch):
    inbox = os.path.join(scratch, "ev")
    frames = load_frames(events_readings(spark, SF001, keep=["ts"]), ts_col="ts")
    write_frames(frames.repartition(8), "files", inbox)  # unordered: most messages come late
    stored = read_frames(spark, "files", inbox)
    table, log = throughput_screen(stored, "timestamp", 3600, 600), throughput_log(stored, "timestamp", 600, 1000)
    for files in (None, 1):
        stream = read_frames(spark, "files", inbox, stream=True, files_per_trigger=files)
        out = os.path.join(scratch, f"tbl-{files}")
        q = start_throughput_table(stream, out, out + "-ck", 3600, 600)
        run_to_completion(q)
        assert len([p for p in q.recentProgress if p.numInputRows]) == (8 if files else 1)
        streamed = read_throughput_table(spark, out).select("window_start_unix", "n_msgs", "throughput_msgs_sec")
        assert _sorted(streamed) == _sorted(table)
        out = os.path.join(scratch, f"log-{files}")
        run_to_completion(start_throughput_log(stream, out, out + "-ck", 600, 1000))
        assert _sorted(read_throughput_log(spark, out, window_seconds=600)) == _sorted(log)


def test_observers_fail_on_messages_without_timestamp(spark, scratch):
    import pytest

    inbox, out = os.path.join(scratch, "unstamped"), os.path.join(scratch, "unstamped-out")
    write_frames(load_frames(events_readings(spark, SF001)).limit(3), "files", inbox)
    q = start_throughput_table(read_frames(spark, "files", inbox, stream=True), out, out + "-ck", 1)
    with pytest.raises(Exception, match="without timestamp"):
        run_to_completion(q)


def test_replay_stream_loops_over_dataset(spark):
    from brisa.operators.sequence import with_sequence
    from brisa.streaming.pipelines import replay_stream

    data = spark.range(7).select((F.col("id") * 10).alias("x"))
    indexed = with_sequence(data, ["x"], "_idx")
    stream = replay_stream(indexed, 7, 20, source="rate-micro-batch", rows_per_batch=20)
    q = (stream.writeStream.format("memory").queryName("replay_t").outputMode("append")
         .trigger(processingTime="200 milliseconds").start())
    try:
        import time
        deadline = time.time() + 60  # the rate source never ends: poll, then stop
        while time.time() < deadline and spark.table("replay_t").count() < 40:
            time.sleep(0.5)
    finally:
        q.stop()
    rows = spark.table("replay_t").collect()
    assert len(rows) >= 20
    assert all(r.x == (r.seq % 7) * 10 and r.cycle == r.seq // 7 for r in rows)


def test_clean_stream_fails_on_corrupt_payload(spark, scratch):
    import pytest

    inbox = os.path.join(scratch, "bad")
    good = load_frames(lineitem_readings(spark, SF001)).limit(5)
    bad = spark.createDataFrame([(bytearray(b"\xff\xff"),)], "value binary").select(
        F.lit(None).cast("binary").alias("key"), "value", F.lit("t").alias("topic"))
    write_frames(good.unionByName(bad), "files", inbox)
    q = start_clean_stream(read_frames(spark, "files", inbox, stream=True),
                           os.path.join(scratch, "o"), os.path.join(scratch, "c"))
    with pytest.raises(Exception):
        run_to_completion(q)


def test_three_observers_on_one_source(spark, scratch):
    from brisa.operators.codec import decode
    from brisa.operators.export import to_text_columns
    from brisa.schema import EXPORT_HEADER
    from brisa.sources.csv import csv_scan
    from brisa.streaming.pipelines import start_observers

    inbox = os.path.join(scratch, "obs_in")
    frames = load_frames(events_readings(spark, SF001, keep=["ts"]), ts_col="ts")
    corrupt = spark.createDataFrame([(bytearray(b"\xff\xff"),)], "value binary").select(
        F.lit(None).cast("binary").alias("key"), "value", F.lit("t").alias("topic"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"))
    write_frames(frames.unionByName(corrupt), "files", inbox)
    base = os.path.join(scratch, "obs")
    lines = []
    listener = RateListener(printer=lines.append)
    spark.streams.addListener(listener)
    try:
        queries = start_observers(spark, inbox, base)
        for q in queries.values():
            run_to_completion(q)
        dropped = sum(p.observedMetrics["decode"]["dropped"] for p in queries["export"].recentProgress
                      if "decode" in p.observedMetrics)
    finally:
        spark.streams.removeListener(listener)
    assert dropped == 1
    exported = csv_scan(spark, os.path.join(base, "export"))
    batch = to_text_columns(decode(read_frames(spark, "files", inbox), mode="permissive"))
    # the reader turns the quoted empty cells back into nulls
    expected = sorted((tuple(None if v == "" else v for v in r) for r in batch.collect()), key=repr)
    assert sorted((tuple(r) for r in exported.collect()), key=repr) == expected
    assert read_throughput_table(spark, os.path.join(base, "screen")).count() > 0
    header = spark.read.text(os.path.join(base, "export")).first().value
    assert header.replace('"', "").split(",") == EXPORT_HEADER


def test_clean_job_hooks(spark):
    from brisa.operators.clean import zero_to_null

    frames = load_frames(lineitem_readings(spark, SF001))
    custom = clean_job(frames, transform=lambda df: zero_to_null(df, ["chuva"]),
                       router=lambda df: df.withColumn("partition", F.lit(3)))
    parts = {r.partition for r in custom.select("partition").distinct().collect()}
    assert parts == {3}


def test_hold_stream_matches_batch(spark, scratch):
    from brisa.operators.events import hold_intervals
    from brisa.operators.sequence import ts_micros
    from brisa.plans.adapters import events_state
    from brisa.streaming.state import hold_intervals_stream

    ev = events_state(spark, SF001)
    inbox = os.path.join(scratch, "hs")
    ev.write.parquet(inbox)
    st = spark.readStream.schema(ev.schema).parquet(inbox)
    out = os.path.join(scratch, "hs_out")
    run_to_completion(hold_intervals_stream(st, "entity", "ts", 3600, "1 hour").writeStream
                      .format("parquet").option("path", out).option("checkpointLocation", out + "_ck")
                      .outputMode("append").trigger(availableNow=True).start())
    streamed = {(r.entity, r.s, r.e, r.n_events) for r in spark.read.parquet(out).selectExpr(
        "entity", "unix_micros(hold_start) AS s", "unix_micros(hold_end) AS e", "n_events").collect()}
    b = hold_intervals(ev, "entity", "ts", "event_id", 3600)
    b = b.select("entity", ts_micros(b, "hold_start").alias("s"), ts_micros(b, "hold_end").alias("e"),
                 "n_events")
    batch = {tuple(r) for r in b.collect()}
    max_us = ev.select(ts_micros(ev, "ts").alias("u")).agg(F.max("u")).first()[0]
    closed = {r for r in batch if r[2] < max_us - 3600 * 1_000_000}
    assert streamed <= batch and closed <= streamed and len(streamed) > 0


def test_single_observer_modes(spark, scratch):
    import pytest

    from brisa.streaming.pipelines import start_observer

    inbox = os.path.join(scratch, "one_obs")
    write_frames(load_frames(events_readings(spark, SF001, keep=["ts"]), ts_col="ts"), "files", inbox)
    q = start_observer(spark, inbox, os.path.join(scratch, "o1"), mode="logger")
    run_to_completion(q)
    assert read_throughput_log(spark, os.path.join(scratch, "o1", "log")).count() > 0
    with pytest.raises(ValueError):
        start_observer(spark, inbox, os.path.join(scratch, "o2"), mode="screen")


def test_hold_stream_zero_delay_is_one_interval_per_event(spark, scratch):
    from brisa.streaming.state import hold_intervals_stream

    inbox = os.path.join(scratch, "zero")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "entity string, id int").selectExpr(
        "entity", "cast('2024-01-01 00:00:00' as timestamp_ntz) AS ts").write.parquet(inbox)
    st = spark.readStream.schema("entity string, ts timestamp_ntz").parquet(inbox)
    out = os.path.join(scratch, "zero_out")
    run_to_completion(hold_intervals_stream(st, "entity", "ts", 0, "1 second").writeStream.format("parquet")
                      .option("path", out).option("checkpointLocation", out + "_ck")
                      .trigger(availableNow=True).start())
    rows = spark.read.parquet(out).collect()
    assert sorted(r.entity for r in rows) == ["a", "a", "b"] and all(r.n_events == 1 for r in rows)
