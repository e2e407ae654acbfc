"""The replay source: schedule in closed form, slices that read only their positions, stop and resume."""

import math
import os
import time

import pytest
from pyspark.sql import functions as F

from brisa.sources.replay_source import (
    INDEX,
    ReplayReader,
    Schedule,
    replay_slice,
    run_until_sent,
    start_replay,
    store_replayable,
    to_folder,
)


def test_schedule_is_the_sum_of_its_rates():
    for s in (Schedule(), Schedule(3, 2, 4), Schedule.fixed(7), Schedule(1, 0, 1, total=5), Schedule(10, 5, 1, total=100)):
        sent = 0
        for second in range(40):
            assert s.sent_before(second) == (sent if s.total is None else min(sent, s.total))
            sent += s.start + s.step * (second // s.every)
    with pytest.raises(ValueError):
        Schedule(0)


def test_emit_second_agrees_with_the_offsets(spark):
    for s in (Schedule(3, 2, 4), Schedule.fixed(7)):
        got = {r.seq: r.emit_second for r in s.with_second(spark.range(300).withColumnRenamed("id", "seq")).collect()}
        for second in range(20):
            for seq in range(s.sent_before(second), min(300, s.sent_before(second + 1))):
                assert got[seq] == second


def test_reader_offsets():
    options = {**Schedule(10, 5, 1, total=100).options(), "secondsPerBatch": "2"}
    reader, at, seen = ReplayReader(options), {"second": 0, "sent": 0}, []
    while (end := reader.latestOffset()) != at:
        seen += [(p.first, p.end) for p in reader.partitions(at, end)]
        at = end
    assert seen == [(0, 25), (25, 70), (70, 100)] and reader.latestOffset() == at
    resumed = ReplayReader({**options, "fromSecond": "2", "fromSent": "25"})
    assert resumed.latestOffset() == {"second": 4, "sent": 70}
    clocked = ReplayReader({**Schedule.fixed(10).options(), "startedAt": str(time.time() - 5.5)})
    assert clocked.latestOffset() == {"second": 5, "sent": 50}
    assert ReplayReader({**Schedule.fixed(10).options(), "startedAt": str(time.time() + 99)}).latestOffset() == {"second": 0, "sent": 0}


@pytest.fixture()
def stored(spark, scratch):
    path = os.path.join(scratch, "stored")
    df = spark.range(1000).select((F.col("id") * 10).alias("x"))
    assert store_replayable(df, ["x"], path) == 1000
    return path


def test_slices(spark, stored):
    table = spark.read.parquet(stored)
    for a, z in ((0, 0), (0, 1), (0, 1000), (999, 1001), (1500, 1700), (2990, 3010), (10, 3500), (5000, 4000), (123_456_789_000, 123_456_789_005)):
        got = sorted((r.seq, r.cycle, r.x) for r in replay_slice(table, 1000, a, z).collect())
        assert got == [(q, q // 1000, q % 1000 * 10) for q in range(a, z)]
    assert replay_slice(table.filter("false"), 0, 0, 10).count() == 0


def test_a_slice_reads_only_its_positions(spark, stored):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    table = spark.read.parquet(stored)
    for a, z, files in ((100, 120, 1), (1990, 2010, 2)):
        part = replay_slice(table, 1000, a, z)
        assert f"GreaterThanOrEqual({INDEX},{a % 1000})" in plan(part) and "Exchange" not in plan(part)
        assert part.select(F.input_file_name().alias("f")).distinct().count() <= files < len(table.inputFiles())
        part.collect()
    # the scan's own count: rows of the files that hold the positions, not of the table
    part = replay_slice(table, 1000, 100, 120)
    part.collect()
    leaf = part._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < 1000


def test_replay_stops_and_resumes(spark, scratch, stored):
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    first, whole = Schedule(40, 20, 2, total=1300), Schedule(40, 20, 2, total=2500)
    for schedule in (first, whole, whole):  # the third finds all sent
        q = start_replay(spark, stored, 1000, schedule, to_folder(out), ck, seconds_per_batch=3)
        run_until_sent(q)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.seq for r in rows) == list(range(2500))
    assert all(r.x == r.seq % 1000 * 10 and r.cycle == r.seq // 1000 for r in rows)
    assert all(whole.sent_before(r.emit_second) <= r.seq < whole.sent_before(r.emit_second + 1) for r in rows)
    assert len({r.epoch for r in rows}) >= 4


def test_a_failed_epoch_is_sent_again_whole(spark, scratch, stored):
    out, ck, calls = os.path.join(scratch, "out"), os.path.join(scratch, "ck"), []

    def flaky(rows, epoch):
        to_folder(out)(rows, epoch)
        calls.append(epoch)
        if len(calls) == 2:
            raise RuntimeError("lost")

    schedule = Schedule.fixed(100, total=500)
    with pytest.raises(Exception, match="lost"):
        run_until_sent(start_replay(spark, stored, 1000, schedule, flaky, ck, seconds_per_batch=2))
    run_until_sent(start_replay(spark, stored, 1000, schedule, flaky, ck, seconds_per_batch=2))
    assert calls.count(calls[1]) == 2
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == list(range(500))


def test_clock_paced_replay(spark, scratch, stored):
    out = os.path.join(scratch, "out")
    q = start_replay(spark, stored, 1000, Schedule.fixed(50, total=150), to_folder(out), os.path.join(scratch, "ck"), started_at=time.time() - 1)
    try:
        deadline = time.time() + 60
        while time.time() < deadline and (not os.path.isdir(out) or spark.read.schema("seq long").parquet(out).count() < 150):
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted(r.seq for r in spark.read.schema("seq long").parquet(out).collect()) == list(range(150))
    assert math.isclose(Schedule.fixed(50).sent_before(3), 150)
