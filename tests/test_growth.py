"""Observers over many epochs, recovery of the cleaning stream, placement of a hot station."""

import os
from statistics import median

import pytest
from pyspark.sql import functions as F

from brisa.operators.codec import decode
from brisa.operators.route import place_balanced
from brisa.plans.adapters import lineitem_readings
from brisa.plans.pipeline import clean_job, load_frames
from brisa.sources.kafka import read_frames, write_frames
from brisa.streaming import pipelines
from brisa.streaming.pipelines import read_throughput_table, run_to_completion, start_clean_stream, start_throughput_table
from brisa.streaming.versions import list_versions
from tests.conftest import SF001


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_over_200_epochs(spark, scratch):
    """Reads open one base and a bounded number of epochs; a retried epoch counts once."""
    table = pipelines._counts(scratch)
    want = {}
    for epoch in range(200):
        table.fold(spark, epoch)
        rows = [(epoch % 7 * 60_000_000, epoch, 60, 1.0), (0, 1, 60, 1.0)]
        df = spark.createDataFrame(rows, pipelines.PARTIAL_COUNTS).coalesce(1)
        table.write(df, epoch)
        if epoch % 17 == 0 or epoch % 20 == 0:  # fails after the write, is done again
            table.fold(spark, epoch)
            table.write(df, epoch)
        for start, n, _, _ in rows:
            want[start] = want.get(start, 0) + n
    bases, epochs = list_versions(spark, scratch, "base="), list_versions(spark, scratch, "epoch=")
    assert len(bases) <= 2 and len(epochs) <= 2 * pipelines.FOLD_EPOCHS
    got = read_throughput_table(spark, scratch)
    assert len(got.inputFiles()) <= 1 + pipelines.FOLD_EPOCHS
    assert {r.window_start_unix * 1000: r.n_msgs for r in got.collect()} == want
    assert spark.read.parquet(f"{scratch}/base={bases[-1]}").count() == 7  # one row per window


def test_observer_folds_while_it_runs(spark, scratch, monkeypatch):
    monkeypatch.setattr(pipelines, "FOLD_EPOCHS", 2)
    inbox, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    frames = spark.range(90).select(F.lit(None).cast("binary").alias("key"), F.lit(b"x").alias("value"), F.lit("t").alias("topic"),
                                    F.timestamp_seconds(F.col("id") * 10).alias("timestamp"))
    write_frames(frames.repartition(9), "files", inbox)
    for _ in range(2):  # the second start finds nothing new
        run_to_completion(start_throughput_table(read_frames(spark, "files", inbox, stream=True, files_per_trigger=1), out, out + "-ck", 60))
        assert {r.window_start_unix: r.n_msgs for r in read_throughput_table(spark, out).collect()} == {60_000 * k: 6 for k in range(15)}
    assert len(list_versions(spark, out, "base=")) == 2 and len(list_versions(spark, out, "epoch=")) <= 4


def test_corrupt_frame_between_restarts(spark, scratch):
    """The query dies at the corrupt frame, again after a restart, and goes on once told to skip; nothing comes twice."""
    inbox, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    readings = lineitem_readings(spark, SF001)
    parts = [readings.filter(F.col("estacao").startswith(x)) for x in "ANR"]

    def run(mode="failfast"):
        run_to_completion(start_clean_stream(read_frames(spark, "files", inbox, stream=True), out, out + "-ck", mode=mode))

    write_frames(load_frames(parts[0]), "files", inbox)
    run()
    bad = spark.createDataFrame([(bytearray(b"\xff\xff"),), (None,)], "value binary").select(F.lit(None).cast("binary").alias("key"), "value", F.lit("t").alias("topic"))
    write_frames(load_frames(parts[1]).unionByName(bad), "files", inbox)
    for _ in range(2):
        with pytest.raises(Exception):
            run()
    done = decode(read_frames(spark, "files", out), keep=["partition"])
    assert rows_of(done) == rows_of(decode(clean_job(load_frames(parts[0])), keep=["partition"]))  # none of the failed epoch
    write_frames(load_frames(parts[2]), "files", inbox)
    run("permissive")
    run()  # nothing is left
    got = decode(read_frames(spark, "files", out), keep=["partition"])
    assert rows_of(got) == rows_of(decode(clean_job(load_frames(readings)), keep=["partition"]))


def loads(df):
    """Rows by (task, partition)."""
    return {(r.t, r.partition): r.n for r in df.withColumn("t", F.spark_partition_id()).groupBy("t", "partition").agg(F.count("*").alias("n")).collect()}


def test_hot_station_is_spread_over_tasks(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 4).otherwise((F.col("id") % 11).cast("int")).alias("partition"))
    for tasks in (16, 40, 5):
        by = loads(place_balanced(df, tasks))
        assert sum(by.values()) == 20_000 and len({t for t, _ in by}) == len(by)  # no task has two partitions
        assert max(by.values()) <= 2 * median(by.values())
    assert len([1 for (_, p) in loads(place_balanced(df, 16)) if p == 4]) >= 8


def test_placement_of_odd_tables(spark):
    schema = "id long, partition int"
    assert place_balanced(spark.createDataFrame([], schema), 4).count() == 0
    rows = [(1, None), (2, None), (3, 0), (None, 0), (3, 0)]
    by = loads(place_balanced(spark.createDataFrame(rows, schema), 4))
    assert sum(by.values()) == 5 and {p for _, p in by} == {None, 0}
    # dealt by a hash of the row: a task that is run again deals the same
    df = spark.range(5000).select("id", F.lit(1).alias("partition"))
    one, two = (place_balanced(df.repartition(n), 8).withColumn("t", F.spark_partition_id()) for n in (3, 5))
    assert rows_of(one) == rows_of(two)


def test_files_of_a_hot_station(spark, scratch):
    hot = lineitem_readings(spark, SF001).withColumn("codnum", F.when(F.col("rs") <= 25, 3).otherwise(F.col("codnum")))
    frames = clean_job(load_frames(hot))
    write_frames(frames, "files", scratch, balanced=True, num_tasks=16)
    per_file = read_frames(spark, "files", scratch).groupBy(F.input_file_name().alias("f"), "partition").count().collect()
    assert sum(r.partition == 2 for r in per_file) >= 7
    assert max(r["count"] for r in per_file) <= 2 * median(r["count"] for r in per_file)
    assert rows_of(decode(read_frames(spark, "files", scratch), keep=["partition"])) == rows_of(decode(frames, keep=["partition"]))
