"""K1/K2: streaming sinks; the loader stream and its policies."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brisa.operators.codec import decode
from brisa.operators.export import to_text_columns
from brisa.operators.parse import malformed_records, parse_readings
from brisa.plans.adapters import lineitem_readings
from brisa.plans.pipeline import clean_job, load_frames
from brisa.schema import READING_COLS, TEXT_SCHEMA
from brisa.sources.csv import csv_scan, write_export
from brisa.sources.kafka import CLEANER_SINK_PRESET, LOADER_SINK_PRESET, frame_sink, read_frames, sink_options, write_frames
from brisa.streaming.pipelines import run_to_completion, start_clean_stream, start_loader_stream, start_malformed_stream
from tests.conftest import SF001


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def started(monkeypatch):
    """What the writers were told, instead of running them."""
    told = []

    class Recorded(DataStreamWriter):
        def __init__(self, df):
            super().__init__(df)
            self.told = {"columns": df.columns, "options": {}}

        def format(self, source):
            self.told["format"] = source
            return super().format(source)

        def options(self, **options):
            self.told["options"] |= options
            return super().options(**options)

        def option(self, key, value):
            self.told["options"][key] = value
            return super().option(key, value)

        def partitionBy(self, *cols):
            self.told["partition_by"] = cols
            return super().partitionBy(*cols)

        def outputMode(self, mode):
            self.told["mode"] = mode
            return super().outputMode(mode)

        def trigger(self, **how):
            self.told["trigger"] = how
            return super().trigger(**how)

        def start(self, *args, **kwargs):
            told.append(self.told)

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataStreamWriter", Recorded)
    return told


def test_clean_stream_to_kafka(spark, scratch, started):
    write_frames(load_frames(lineitem_readings(spark, SF001)), "files", scratch)
    frames = read_frames(spark, "files", scratch, stream=True)
    start_clean_stream(frames, "broker:9092", "/chk", available_now=False, transport="kafka", num_partitions=12)
    told = started[0]
    assert told["format"] == "kafka" and told["mode"] == "append" and "partition_by" not in told
    assert told["options"] == {
        "kafka.bootstrap.servers": "broker:9092", "kafka.compression.type": "lz4", "kafka.buffer.memory": "67108864",
        "kafka.enable.idempotence": "false", "kafka.acks": "1", "kafka.batch.size": "65536", "kafka.linger.ms": "20",
        "checkpointLocation": "/chk"}
    # null key, explicit partition; the frame's own timestamp is no Kafka column
    assert told["columns"] == ["key", "value", "topic", "partition"] and told["trigger"] == {"processingTime": "1 second"}
    start_clean_stream(frames, "/out", "/chk")
    assert started[1]["format"] == "parquet" and started[1]["partition_by"] == ("partition",)
    assert started[1]["options"]["path"] == "/out" and started[1]["trigger"] == {"availableNow": True}


def test_loader_stream_to_kafka(spark, scratch, started):
    start_loader_stream(spark, scratch, "broker:9092", "/chk", transport="kafka")
    told = started[0]
    assert told["format"] == "kafka" and told["columns"] == ["key", "value", "topic"]  # no partition: the client spreads
    assert {k: v for k, v in told["options"].items() if k.startswith("kafka.")} == {
        "kafka.bootstrap.servers": "broker:9092", "kafka.compression.type": "snappy", "kafka.batch.size": "65536", "kafka.linger.ms": "10"}


def test_kafka_is_asked_for(spark, scratch):
    """The real writer reaches Spark's lookup of the connector (not bundled here)."""
    write_frames(load_frames(lineitem_readings(spark, SF001)), "files", scratch)
    with pytest.raises(Exception, match="(?i)kafka"):
        start_clean_stream(read_frames(spark, "files", scratch, stream=True), "b:1", os.path.join(scratch, "c"), transport="kafka")


def test_sink_checks_the_frames(spark):
    sink = frame_sink("kafka", "b:1", LOADER_SINK_PRESET)
    with pytest.raises(ValueError, match="value"):
        sink.shaped(spark.range(1).select(F.lit("t").alias("topic")))
    with pytest.raises(ValueError, match="topic"):
        sink.shaped(spark.range(1).select(F.lit(b"x").alias("value")))
    with pytest.raises(ValueError, match="partition"):
        sink.shaped(spark.range(1).select(F.lit(b"x").alias("value"), F.lit("t").alias("topic"), F.lit(1).cast("long").alias("partition")))
    topic = frame_sink("kafka", sink_options("b:1", CLEANER_SINK_PRESET, topic="t"))
    assert topic.shaped(spark.range(1).select(F.lit(b"x").alias("value"), "id")).columns == ["value"]
    with pytest.raises(ValueError):
        frame_sink("carrier pigeon", "x")


def test_loaded_then_cleaned(spark, scratch):
    """Loader stream and cleaning stream one after the other over files equal the batch job."""
    csv, topic, out = (os.path.join(scratch, n) for n in ("csv", "in", "out"))
    readings = lineitem_readings(spark, SF001)
    write_export(to_text_columns(readings), csv)
    run_to_completion(start_loader_stream(spark, csv, topic, topic + "-ck", stamp=True))
    run_to_completion(start_clean_stream(read_frames(spark, "files", topic, stream=True), out, out + "-ck"))
    got = read_frames(spark, "files", out)
    assert got.filter("timestamp is null").isEmpty()
    want = clean_job(load_frames(readings))
    assert rows(decode(got, keep=["partition"])) == rows(decode(want, keep=["partition"]))


def text_rows(spark, cells):
    return spark.createDataFrame([tuple(c.get(n) for n in READING_COLS) for c in cells], TEXT_SCHEMA)


CELLS = [{"objectid": "1", "data": "d", "temp": "1.5"}, {"objectid": "2", "data": "d", "temp": "hot"}, {"objectid": "x", "data": "d", "codnum": "7.5"},
         {"objectid": " ", "data": "", "chuva": "\t"}, {"objectid": "5", "data": "d", "temp": "NaN", "codnum": "99999999999"}]


def test_policies_for_malformed_records(spark, scratch):
    csv, bad = os.path.join(scratch, "csv"), os.path.join(scratch, "bad")
    write_export(text_rows(spark, CELLS).fillna(""), csv)
    loaded = {}
    for policy in ("null", "skip"):
        out = os.path.join(scratch, policy)
        q = start_loader_stream(spark, csv, out, out + "-ck", malformed=policy)
        run_to_completion(q)
        loaded[policy] = decode(read_frames(spark, "files", out)).orderBy("objectid").collect()
        if policy == "skip":
            seen = [p.observedMetrics["load"] for p in q.recentProgress if "load" in p.observedMetrics]
            assert (sum(m["received"] for m in seen), sum(m["malformed"] for m in seen)) == (5, 3)
    assert [r.objectid for r in loaded["skip"]] == [0, 1]
    assert [r.objectid for r in loaded["null"]] == [0, 0, 1, 2, 5]
    run_to_completion(start_malformed_stream(spark, csv, bad, bad + "-ck"))
    kept = {r.objectid: r.bad_cells for r in spark.read.parquet(bad).collect()}
    assert kept == {"2": ["temp"], "x": ["objectid", "codnum"], "5": ["codnum"]}
    failing = start_loader_stream(spark, csv, os.path.join(scratch, "f"), os.path.join(scratch, "fc"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot parse"):
        run_to_completion(failing)
    with pytest.raises(ValueError):
        start_loader_stream(spark, csv, bad, bad + "-ck", malformed="guess")


def test_late_file_is_loaded_once(spark, scratch):
    csv, out = os.path.join(scratch, "csv"), os.path.join(scratch, "topic")
    for part in (CELLS[:1], CELLS[3:4], []):
        if part:
            write_export(text_rows(spark, part).fillna(""), csv, mode="append")
        run_to_completion(start_loader_stream(spark, csv, out, out + "-ck"))  # a new query on the old checkpoint
    assert sorted(r.objectid for r in decode(read_frames(spark, "files", out)).collect()) == [0, 1]


def test_strict_integers_are_malformed_when_padded(spark):
    df = text_rows(spark, [{"objectid": " 5", "data": "d"}, {"objectid": "5", "data": "d"}])
    assert malformed_records(df).isEmpty()
    assert [r.objectid for r in malformed_records(df, strict_integers=True).collect()] == [" 5"]


# ------------------------------------------------------------------ dialects and records over several lines

HEADER = ",".join(READING_COLS)


def written(scratch, *records):
    path = os.path.join(scratch, "cells.csv")
    with open(path, "w") as f:
        f.write("\n".join([HEADER, *records]) + "\n")
    return path


def test_quoted_line_breaks(spark, scratch):
    path = written(scratch, '1,"d\nline ""two"", x",3', '2,plain,4')
    got = {r.objectid: (r.data, r.codnum) for r in parse_readings(csv_scan(spark, path, multiline=True)).collect()}
    assert got == {1: ('d\nline "two", x', 3), 2: ("plain", 4)}
    with pytest.raises(Exception, match="does not end on its line"):
        csv_scan(spark, path).collect()


def test_cut_last_cell_fails_too(spark, scratch):
    cells = ["1"] + ["2"] * 24 + ['"1\n5"']
    with pytest.raises(Exception, match="does not end on its line"):
        csv_scan(spark, written(scratch, ",".join(cells))).collect()


def test_backslash_dialect(spark, scratch):
    path = written(scratch, r'1,"say \"hi\", you",3', r'2,"c:\\tmp",4', r'3,"q\"",5', "4")
    got = {r.objectid: (r.data, r.codnum) for r in parse_readings(csv_scan(spark, path, dialect="backslash")).collect()}
    assert got == {1: ('say "hi", you', 3), 2: ("c:\\tmp", 4), 3: ('q"', 5), 4: ("", None)}
    path = written(scratch, '1,"a \\" b\nc",3')
    got = csv_scan(spark, path, dialect="backslash", multiline=True).first()
    assert (got.data, got.codnum) == ('a " b\nc', "3")
    with pytest.raises(Exception, match="does not end on its line"):
        csv_scan(spark, path, dialect="backslash").collect()
    with pytest.raises(ValueError):
        csv_scan(spark, path, dialect="martian")


def test_short_and_long_records_still_pass(spark, scratch):
    path = written(scratch, '1,"a ""b""",3', ",".join(["7"] * 28), "3")
    assert sorted(r.objectid for r in csv_scan(spark, path).collect()) == ["1", "3", "7"]


def test_files_of_a_multiline_scan_are_bounded(spark, scratch, monkeypatch):
    """One task reads a file whole, so a task's rows must not grow with the table."""
    from brisa.plans import catalog
    from tests.conftest import SF001

    monkeypatch.setattr(catalog, "SCAN_RECORDS", 500)
    got = catalog.q_csv_scan(spark, SF001)
    assert len(got.inputFiles()) >= got.count() / 500
    want = catalog.lineitem_readings(spark, SF001).withColumn("estacao", F.expr(catalog.AWKWARD_STATION))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
