"""What the loader stream leaves on disk: text that is loaded goes, frames are small."""

import os

import pytest
from pyspark.sql import functions as F

from brisa.operators.codec import decode
from brisa.operators.export import to_text_columns
from brisa.plans import catalog
from brisa.schema import READING_FIELDS
from brisa.sources.csv import write_export
from brisa.sources.kafka import read_frames, write_frames
from brisa.streaming.pipelines import run_to_completion, start_loader_stream


def readings(spark, n):
    """Typed readings of which some columns are null in some rows."""
    own = {"objectid": F.col("id"), "data": F.format_string("2024-01-%02d", F.col("id") % 28 + 1), "estacao": F.when(F.col("id") % 3 == 0, "SO").when(F.col("id") % 3 == 1, "SF")}
    number = F.when(F.col("id") % 5 > 0, (F.col("id") * 37 % 1000) / 8)
    return spark.range(n).select(*[own.get(name, number).cast(kind).alias(name) for name, kind, _ in READING_FIELDS])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path, end):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(end))


def test_loaded_text_is_not_kept_beside_its_frames(spark, scratch, monkeypatch):
    made, found = [], []
    write, start = catalog.write_export, start_loader_stream
    monkeypatch.setattr(catalog, "LOAD_RECORDS", 50, raising=False)
    monkeypatch.setattr(catalog, "STREAM_FILES", 2)
    monkeypatch.setattr(catalog, "shared_path", lambda spark, name: os.path.join(scratch, name))

    def export(text, inbox, **how):
        before = set(files(inbox, ".csv"))
        write(text, inbox, **how)
        made.append(len(set(files(inbox, ".csv")) - before))

    def started(spark, inbox, *where, **how):
        query = start(spark, inbox, *where, **how)
        run_to_completion(query)
        found.append(len(files(inbox, ".csv")))
        return query

    monkeypatch.setattr(catalog, "write_export", export)
    monkeypatch.setattr("brisa.streaming.pipelines.start_loader_stream", started)
    df = readings(spark, 300).coalesce(1)
    got = catalog._load_in_two(spark, to_text_columns(df), F.col("estacao").endswith("O"), "load")
    assert rows(got) == rows(df)
    assert len(made) == 2 and min(made) > 2  # each start has several micro-batches
    assert max(found) <= 2  # the files of the last one


def test_a_file_that_fails_to_load_stays(spark, scratch):
    csv, out = os.path.join(scratch, "csv"), os.path.join(scratch, "topic")
    text = to_text_columns(readings(spark, 20))
    write_export(text.filter("objectid < 10"), csv, mode="append")
    run_to_completion(start_loader_stream(spark, csv, out, out + "-ck", files_per_trigger=1, drop_read=True))
    bad = text.filter("objectid >= 10").coalesce(1).withColumn("temp", F.when(F.col("objectid") == "15", "hot").otherwise(F.col("temp")))
    bad.write.mode("append").options(header="true", quoteAll="true").csv(csv)
    with pytest.raises(Exception):
        run_to_completion(start_loader_stream(spark, csv, out, out + "-ck", files_per_trigger=1, drop_read=True))
    run_to_completion(start_loader_stream(spark, csv, out, out + "-ck", files_per_trigger=1, drop_read=True, malformed="skip"))
    assert [r.objectid for r in decode(read_frames(spark, "files", out)).orderBy("objectid").collect()] == [i for i in range(20) if i != 15]


def test_text_stays_unless_it_is_told_to_go(spark, scratch):
    csv, out = os.path.join(scratch, "csv"), os.path.join(scratch, "topic")
    write_export(to_text_columns(readings(spark, 100)), csv, records_per_file=20)
    before = files(csv, ".csv")
    run_to_completion(start_loader_stream(spark, csv, out, out + "-ck", files_per_trigger=2))
    assert files(csv, ".csv") == before and len(before) > 4


def test_loaded_frames_are_smaller_than_by_default(spark, scratch):
    csv, out, plain = (os.path.join(scratch, n) for n in ("csv", "topic", "plain"))
    df = readings(spark, 20_000).coalesce(1)
    write_export(to_text_columns(df), csv)
    run_to_completion(start_loader_stream(spark, csv, out, out + "-ck"))
    frames = read_frames(spark, "files", out)
    write_frames(frames.select("key", "value", "topic"), "files", plain)
    size = {p: sum(map(os.path.getsize, files(p, ".parquet"))) for p in (out, plain)}
    assert 2 * size[out] < size[plain]
    assert rows(decode(frames)) == rows(df)
