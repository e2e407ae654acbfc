import os

from brisa.operators.export import to_text_columns
from brisa.operators.parse import parse_readings, parsed_date
from brisa.schema import EXPORT_HEADER, READING_SCHEMA
from brisa.sources.csv import csv_scan, write_export


def _rows():
    base = {f.name: None for f in READING_SCHEMA.fields}
    return [
        {**base, "objectid": 1, "data": "2020-01-02 03:04:05", "estacao": 'q"z, w', "chuva": 1e-5,
         "pres": 1e7, "temp": float("nan"), "ur": 0.1, "codnum": 4},
        {**base, "objectid": 0, "data": ""},
    ]


def test_text_columns_use_java_notation_and_empty_for_null(spark):
    df = spark.createDataFrame(_rows(), READING_SCHEMA)
    out = {r.objectid: r for r in to_text_columns(df).collect()}
    assert to_text_columns(df).columns == EXPORT_HEADER
    r = out["1"]
    assert (r.chuva, r.pres, r.temp, r.ur, r.codnum) == ("1.0E-5", "1.0E7", "NaN", "0.1", "4")
    assert r.rs == "" and r.x_utm == ""
    assert out["0"].data == "" and out["0"].estacao == ""


def test_csv_export_quotes_everything_and_round_trips(spark, scratch):
    df = spark.createDataFrame(_rows(), READING_SCHEMA)
    path = os.path.join(scratch, "export")
    write_export(to_text_columns(df), path)
    lines = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".csv"):
            with open(os.path.join(path, name)) as f:
                lines += f.read().splitlines()
    assert any('"q""z, w"' in ln for ln in lines)
    assert all(ln.startswith('"') for ln in lines)
    back = {r.objectid: r for r in parse_readings(csv_scan(spark, path)).collect()}
    assert back[1].estacao == 'q"z, w' and back[1].chuva == 1e-5 and back[1].pres == 1e7
    assert back[1].temp != back[1].temp  # NaN survives the text round trip
    assert back[0].data == "" and back[0].codnum is None


def test_parsed_date_is_optional_and_tolerant(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05",), ("not a date",)], "data string")
    out = [r.data_ts for r in parsed_date(df).collect()]
    assert out[0] is not None and out[1] is None


def test_csv_stream_equals_batch_scan(spark, scratch):
    from brisa.plans.adapters import lineitem_readings
    from brisa.sources.csv import csv_stream
    from brisa.streaming.pipelines import run_to_completion

    path = os.path.join(scratch, "csv_in")
    write_export(to_text_columns(lineitem_readings(spark, "/root/testdata/sf0.001")), path)
    out = os.path.join(scratch, "csv_out")
    q = (parse_readings(csv_stream(spark, path)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "_ck").trigger(availableNow=True).start())
    run_to_completion(q)
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select("objectid", "chuva", "data").collect())
    batch = sorted(tuple(r) for r in parse_readings(csv_scan(spark, path)).select("objectid", "chuva", "data").collect())
    assert streamed == batch and len(batch) == 6000


def test_log_sink_round_trip(spark, scratch):
    from brisa.operators.throughput import throughput_log
    from brisa.schema import LOG_HEADER, LOG_SCHEMA
    from brisa.sources.csv import write_log

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log = throughput_log(events, "ts", 3600, 3600)
    path = os.path.join(scratch, "log")
    write_log(log, path)
    back = spark.read.option("header", "true").schema(LOG_SCHEMA).csv(path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in log.collect())
    first = [ln for f in sorted(os.listdir(path)) if f.endswith(".csv")
             for ln in open(os.path.join(path, f)).read().splitlines()[:1]]
    assert first and first[0] == ",".join(LOG_HEADER)
