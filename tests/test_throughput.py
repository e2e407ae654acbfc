import datetime as dt

from brisa.operators.throughput import throughput_log, throughput_screen

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _events(spark, counts, width=10):
    rows = []
    for w, n in enumerate(counts):
        for k in range(n):
            rows.append((T0 + dt.timedelta(seconds=w * width, milliseconds=k * 100),))
    return spark.createDataFrame(rows, "ts timestamp_ntz")


def test_log_truncates_and_zero_fills(spark):
    df = _events(spark, [9, 25, 0, 39])
    out = sorted((r.timestamp_unix, r.throughput_msgs_sec) for r in throughput_log(df, "ts", 10).collect())
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert out == [(base + 10000, 0), (base + 20000, 2), (base + 30000, 0), (base + 40000, 3)]


def test_screen_rounds_half_up_and_hides_empty(spark):
    df = _events(spark, [9, 25, 0, 39])
    out = sorted((r.n_msgs, r.throughput_msgs_sec) for r in throughput_screen(df, "ts", 10).collect())
    assert out == [(9, 1), (25, 3), (39, 4)]


def test_log_schema(spark):
    df = _events(spark, [1])
    assert [f.dataType.simpleString() for f in throughput_log(df, "ts", 10).schema.fields] == ["bigint", "int"]


def test_null_timestamps_belong_to_no_window(spark):
    from brisa.operators.throughput import window_counts

    df = spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts UNION ALL SELECT CAST(NULL AS timestamp)")
    assert [r.n_msgs for r in window_counts(df, "ts", 10).collect()] == [1]
