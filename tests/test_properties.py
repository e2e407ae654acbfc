"""Property tests: closed forms and skew-safe operators against brute force."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brisa.operators import events as ev
from brisa.operators.replay import with_ramp_second

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _simulate(n, a, d, k):
    out, t = [], 0
    while len(out) < n:
        out.extend([t] * min(a + d * (t // k), n - len(out)))
        t += 1
    return out


@SETTINGS
@given(a=st.integers(1, 60), d=st.integers(0, 30), k=st.integers(1, 6), n=st.integers(1, 3000))
def test_ramp_closed_form(spark, a, d, k, n):
    df = spark.range(n).withColumnRenamed("id", "seq")
    got = [r.t for r in with_ramp_second(df, "seq", "t", a, d, k).orderBy("seq").collect()]
    assert got == _simulate(n, a, d, k)


events = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]),
                            st.integers(0, 500), st.sampled_from(["on", "off", "x", None])),
                  min_size=1, max_size=300)


@SETTINGS
@given(rows=events, parts=st.integers(1, 12), gap=st.integers(0, 60))
def test_transitions_and_holds_match_pandas(spark, rows, parts, gap):
    data = [(e, T0 + dt.timedelta(seconds=s), i, v) for i, (e, s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "entity string, ts timestamp_ntz, id long, state string")
    pdf = pd.DataFrame(data, columns=["entity", "ts", "id", "state"])
    pdf["g"] = pdf["entity"].fillna("\0null")  # SQL groups null keys together
    pdf = pdf.sort_values(["g", "ts", "id"])
    pdf["prev"] = pdf.groupby("g")["state"].shift()
    # SQL semantics: a change from or to null is not a transition
    exp = sorted(pdf[pdf.prev.notna() & pdf.state.notna() & (pdf.prev != pdf.state)][["id", "prev", "state"]]
                 .itertuples(index=False, name=None))
    got = sorted((r.id, r.from_state, r.to_state) for r in
                 ev.transitions(df, "entity", "ts", "state", "id", num_partitions=parts).collect())
    assert got == exp

    pdf["pts"] = pdf.groupby("g")["ts"].shift()
    pdf["new"] = pdf.pts.isna() | ((pdf.ts - pdf.pts) >= dt.timedelta(seconds=gap))
    pdf["sid"] = pdf.groupby("g")["new"].cumsum()
    agg = pdf.groupby(["g", "sid"]).agg(s=("ts", "min"), n=("id", "count")).reset_index()
    exp_h = sorted((s.to_pydatetime(), n) for s, n in zip(agg.s, agg.n))
    got_h = sorted((r.hold_start, r.n_events) for r in
                   ev.hold_intervals(df, "entity", "ts", "id", gap, num_partitions=parts).collect())
    assert got_h == exp_h


def _reading_strategy():
    from brisa.schema import READING_FIELDS

    def field(name, dtype, optional):
        t = dtype.simpleString()
        if t == "bigint":
            base = st.integers(-(2**63), 2**63 - 1)
        elif t == "int":
            base = st.integers(-(2**31), 2**31 - 1)
        elif t == "double":
            base = st.floats(allow_nan=True, allow_infinity=True)
        else:
            base = st.text(max_size=40)
        return st.one_of(st.none(), base) if optional else base

    return st.fixed_dictionaries({n: field(n, t, o) for n, t, o in READING_FIELDS})


@SETTINGS
@given(rows=st.lists(_reading_strategy(), min_size=1, max_size=25))
def test_codec_round_trip_and_size(spark, rows):
    import math

    import duckdb
    import pyarrow as pa

    from brisa.operators.codec import decode, encode, payload_size_sql
    from brisa.schema import READING_SCHEMA

    rows = [dict(r, objectid=i if r["objectid"] is None else r["objectid"]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, READING_SCHEMA)
    enc = encode(df, keep=["objectid"], engine="arrow").selectExpr("objectid AS k", "value")
    back = decode(enc, keep=["k"], engine="arrow").collect()

    names = READING_SCHEMA.fieldNames()

    def norm(d):  # a tuple in schema order; NaN made comparable
        return tuple("nan" if isinstance(d[k], float) and math.isnan(d[k]) else d[k] for k in names)

    want = sorted((norm(r) for r in rows), key=repr)
    got = sorted((norm(r.asDict()) for r in back), key=repr)
    assert got == want

    types = {"objectid": pa.int64(), "codnum": pa.int32(), "data": pa.string(), "estacao": pa.string()}
    tbl = pa.table({f.name: pa.array([r[f.name] for r in rows], types.get(f.name, pa.float64()))  # noqa: F841
                    for f in READING_SCHEMA.fields})
    sizes = sorted(x[0] for x in duckdb.sql(f"SELECT {payload_size_sql()} FROM tbl").fetchall())
    assert sorted(r.n for r in enc.selectExpr("octet_length(value) AS n").collect()) == sizes


@SETTINGS
@given(rows=events, parts=st.integers(1, 12), gap=st.integers(0, 60))
def test_onoff_rule_matches_sql(spark, rows, parts, gap):
    import duckdb
    import pyarrow as pa

    data = [(e, T0 + dt.timedelta(seconds=s), i, v) for i, (e, s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "entity string, ts timestamp_ntz, id long, state string")
    got = sorted((r.entity or "", r.hold_start, r.hold_end, r.n_triggers) for r in
                 ev.hold_intervals_onoff(df, "entity", "ts", "state", "id", gap, num_partitions=parts).collect())
    t = pa.table({"entity": [d[0] for d in data], "ts": [d[1] for d in data],  # noqa: F841
                  "id": [d[2] for d in data], "state": [d[3] for d in data]})
    sql = f"""
    WITH l AS (SELECT *, lag(state) OVER w AS prev FROM t
               WINDOW w AS (PARTITION BY entity ORDER BY ts NULLS FIRST, id NULLS FIRST)),
    k AS (SELECT entity, ts, id, CASE WHEN prev = 'off' AND state = 'on' THEN 'start'
                                      WHEN prev = 'on' AND state = 'off' THEN 'stop' END AS kind FROM l),
    f AS (SELECT *, lag(kind) OVER w AS before FROM k WHERE kind IS NOT NULL
          WINDOW w AS (PARTITION BY entity ORDER BY ts NULLS FIRST, id NULLS FIRST)),
    p AS (SELECT *, lag(kind) OVER w AS pk, lag(ts) OVER w AS pt FROM f
          WHERE NOT (kind = 'stop' AND before IS NOT DISTINCT FROM 'stop')  -- finds nothing to stop
          WINDOW w AS (PARTITION BY entity ORDER BY ts NULLS FIRST, id NULLS FIRST)),
    g AS (SELECT *, sum(CASE WHEN pk IS NULL OR (kind = 'start' AND pk = 'stop'
                                 AND epoch_us(ts) - epoch_us(pt) >= {gap * 1_000_000}) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY entity ORDER BY ts NULLS FIRST, id NULLS FIRST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM p),
    a AS (SELECT entity, min(CASE WHEN kind = 'start' THEN ts END) AS s,
                 max(CASE WHEN kind = 'start' THEN ts END) AS lon, max(CASE WHEN kind = 'stop' THEN ts END) AS loff,
                 count(CASE WHEN kind = 'start' THEN 1 END) AS n FROM g GROUP BY entity, sid)
    SELECT coalesce(entity, ''), s, CASE WHEN loff >= lon THEN loff + INTERVAL {gap} SECOND END, n
    FROM a WHERE s IS NOT NULL"""
    exp = sorted(tuple(r) for r in duckdb.sql(sql).fetchall())
    assert got == exp


@SETTINGS
@given(keys=st.sets(st.integers(-10**12, 10**12), min_size=0, max_size=400), parts=st.integers(1, 16),
       input_parts=st.integers(1, 6))
def test_sequence_is_the_rank(spark, keys, parts, input_parts):
    from brisa.operators.sequence import with_sequence

    df = spark.createDataFrame([(k,) for k in keys] or [], "k long").repartition(input_parts)
    got = sorted((r.k, r.i) for r in with_sequence(df, ["k"], "i", num_partitions=parts).collect())
    assert got == [(k, i) for i, k in enumerate(sorted(keys))]


@SETTINGS
@given(offsets=st.lists(st.integers(0, 5_000_000), min_size=1, max_size=200),
       window=st.sampled_from([1, 7, 10, 60]), unit=st.sampled_from([1, 3, 1000]))
def test_throughput_log_matches_reference(spark, offsets, window, unit):
    from collections import Counter

    from brisa.operators.throughput import throughput_log

    ts = [T0 + dt.timedelta(milliseconds=o) for o in offsets]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    epoch_ms = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    w_ms = window * 1000
    counts = Counter((epoch_ms + o) // w_ms for o in offsets)
    lo, hi = min(counts), max(counts)
    exp = sorted(((b + 1) * w_ms, int(float(counts.get(b, 0)) * float(unit) / float(window)))
                 for b in range(lo, hi + 1))
    got = sorted(tuple(r) for r in throughput_log(df, "ts", window, unit).collect())
    assert got == exp


@SETTINGS
@given(n=st.integers(0, 60), total=st.one_of(st.none(), st.integers(0, 300)), cycles=st.integers(1, 5),
       start=st.integers(0, 3), parts=st.integers(1, 7))
def test_replay_matches_loop(spark, n, total, cycles, start, parts):
    from brisa.operators.replay import replay

    df = spark.range(n).select((F.col("id") * 3).alias("x"))
    out = replay(df, ["x"], cycles=None if total is not None else cycles, total=total,
                 num_partitions=parts, start_cycle=start).collect()
    if n == 0:
        assert out == []
        return
    count = total if total is not None else cycles * n
    exp = sorted((start * n + j, start + j // n, (j % n) * 3) for j in range(count))
    assert sorted((r.seq, r.cycle, r.x) for r in out) == exp


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=events, gap=st.integers(0, 60))
def test_hold_stream_closed_sessions(spark, rows, gap, tmp_path_factory):
    from brisa.operators.sequence import ts_micros
    from brisa.streaming.pipelines import run_to_completion
    from brisa.streaming.state import hold_intervals_stream

    base = str(tmp_path_factory.mktemp("hstream"))
    data = [(e, T0 + dt.timedelta(seconds=s), i, v) for i, (e, s, v) in enumerate(rows)]
    schema = "entity string, ts timestamp_ntz, id long, state string"
    df = spark.createDataFrame(data, schema)
    df.write.parquet(base + "/in")
    stream = spark.readStream.schema(schema).parquet(base + "/in")
    q = (hold_intervals_stream(stream, "entity", "ts", gap, "1 second").writeStream.format("parquet")
         .option("path", base + "/out").option("checkpointLocation", base + "/ck")
         .outputMode("append").trigger(availableNow=True).start())
    run_to_completion(q)
    out = spark.read.schema("entity string, hold_start timestamp, hold_end timestamp, n_events long") \
        .parquet(base + "/out")
    streamed = sorted((r.entity or "", r.s, r.e, r.n) for r in out.selectExpr(
        "entity", "unix_micros(hold_start) AS s", "unix_micros(hold_end) AS e", "n_events AS n").collect())
    b = ev.hold_intervals(df, "entity", "ts", "id", gap)
    batch = sorted((r[0] or "", r[1], r[2], r[3]) for r in b.select(
        "entity", ts_micros(b, "hold_start"), ts_micros(b, "hold_end"), "n_events").collect())
    max_us = df.select(ts_micros(df, "ts").alias("u")).agg(F.max("u")).first()[0]
    closed = [r for r in batch if r[2] < max_us - 1_000_000]
    assert set(streamed) <= set(batch) and set(closed) <= set(streamed)
    assert len(streamed) == len(set(streamed)) or gap == 0
