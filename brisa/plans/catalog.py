"""Registered queries, one per operator family (oracles: ``plans/oracles.py``).

Every query reads whole driver tables (or data Spark derives from them) and
returns a DataFrame; none collects rows.  Column names match the oracle SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.operators import events as ev
from brisa.operators.clean import presence_flags, zero_to_null
from brisa.operators.codec import decode, encode
from brisa.operators.export import to_text_columns
from brisa.operators.parallelism import ensure_parallelism
from brisa.operators.parse import blank_to_null, parse_readings, typed_parse
from brisa.operators.replay import FIXED_RATE, fixed_rate_second, replay, with_ramp_second
from brisa.operators.route import route
from brisa.operators.sequence import as_instant
from brisa.operators.throughput import throughput_log, throughput_screen
from brisa.plans.adapters import events_readings, events_state, lineitem_readings
from brisa.plans.pipeline import OUT_PARTITIONS, clean_job, load_frames
from brisa.schema import FIELD_TYPES, OPTIONAL_COLS
from brisa.session import shared_path
from brisa.sources.csv import csv_scan, write_export
from brisa.sources.tables import table

# Query parameters (chosen so the sparse synthetic event times give non-trivial rates).
LOG_WINDOW_S, LOG_UNIT_S = 600, 1000         # 10-minute log windows, msgs per 1000 s
SCREEN_WINDOW_S, SCREEN_UNIT_S = 3600, 600   # 1-hour screen windows, msgs per 10 min
HOLD_S = 3600                                # hold delay (upper end of the allowed range)
ACTIVE_TYPES = ("view", "click")             # event types read as motion "on"
STREAM_STARTS = 3                            # starts of a stopped stream, one per slice of the events' time
# station names with a line break, quotes, a comma and a backslash (Spark's literals take escapes, DuckDB's do not)
AWKWARD_STATION = r"""CASE WHEN estacao LIKE 'R%' THEN concat(estacao, '\n"', data, '", \\') ELSE concat('"', estacao) END"""
AWKWARD_STATION_SQL = r"""CASE WHEN estacao LIKE 'R%' THEN estacao || chr(10) || '"' || data || '", ' || chr(92) ELSE '"' || estacao END"""
HOT_STATION = "CASE WHEN rs <= 25 THEN 3 ELSE codnum END"     # station 3 gets about half of the readings
HOT_ENTITY = "CASE WHEN value < 35 THEN -1 ELSE user_id END"  # one entity holds about half of the events
SCAN_RECORDS = 200_000                       # records of a file that one task has to read (about 60 MB)
LOAD_RECORDS = 1_000_000                     # records of a file of the loader stream (about 200 MB), STREAM_FILES of them in a micro-batch
STREAM_FILES = 8                             # unordered frame files, one per micro-batch
REPLAY_CYCLES = 2.5                          # replay passes over events
REPLAY_BATCH_S = 5                           # seconds of the schedule that one micro-batch sends
RAMP_CYCLES = 3                              # replay passes over lineitem for the ramp
ROUTE_MODULO_N = 4
CORRUPT_WHEN = "event_type = 'error'"        # these events travel as corrupt payloads
CORRUPT_PAYLOAD = bytes.fromhex("ffff")      # truncated varint tag: never decodable


# ----------------------------------------------------------------------------- readings

def q_clean_zero_readings(spark: SparkSession, sf: str) -> DataFrame:
    """C1 (flagship): faulty zero measurements become null, all else unchanged."""
    return zero_to_null(lineitem_readings(spark, sf))


def q_presence_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Presence of every optional field after cleaning."""
    return presence_flags(zero_to_null(lineitem_readings(spark, sf)), OPTIONAL_COLS, keep=["objectid"])


def _event_cells(spark: SparkSession, sf: str) -> DataFrame:
    # Raw text cells as a loader would see them: blanks of several kinds, padded
    # text (kept), and plain text.
    return table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("   "))
         .when(F.col("event_type") == "signup", F.lit("\t"))
         .when(F.col("event_type") == "view", F.lit(""))
         .when(F.col("event_type") == "purchase", F.concat(F.lit(" "), F.col("props"), F.lit(" ")))
         .otherwise(F.col("props")).alias("cell"))


def q_blank_to_null(spark: SparkSession, sf: str) -> DataFrame:
    """Blank / whitespace-only cells -> null; other text verbatim."""
    return blank_to_null(_event_cells(spark, sf), ["cell"])


def q_typed_parse(spark: SparkSession, sf: str) -> DataFrame:
    """P1 (tolerant mode): text -> bigint / int / double, bad numbers -> null."""
    text = table(spark, sf, "events").select(
        "event_id",
        F.col("event_id").cast("string").alias("objectid"),
        F.col("user_id").cast("string").alias("codnum"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("n/a-"), F.col("event_id").cast("string")))
         .otherwise(F.col("value").cast("string")).alias("chuva"))
    types = {n: FIELD_TYPES[n] for n in ("objectid", "codnum", "chuva")}
    return typed_parse(text, types, errors="null")


def q_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + P1/P2 + C5 + K3: readings exported as quoted CSV, scanned back by
    position (header dropped) and parsed strictly; station names hold line breaks, quotes,
    commas and backslashes."""
    path = shared_path(spark, "csv_scan")
    # spread before formatting: the text casts are the CPU-heavy part of the export
    readings = lineitem_readings(spark, sf).withColumn("estacao", F.expr(AWKWARD_STATION))
    write_export(to_text_columns(ensure_parallelism(readings)), path, records_per_file=SCAN_RECORDS)
    return parse_readings(csv_scan(spark, path, multiline=True), errors="fail")


def q_text_export(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned readings as 26 text columns under the export header."""
    readings = zero_to_null(lineitem_readings(spark, sf))
    return to_text_columns(readings.withColumn("o3", F.expr("CASE WHEN rs = 1 THEN double('NaN') ELSE o3 END")))


# ----------------------------------------------------------------------------- codec

def q_payload_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """P3+P4: encode then fail-fast decode gives back every reading, presence kept."""
    return decode(encode(lineitem_readings(spark, sf)), mode="failfast")


def q_payload_size(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded size per reading, checked against a size formula in SQL."""
    enc = encode(lineitem_readings(spark, sf), keep=["objectid"])
    return enc.select("objectid", F.octet_length("value").alias("payload_bytes"))


def _event_frames(spark: SparkSession, sf: str, keep: list[str] | None = None) -> DataFrame:
    """Frames of event readings; error events travel as corrupt payloads."""
    enc = encode(events_readings(spark, sf, keep=["ts", "event_type"]), keep=["ts", "event_type"])
    bad = F.expr(CORRUPT_WHEN)
    return enc.select(
        F.when(bad, F.lit(CORRUPT_PAYLOAD)).otherwise(F.col("value")).alias("value"),
        as_instant(enc, "ts").alias("timestamp"), *(keep or []))


def q_skip_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """P5/F1: tolerant decode drops undecodable payloads."""
    return decode(_event_frames(spark, sf), mode="permissive")


def q_throughput_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """A3: throughput of successfully decoded messages, by frame timestamp."""
    decoded = decode(_event_frames(spark, sf), mode="permissive", keep=["timestamp"])
    return throughput_screen(decoded, "timestamp", SCREEN_WINDOW_S, SCREEN_UNIT_S)


# ----------------------------------------------------------------------------- routing / job

def q_route_partition(spark: SparkSession, sf: str) -> DataFrame:
    """partition = max(0, coalesce(codnum, 1) - 1), checked against 12."""
    r = route(zero_to_null(lineitem_readings(spark, sf)), "codnum", OUT_PARTITIONS, "error")
    return r.select("objectid", "codnum", "partition")


def q_route_modulo(spark: SparkSession, sf: str) -> DataFrame:
    """Overflow by modulo."""
    stations = lineitem_readings(spark, sf).withColumn("codnum", F.col("codnum") * 5)  # up to 20, below 1, and absent
    r = route(stations, "codnum", ROUTE_MODULO_N, "modulo")
    return r.select("objectid", "partition")


def q_route_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """D1 with a station that holds half of the readings: frames written by tasks of equal size, read back."""
    from brisa.sources.kafka import read_frames, write_frames

    hot = lineitem_readings(spark, sf).withColumn("codnum", F.expr(HOT_STATION))
    path = shared_path(spark, "route_balanced")
    write_frames(clean_job(load_frames(hot)), "files", path, balanced=True)
    return decode(read_frames(spark, "files", path), mode="failfast", keep=["partition"]).select("objectid", "codnum", "partition")


def q_clean_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """T1 end to end (batch): frames -> decode -> clean -> route -> encode -> frames."""
    return _decoded_frames(clean_job(load_frames(lineitem_readings(spark, sf))))


def _decoded_frames(frames: DataFrame) -> DataFrame:
    """Topic, partition and the 26 fields of every frame."""
    return decode(frames, mode="failfast", keep=["topic", "partition"])


# ----------------------------------------------------------------------------- throughput

def q_throughput_log(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-filled windows, window end in ms, rate truncated."""
    return throughput_log(table(spark, sf, "events"), "ts", LOG_WINDOW_S, LOG_UNIT_S, zero_fill=True)


def q_throughput_rounded(spark: SparkSession, sf: str) -> DataFrame:
    """Non-empty windows, rate rounded half-up."""
    return throughput_screen(table(spark, sf, "events"), "ts", SCREEN_WINDOW_S, SCREEN_UNIT_S)


# ----------------------------------------------------------------------------- replay

def q_replay_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Events replayed in event_id order, 2.5 passes, at the fixed rate."""
    events = table(spark, sf, "events").select("event_id")
    total = math.floor(events.count() * REPLAY_CYCLES)
    out = replay(events, ["event_id"], total=total)
    return out.select("seq", "cycle", "event_id", fixed_rate_second("seq", FIXED_RATE).alias("emit_second"))


def q_stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """S4/L2 as a stream: events replayed 2.5 times under the stress ramp, stopped and resumed on the way."""
    from brisa.sources import replay_source as rs
    from brisa.streaming.pipelines import scratch

    stored = shared_path(spark, "replay_stored")
    n = rs.store_replayable(table(spark, sf, "events").select("event_id"), ["event_id"], stored)
    out, ckpt = scratch(spark, "stream_replay")
    for share in (0.5, 1.0):  # a first query that ends half-way, and one that goes on from its checkpoint
        schedule = rs.Schedule(total=math.floor(math.floor(n * REPLAY_CYCLES) * share))
        rs.run_until_sent(rs.start_replay(spark, stored, n, schedule, rs.to_folder(out), ckpt, seconds_per_batch=REPLAY_BATCH_S))
    return (spark.read.schema("event_id long, cycle long, seq long, emit_second long").parquet(out)
            .select("seq", "cycle", "event_id", "emit_second"))


def q_rate_ramp(spark: SparkSession, sf: str) -> DataFrame:
    """L2: lineitem replayed 3 times under the stress ramp; messages per second."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    seq = replay(li, ["l_orderkey", "l_linenumber"], cycles=RAMP_CYCLES)
    timed = with_ramp_second(seq, "seq", "emit_second")
    return timed.groupBy("emit_second").agg(F.count(F.lit(1)).alias("n_msgs"))


# ----------------------------------------------------------------------------- events

def q_domain_filter(spark: SparkSession, sf: str) -> DataFrame:
    """keep entities on the include list (domains here are event types)."""
    e = table(spark, sf, "events").select(
        F.concat_ws(".", "event_type", F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("entity_id"),
        "ts", "event_id")
    return ev.domain_filter(e, "entity_id", ("view", "click"))


def q_state_transition(spark: SparkSession, sf: str) -> DataFrame:
    """A user's event type changes away from 'view'."""
    return ev.transitions(events_state(spark, sf), "entity", "ts", "state", "event_id", from_state="view")


def q_leave_state(spark: SparkSession, sf: str) -> DataFrame:
    """Leaving 'error', with 'signup' playing the literal home state."""
    return ev.leave_state(events_state(spark, sf), "entity", "ts", "state", "event_id",
                          zone="error", zone_is_home=True, home_state="signup")


def q_hold_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Per-user activity intervals held for one hour after the last event."""
    return ev.hold_intervals(events_state(spark, sf), "entity", "ts", "event_id", HOLD_S)


def q_hold_onoff(spark: SparkSession, sf: str) -> DataFrame:
    """E3 (state form): views and clicks are 'on', other events 'off'; the light
    rule with a one-hour delay."""
    st = events_state(spark, sf).withColumn(
        "state", F.when(F.col("state").isin(*ACTIVE_TYPES), F.lit("on")).otherwise(F.lit("off")))
    return ev.hold_intervals_onoff(st, "entity", "ts", "state", "event_id", HOLD_S)


# ----------------------------------------------------------------------------- streaming

def q_stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaning job as a stream over frame files (availableNow)."""
    from brisa.sources.kafka import read_frames, write_frames
    from brisa.streaming.pipelines import run_to_completion, scratch, start_clean_stream

    inbox = shared_path(spark, "frames_in")
    write_frames(load_frames(lineitem_readings(spark, sf)), "files", inbox)
    out, ckpt = scratch(spark, "stream_clean")
    run_to_completion(start_clean_stream(read_frames(spark, "files", inbox, stream=True), out, ckpt))
    return _decoded_frames(read_frames(spark, "files", out))


def _load_in_two(spark: SparkSession, text: DataFrame, late, name: str, **load) -> DataFrame:
    """Readings in the topic after a loader stream took the files of ``text``, those where ``late`` holds
    written only after it had read the others.  Files that are loaded go, so text and frames of all readings
    are never on disk at once."""
    from brisa.sources.kafka import read_frames
    from brisa.streaming import pipelines as st

    inbox = shared_path(spark, f"{name}_csv")
    out, ckpt = st.scratch(spark, name)
    late = F.coalesce(late, F.lit(False))
    for part in (~late, late):
        write_export(text.filter(part), inbox, mode="append", records_per_file=LOAD_RECORDS)
        st.run_to_completion(st.start_loader_stream(spark, inbox, out, ckpt, files_per_trigger=STREAM_FILES, drop_read=True, **load))
    return decode(read_frames(spark, "files", out), mode="failfast")


def q_stream_loader(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files, some of them late, loaded as keyless frames by a stream."""
    return _load_in_two(spark, to_text_columns(lineitem_readings(spark, sf)), F.col("estacao").endswith("O"), "stream_loader")


def q_stream_loader_skip(spark: SparkSession, sf: str) -> DataFrame:
    """The loader stream under the skip policy: records with a bad cell (those of clicks) are dropped."""
    text = to_text_columns(events_readings(spark, sf)).withColumn(
        "chuva", F.when(F.col("estacao") == "click", F.lit("n/a")).otherwise(F.col("chuva")))
    return _load_in_two(spark, text, F.col("estacao") == "purchase", "stream_loader_skip", malformed="skip")


def _event_inbox(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """Stream over ``frames`` written as unordered files, one of them in each micro-batch."""
    from brisa.sources.kafka import read_frames, write_frames

    inbox = shared_path(spark, "frames_events")
    write_frames(frames.repartition(STREAM_FILES), "files", inbox)
    return read_frames(spark, "files", inbox, stream=True, files_per_trigger=1)


def _hot_state(spark: SparkSession, sf: str) -> DataFrame:
    """State changes of which one entity holds about half."""
    return table(spark, sf, "events").select(F.expr(HOT_ENTITY).alias("entity"), "ts", "event_id", F.col("event_type").alias("state"))


def _in_slices(spark: SparkSession, events: DataFrame, name: str, start) -> str:
    """Output folder of a stream that is stopped and started again for each slice of the time of ``events``."""
    from brisa.streaming import pipelines as st

    inbox = shared_path(spark, f"{name}_in")
    out, ckpt = st.scratch(spark, name)
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) / STREAM_STARTS if ends["lo"] is not None else None
    for k in range(STREAM_STARTS):
        part = events
        if step is not None and k:
            part = part.filter(F.col("ts") >= F.lit(ends["lo"] + k * step).cast("timestamp_ntz"))
        if step is not None and k + 1 < STREAM_STARTS:
            part = part.filter(F.col("ts") < F.lit(ends["lo"] + (k + 1) * step).cast("timestamp_ntz"))
        part.write.mode("append").parquet(inbox)
        st.run_to_completion(start(spark.readStream.schema(events.schema).parquet(inbox), out, ckpt))
    return out


def q_stream_transition(spark: SparkSession, sf: str) -> DataFrame:
    """E1 on a stream over restarts: a change away from 'view' against the last state of earlier micro-batches."""
    from brisa.streaming.keyed import read_changes, start_transitions

    out = _in_slices(spark, _hot_state(spark, sf), "stream_transition", lambda stream, out, ckpt: start_transitions(
        stream, out, ckpt, "entity", "ts", "state", "event_id", from_state="view"))
    return read_changes(spark, out)


def q_stream_leave(spark: SparkSession, sf: str) -> DataFrame:
    """E2 on a stream over restarts: leaving 'error', with 'signup' playing the literal home state."""
    from brisa.streaming.keyed import read_changes, start_leave_state

    out = _in_slices(spark, _hot_state(spark, sf), "stream_leave", lambda stream, out, ckpt: start_leave_state(
        stream, out, ckpt, "entity", "ts", "state", "event_id", zone="error", zone_is_home=True, home_state="signup"))
    return read_changes(spark, out)


def q_stream_hold(spark: SparkSession, sf: str) -> DataFrame:
    """E3 on a stream over restarts: activity intervals, merged from open session partials."""
    from brisa.streaming.keyed import read_hold_intervals, start_hold_intervals

    events = _hot_state(spark, sf)
    out = _in_slices(spark, events, "stream_hold", lambda stream, out, ckpt: start_hold_intervals(
        stream, out, ckpt, "entity", "ts", "event_id", HOLD_S))
    return read_hold_intervals(spark, out, events.schema["entity"], events.schema["ts"].dataType, HOLD_S)


def q_stream_hold_onoff(spark: SparkSession, sf: str) -> DataFrame:
    """E3 (state form) on a stream over restarts: the light rule with a one-hour delay."""
    from brisa.streaming.keyed import read_hold_onoff, start_hold_onoff

    events = _hot_state(spark, sf).withColumn("state", F.when(F.col("state").isin(*ACTIVE_TYPES), F.lit("on")).otherwise(F.lit("off")))
    out = _in_slices(spark, events, "stream_hold_onoff", lambda stream, out, ckpt: start_hold_onoff(
        stream, out, ckpt, "entity", "ts", "state", "event_id", HOLD_S))
    return read_hold_onoff(spark, out, events.schema["entity"], events.schema["ts"].dataType, HOLD_S)


def q_stream_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly throughput of what arrives, over several micro-batches."""
    from brisa.streaming import pipelines as st

    frames = load_frames(events_readings(spark, sf, keep=["ts"]), ts_col="ts")
    out, ckpt = st.scratch(spark, "stream_throughput")
    st.run_to_completion(st.start_throughput_table(_event_inbox(spark, frames), out, ckpt, SCREEN_WINDOW_S, SCREEN_UNIT_S))
    return st.read_throughput_table(spark, out).select("window_start_unix", "n_msgs", "throughput_msgs_sec")


def q_stream_log(spark: SparkSession, sf: str) -> DataFrame:
    """S3/A2/K4: the zero-filled log of a stream, written as text and read back."""
    from brisa.schema import LOG_SCHEMA
    from brisa.sources.csv import write_log
    from brisa.streaming import pipelines as st

    frames = load_frames(events_readings(spark, sf, keep=["ts"]), ts_col="ts")
    out, ckpt = st.scratch(spark, "stream_log")
    st.run_to_completion(st.start_throughput_log(_event_inbox(spark, frames), out, ckpt, LOG_WINDOW_S, LOG_UNIT_S))
    path = shared_path(spark, "throughput_log")
    write_log(st.read_throughput_log(spark, out, window_seconds=LOG_WINDOW_S), path)
    return spark.read.option("header", "true").schema(LOG_SCHEMA).csv(path)


def q_stream_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """S3/A3/P5: hourly throughput of the frames of a stream that decode."""
    from brisa.streaming import pipelines as st

    out, ckpt = st.scratch(spark, "stream_decoded")
    st.run_to_completion(st.start_decoded_rate(_event_inbox(spark, _event_frames(spark, sf)), out, ckpt,
                                               SCREEN_WINDOW_S, SCREEN_UNIT_S))
    return st.read_throughput_table(spark, out).select("window_start_unix", "n_msgs", "throughput_msgs_sec")


def q_stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaning stream fails on corrupt frames, is started again to skip them, and goes on from its
    checkpoint with what came since: every frame once, as in one run."""
    from brisa.sources.kafka import read_frames, write_frames
    from brisa.streaming import pipelines as st

    inbox = shared_path(spark, "frames_restart")
    out, ckpt = st.scratch(spark, "stream_restart")
    frames = _event_frames(spark, sf, keep=["event_type"])

    def clean(mode: str) -> None:
        stream = read_frames(spark, "files", inbox, stream=True)
        st.run_to_completion(st.start_clean_stream(stream, out, ckpt, overflow="modulo", mode=mode))

    for types, mode in ((("view", "click"), "failfast"), (("error",), "failfast"), (("signup", "purchase"), "permissive")):
        part = frames.filter(F.col("event_type").isin(*types)).drop("event_type")
        write_frames(part.select(F.lit(None).cast("binary").alias("key"), "value", F.lit("t").alias("topic"), "timestamp"), "files", inbox)
        try:
            clean(mode)
        except Exception:  # the corrupt frames, and only they, end the query
            if types != ("error",):
                raise
    return decode(read_frames(spark, "files", out), mode="failfast", keep=["partition"])


def q_stream_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Loader frames -> cleaning stream -> observer: hourly throughput of the cleaned topic."""
    from brisa.sources.kafka import read_frames
    from brisa.streaming import pipelines as st

    frames = load_frames(events_readings(spark, sf, keep=["ts"]), ts_col="ts")
    cleaned, ckpt = st.scratch(spark, "stream_chain_clean")
    st.run_to_completion(st.start_clean_stream(_event_inbox(spark, frames), cleaned, ckpt, overflow="modulo"))
    out, ckpt = st.scratch(spark, "stream_chain_counts")
    st.run_to_completion(st.start_throughput_table(read_frames(spark, "files", cleaned, stream=True), out, ckpt,
                                                   SCREEN_WINDOW_S, SCREEN_UNIT_S))
    return st.read_throughput_table(spark, out).select("window_start_unix", "n_msgs", "throughput_msgs_sec")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_zero_readings": q_clean_zero_readings,
    "presence_flags": q_presence_flags,
    "blank_to_null": q_blank_to_null,
    "typed_parse": q_typed_parse,
    "csv_scan": q_csv_scan,
    "text_export": q_text_export,
    "payload_roundtrip": q_payload_roundtrip,
    "payload_size": q_payload_size,
    "skip_corrupt": q_skip_corrupt,
    "throughput_decoded": q_throughput_decoded,
    "route_partition": q_route_partition,
    "route_modulo": q_route_modulo,
    "route_balanced": q_route_balanced,
    "clean_pipeline": q_clean_pipeline,
    "throughput_log": q_throughput_log,
    "throughput_rounded": q_throughput_rounded,
    "replay_cycle": q_replay_cycle,
    "rate_ramp": q_rate_ramp,
    "stream_replay": q_stream_replay,
    "domain_filter": q_domain_filter,
    "state_transition": q_state_transition,
    "leave_state": q_leave_state,
    "hold_interval": q_hold_interval,
    "hold_onoff": q_hold_onoff,
    "stream_clean": q_stream_clean,
    "stream_loader": q_stream_loader,
    "stream_loader_skip": q_stream_loader_skip,
    "stream_transition": q_stream_transition,
    "stream_leave": q_stream_leave,
    "stream_hold": q_stream_hold,
    "stream_hold_onoff": q_stream_hold_onoff,
    "stream_throughput": q_stream_throughput,
    "stream_log": q_stream_log,
    "stream_decoded": q_stream_decoded,
    "stream_chain": q_stream_chain,
    "stream_restart": q_stream_restart,
}
