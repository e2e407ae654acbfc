"""DuckDB SQL equivalents of the registered queries (the correctness gate).

Written independently of the Spark plans: plain windows (``lag``, running
sums) where Spark uses the skew-safe partitioned forms, a schedule table plus a
range join where Spark uses the closed-form ramp, and a size formula for the
payload encoder.
"""

from __future__ import annotations

import math

from brisa.operators.codec import payload_size_sql
from brisa.operators.replay import FIXED_RATE, STRESS_EVERY_SECONDS, STRESS_START_RATE, STRESS_STEP
from brisa.plans import catalog as C

_READINGS = """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS objectid, CAST(l_shipdate AS VARCHAR) AS data,
       CAST(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0 WHEN l_linenumber = 5 THEN -5 ELSE l_linenumber END AS INTEGER) AS codnum,
       l_returnflag || l_linestatus AS estacao, l_discount AS chuva, l_tax AS pres, l_quantity AS rs, l_extendedprice AS temp,
       l_quantity - 25 AS ur, CASE WHEN l_tax = 0 THEN CAST('-0.0' AS DOUBLE) ELSE l_tax END AS dir_vento,
       CASE WHEN l_discount <> CAST(0.05 AS DOUBLE) THEN l_discount END AS vel_vento,
       CAST(l_linenumber - 1 AS DOUBLE) AS so2, CAST(l_linenumber - 4 AS DOUBLE) AS no2,
       CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE l_quantity END AS hcnm,
       CASE WHEN l_linestatus = 'F' THEN l_discount END AS hct, -l_tax AS ch4,
       CASE WHEN l_tax <> CAST(0.08 AS DOUBLE) THEN l_tax END AS co, l_quantity - 1 AS no,
       CASE WHEN l_returnflag = 'A' THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS nox,
       CASE WHEN l_tax = 0 THEN l_discount ELSE l_quantity END AS o3, CAST(l_suppkey AS DOUBLE) - 1 AS pm10, -l_discount AS pm2_5,
       l_discount AS lat, -l_tax AS lon,
       CASE WHEN l_discount = 0 THEN CAST('-0.0' AS DOUBLE) ELSE l_extendedprice END AS x_utm_sirgas2000,
       CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey AS DOUBLE) END AS y_utm_sirgas2000
FROM lineitem"""

# a zero of one of the 18 measurements is a fault; ids, station and coordinates keep theirs
_ZEROED = ("chuva", "pres", "rs", "temp", "ur", "dir_vento", "vel_vento", "so2", "no2", "hcnm", "hct", "ch4", "co", "no", "nox", "o3", "pm10", "pm2_5")


def _cleaned(readings: str) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {c} <> 0 THEN {c} END AS {c}" for c in _ZEROED) + f") FROM ({readings})"


_CLEANED = _cleaned(_READINGS)
_COLUMNS = ("objectid", "data", "codnum", "estacao", *_ZEROED, "lat", "lon", "x_utm_sirgas2000", "y_utm_sirgas2000")
_TEXT_HEADER = (*_COLUMNS[:-2], "x_utm", "y_utm")


def _event_readings(where: str = "true") -> str:
    absent = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in _COLUMNS[5:])
    return (f"SELECT event_id AS objectid, CAST(ts AS VARCHAR) AS data, CAST(user_id AS INTEGER) AS codnum, event_type AS estacao, "
            f"value AS chuva, {absent} FROM events WHERE {where}")


_PART = "CAST(greatest(coalesce(codnum, 1), 1) - 1 AS INTEGER)"


def _dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _screen_sql(source_where: str = "") -> str:
    w_us = C.SCREEN_WINDOW_S * 1_000_000
    rate = f"{_dbl('count(*)')} * {_dbl(C.SCREEN_UNIT_S)} / {_dbl(C.SCREEN_WINDOW_S)}"
    where = f"WHERE {source_where}" if source_where else ""
    return (f"SELECT CAST((epoch_us(ts) // {w_us}) * {w_us // 1000} AS BIGINT) AS window_start_unix, "
            f"count(*) AS n_msgs, CAST(round({rate}) AS BIGINT) AS throughput_msgs_sec "
            f"FROM events {where} GROUP BY 1")


def _lag_sql(events: str) -> str:
    return ("SELECT user_id AS entity, ts, event_id, event_type AS to_state, "
            "lag(event_type) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS from_state "
            f"FROM {events}")


def _event_patterns(events: str = "events") -> dict[str, str]:
    """E1-E3 over ``events`` (user_id, ts, event_id, event_type)."""
    return {
        "state_transition": (
            f"SELECT entity, ts, event_id, from_state, to_state FROM ({_lag_sql(events)}) "
            "WHERE from_state IS NOT NULL AND from_state <> to_state AND from_state = 'view'"),
        "leave_state": (
            f"SELECT entity, ts, event_id, from_state, to_state FROM ({_lag_sql(events)}) "
            "WHERE (from_state = 'signup' AND to_state <> 'signup') "
            "OR (from_state = 'error' AND to_state <> 'error')"),
        "hold_interval": (
            "WITH p AS (SELECT user_id AS entity, ts, event_id, "
            "lag(ts) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS pts "
            f"FROM {events}), "
            "s AS (SELECT *, sum(CASE WHEN pts IS NULL OR epoch_us(ts) - epoch_us(pts) >= "
            f"{C.HOLD_S * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts NULLS FIRST, event_id NULLS FIRST "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM p) "
            f"SELECT entity, min(ts) AS hold_start, max(ts) + INTERVAL {C.HOLD_S} SECOND AS hold_end, "
            "count(*) AS n_events FROM s GROUP BY entity, sid"),
        "hold_onoff": (
            "WITH s AS (SELECT user_id AS entity, ts, event_id, CASE WHEN event_type IN "
            f"({', '.join(repr(t) for t in C.ACTIVE_TYPES)}) THEN 'on' ELSE 'off' END AS state "
            f"FROM {events}), "
            "l AS (SELECT *, lag(state) OVER (PARTITION BY entity ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS prev FROM s), "
            "t AS (SELECT entity, ts, event_id, CASE WHEN prev = 'off' AND state = 'on' THEN 'start' "
            "WHEN prev = 'on' AND state = 'off' THEN 'stop' END AS kind FROM l), "
            "f AS (SELECT *, lag(kind) OVER (PARTITION BY entity ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS before FROM t WHERE kind IS NOT NULL), "
            "k AS (SELECT *, lag(kind) OVER (PARTITION BY entity ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS pk, "
            "lag(ts) OVER (PARTITION BY entity ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS pt FROM f "
            "WHERE NOT (kind = 'stop' AND before IS NOT DISTINCT FROM 'stop')), "
            "g AS (SELECT *, sum(CASE WHEN pk IS NULL OR (kind = 'start' AND pk = 'stop' AND "
            f"epoch_us(ts) - epoch_us(pt) >= {C.HOLD_S * 1_000_000}) THEN 1 ELSE 0 END) OVER (PARTITION BY entity "
            "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM k), "
            "a AS (SELECT entity, min(CASE WHEN kind = 'start' THEN ts END) AS hold_start, "
            "max(CASE WHEN kind = 'start' THEN ts END) AS last_on, max(CASE WHEN kind = 'stop' THEN ts END) AS last_off, "
            "count(CASE WHEN kind = 'start' THEN 1 END) AS n_triggers FROM g GROUP BY entity, sid) "
            f"SELECT entity, hold_start, CASE WHEN last_off >= last_on THEN last_off + INTERVAL {C.HOLD_S} SECOND END "
            "AS hold_end, n_triggers FROM a WHERE hold_start IS NOT NULL"),
    }


def _hot_streams() -> dict[str, str]:
    """The streams of E1-E3 give what the batch operators give on the same events."""
    hot = _event_patterns(f"(SELECT * REPLACE ({C.HOT_ENTITY} AS user_id) FROM events)")
    return {"stream_transition": hot["state_transition"], "stream_leave": hot["leave_state"],
            "stream_hold": hot["hold_interval"], "stream_hold_onoff": hot["hold_onoff"]}


def oracle_sql() -> dict[str, str]:
    blank = r"'^[\x00-\x20]*$'"
    log_w_us = C.LOG_WINDOW_S * 1_000_000
    log_rate = f"{_dbl('coalesce(c.n, 0)')} * {_dbl(C.LOG_UNIT_S)} / {_dbl(C.LOG_WINDOW_S)}"
    replay_passes = math.ceil(C.REPLAY_CYCLES)
    every = {
        "clean_zero_readings": _CLEANED,
        "presence_flags": (
            "SELECT objectid, " + ", ".join(f"({c} IS NOT NULL) AS has_{c}" for c in _COLUMNS[2:])
            + f" FROM ({_CLEANED})"),
        "blank_to_null": (
            "WITH c AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '   ' "
            "WHEN event_type = 'signup' THEN chr(9) WHEN event_type = 'view' THEN '' "
            "WHEN event_type = 'purchase' THEN ' ' || props || ' ' ELSE props END AS cell FROM events) "
            f"SELECT event_id, CASE WHEN cell IS NULL OR regexp_matches(cell, {blank}) THEN NULL "
            "ELSE cell END AS cell FROM c"),
        "typed_parse": (
            "SELECT event_id, CAST(event_id AS BIGINT) AS objectid, CAST(user_id AS INTEGER) AS codnum, "
            "CASE WHEN event_type = 'click' THEN NULL ELSE TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) END "
            "AS chuva FROM events"),
        "csv_scan": f"SELECT * REPLACE ({C.AWKWARD_STATION_SQL} AS estacao) FROM ({_READINGS})",
        "text_export": (
            "SELECT " + ", ".join(f"coalesce(replace(CAST({c} AS VARCHAR), 'nan', 'NaN'), '') AS {h}" for c, h in zip(_COLUMNS, _TEXT_HEADER))
            + f" FROM (SELECT * REPLACE (CASE WHEN rs = 1 THEN CAST('NaN' AS DOUBLE) ELSE o3 END AS o3) FROM ({_CLEANED}))"),
        "payload_roundtrip": _READINGS,
        "payload_size": (
            f"SELECT objectid, CAST({payload_size_sql()} AS INTEGER) AS payload_bytes FROM ({_READINGS})"),
        "skip_corrupt": _event_readings("event_type IS DISTINCT FROM 'error'"),
        "throughput_decoded": _screen_sql("event_type IS DISTINCT FROM 'error'"),
        "route_partition": f"SELECT objectid, codnum, {_PART} AS partition FROM ({_CLEANED})",
        "route_modulo": (
            f"SELECT objectid, CAST((greatest(coalesce(codnum * 5, 1), 1) - 1) % {C.ROUTE_MODULO_N} AS INTEGER) AS partition FROM ({_READINGS})"),
        "clean_pipeline": f"SELECT 'topic-clima-saida' AS topic, {_PART} AS partition, * FROM ({_CLEANED})",
        "throughput_log": (
            f"WITH c AS (SELECT epoch_us(ts) // {log_w_us} AS w, count(*) AS n FROM events GROUP BY 1), "
            "g AS (SELECT unnest(generate_series(min(w), max(w))) AS w FROM c) "
            f"SELECT CAST((g.w + 1) * {log_w_us // 1000} AS BIGINT) AS timestamp_unix, "
            f"CAST(trunc({log_rate}) AS INTEGER) AS throughput_msgs_sec FROM g LEFT JOIN c ON g.w = c.w"),
        "throughput_rounded": _screen_sql(),
        "replay_cycle": (
            "WITH idx AS (SELECT event_id, row_number() OVER (ORDER BY event_id NULLS FIRST) - 1 AS i, "
            "count(*) OVER () AS n FROM events), "
            f"cyc AS (SELECT range AS cycle FROM range(0, {replay_passes})) "
            f"SELECT cycle * n + i AS seq, cycle, event_id, (cycle * n + i) // {FIXED_RATE} AS emit_second "
            f"FROM idx, cyc WHERE cycle * n + i < CAST(floor(n * {C.REPLAY_CYCLES}) AS BIGINT)"),
        "rate_ramp": (
            "WITH idx AS (SELECT row_number() OVER (ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST)"
            " - 1 AS i, count(*) OVER () AS n FROM lineitem), "
            f"seqs AS (SELECT cycle * n + i AS seq FROM idx, (SELECT range AS cycle FROM range(0, {C.RAMP_CYCLES}))), "
            f"sched AS (SELECT range AS t, {STRESS_START_RATE} + {STRESS_STEP} * (range // {STRESS_EVERY_SECONDS}) "
            "AS rate FROM range(0, 200000)), "
            "cum AS (SELECT t, rate, sum(rate) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            " - rate AS start FROM sched) "
            "SELECT t AS emit_second, count(*) AS n_msgs FROM seqs JOIN cum "
            "ON seqs.seq >= cum.start AND seqs.seq < cum.start + cum.rate GROUP BY t"),
        "domain_filter": (
            "SELECT * FROM (SELECT concat_ws('.', event_type, 'user_' || CAST(user_id AS VARCHAR)) AS entity_id, "
            "ts, event_id FROM events) WHERE split_part(entity_id, '.', 1) IN ('view', 'click')"),
        **_event_patterns(),
        "stream_clean": f"SELECT 'topic-clima-saida' AS topic, {_PART} AS partition, * FROM ({_CLEANED})",
        "stream_loader": _READINGS,
        "stream_loader_skip": _event_readings("event_type IS DISTINCT FROM 'click'"),
        "route_balanced": f"SELECT objectid, codnum, {_PART} AS partition FROM (SELECT objectid, {C.HOT_STATION} AS codnum FROM ({_READINGS}))",
        "stream_restart": (
            "SELECT *, CAST((greatest(coalesce(codnum, 1), 1) - 1) % 12 AS INTEGER) AS partition FROM ("
            + _cleaned(_event_readings("event_type IS DISTINCT FROM 'error'")) + ")"),
        **_hot_streams(),
        "stream_replay": (
            "WITH idx AS (SELECT event_id, row_number() OVER (ORDER BY event_id NULLS FIRST) - 1 AS i, "
            "count(*) OVER () AS n FROM events), "
            f"seqs AS (SELECT cycle * n + i AS seq, cycle, event_id FROM idx, (SELECT range AS cycle FROM range(0, {replay_passes})) "
            f"WHERE cycle * n + i < CAST(floor(n * {C.REPLAY_CYCLES}) AS BIGINT)), "
            f"sched AS (SELECT range AS t, {STRESS_START_RATE} + {STRESS_STEP} * (range // {STRESS_EVERY_SECONDS}) "
            "AS rate FROM range(0, 200000)), "
            "cum AS (SELECT t, rate, sum(rate) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            " - rate AS start FROM sched) "
            "SELECT seq, cycle, event_id, t AS emit_second FROM seqs JOIN cum "
            "ON seqs.seq >= cum.start AND seqs.seq < cum.start + cum.rate"),
        "stream_throughput": _screen_sql(),
        "stream_decoded": _screen_sql("event_type IS DISTINCT FROM 'error'"),
        "stream_chain": _screen_sql(),
    }
    return every | {"stream_log": every["throughput_log"]}

