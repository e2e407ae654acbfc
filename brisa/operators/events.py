"""Operators over entity state-change events.

Events are ``(entity_id, ts, state)`` rows with a unique tiebreak column.  The
order-dependent ones run on :mod:`brisa.operators.ordered`, so an entity with a
huge share of the events is still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.operators.ordered import (
    ActivityRule,
    OnOffRule,
    activity_events,
    merged_sessions,
    onoff_events,
    state_changes,
    time_of,
)
from brisa.operators.sequence import micros_of

# --- fixed values: domains kept by the time-series store's include list ---
DEFAULT_DOMAINS = ("sensor", "switch")
# --- fixed values: hold delay default and allowed range, seconds ---
DEFAULT_HOLD_SECONDS = 120
HOLD_RANGE_SECONDS = (0, 3600)
# --- fixed values: the state a person has while in the home zone ---
HOME_STATE = "home"


def domain_of(entity_col: str = "entity_id") -> Column:
    """``sensor.kitchen`` -> ``sensor``."""
    return F.split_part(F.col(entity_col), F.lit("."), F.lit(1))


def domain_filter(df: DataFrame, entity_col: str = "entity_id",
                  domains: Sequence[str] = DEFAULT_DOMAINS) -> DataFrame:
    """keep entities whose domain (text before the first dot) is on the
    include list.

    Written as ``entity = d OR entity LIKE 'd.%'`` rather than ``split_part``:
    the same rows, but equality and prefix predicates reach the parquet scan
    (row groups whose entity range misses every domain are skipped).
    """
    e = F.col(entity_col)
    cond = None
    for d in domains:
        term = (e == F.lit(d)) | e.startswith(f"{d}.")
        cond = term if cond is None else cond | term
    return df.filter(cond if cond is not None else F.lit(False))


def transitions(df: DataFrame, entity: str, ts: str, state: str, tiebreak: str,
                from_state: str | None = None, to_state: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Rows where an entity's state differs from its previous state.

    Output: ``entity, ts, tiebreak, from_state, to_state``.  The first event of an
    entity has no previous state and never triggers; repeating a state does not.
    ``from_state`` / ``to_state`` narrow the trigger (e.g. ``off`` -> ``on``).
    """
    return _told(state_changes(df, entity, [ts, tiebreak], state, transition_trigger(state, from_state, to_state), num_partitions),
                 entity, ts, tiebreak, state)


def transition_trigger(state: str, from_state: str | None = None, to_state: str | None = None) -> Column:
    """E1's condition on ``<state>`` and ``prev_<state>``."""
    cond = F.lit(True)
    if from_state is not None:
        cond = cond & (F.col(f"prev_{state}") == F.lit(from_state))
    if to_state is not None:
        cond = cond & (F.col(state) == F.lit(to_state))
    return cond


def leave_trigger(state: str, zone: str, zone_is_home: bool = False, home_state: str = HOME_STATE) -> Column:
    """E2's condition on ``<state>`` and ``prev_<state>``."""
    p, c = F.col(f"prev_{state}"), F.col(state)
    cond = (p == F.lit(zone)) & (c != F.lit(zone))
    if zone_is_home:
        cond = ((p == F.lit(home_state)) & (c != F.lit(home_state))) | cond
    return cond


def _told(changes: DataFrame, entity: str, ts: str, tiebreak: str, state: str) -> DataFrame:
    return changes.select(entity, ts, tiebreak, F.col(f"prev_{state}").alias("from_state"), F.col(state).alias("to_state"))


def leave_state(df: DataFrame, entity: str, ts: str, state: str, tiebreak: str, zone: str,
                zone_is_home: bool = False, home_state: str = HOME_STATE,
                num_partitions: int | None = None) -> DataFrame:
    """The entity left ``zone``: previous == zone and current != zone.

    For the home zone the state literally reads ``home_state`` while inside, so
    leaving it also triggers.  Same output columns as :func:`transitions`.
    """
    return _told(state_changes(df, entity, [ts, tiebreak], state, leave_trigger(state, zone, zone_is_home, home_state), num_partitions),
                 entity, ts, tiebreak, state)


def check_hold(hold_seconds: int) -> int:
    """The hold delay in microseconds; it must be within the allowed range."""
    lo, hi = HOLD_RANGE_SECONDS
    if not lo <= hold_seconds <= hi:
        raise ValueError(f"hold_seconds must be within {HOLD_RANGE_SECONDS}")
    return int(hold_seconds) * 1_000_000


def hold_intervals(df: DataFrame, entity: str, ts: str, tiebreak: str,
                   hold_seconds: int = DEFAULT_HOLD_SECONDS,
                   num_partitions: int | None = None) -> DataFrame:
    """E3 (activity events): on until no activity for ``hold_seconds``; activity
    inside the delay restarts it.

    A new interval starts when the gap to the entity's previous event is at least
    ``hold_seconds`` (the ``session_window`` rule).  Output:
    ``entity, hold_start, hold_end, n_events`` with ``hold_end = last event +
    hold_seconds``.  Events without a time open no interval.  Every range of the
    events is reduced to one partial per interval before anything is written.
    """
    gap, kind = check_hold(hold_seconds), df.schema[ts].dataType
    events = activity_events(df, entity, micros_of(F.col(ts), kind), tiebreak)
    return held_activity(merged_sessions(events, entity, ["first", "_tie"], ActivityRule(gap), num_partitions), entity, gap, kind)


def held_activity(sessions: DataFrame, entity: str, gap: int, kind) -> DataFrame:
    """Session partials of activity events as hold intervals."""
    return sessions.select(entity, time_of(F.col("first"), kind).alias("hold_start"),
                           time_of(F.col("last") + F.lit(gap), kind).alias("hold_end"), F.col("n").alias("n_events"))


def hold_intervals_onoff(df: DataFrame, entity: str, ts: str, state: str, tiebreak: str,
                         hold_seconds: int = DEFAULT_HOLD_SECONDS, on: str = "on", off: str = "off",
                         num_partitions: int | None = None) -> DataFrame:
    """E3 (state events): the motion-light rule.

    The light goes on at an ``off -> on`` transition and goes off ``hold_seconds``
    after the next ``on -> off`` transition - unless a new ``off -> on`` comes
    within that delay, which restarts the wait.  Other transitions are ignored; a
    stop seen before any start (the light was not switched on by the rule) lights
    nothing, and a stop after a stop (states other than on and off lie between)
    has nothing to stop.  Output: ``entity, hold_start, hold_end, n_triggers`` (start triggers
    merged into the interval); ``hold_end`` is null while the light is still on at
    the end of the data.
    """
    gap, kind = check_hold(hold_seconds), df.schema[ts].dataType
    trig = state_changes(df, entity, [ts, tiebreak], state, onoff_trigger(state, on, off), num_partitions)
    events = onoff_events(trig, entity, micros_of(F.col(ts), kind), F.col(state) == F.lit(on), F.col(tiebreak).alias("_tie"))
    return held_onoff(merged_sessions(events, entity, ["first", "_tie"], OnOffRule(gap), num_partitions), entity, gap, kind)


def onoff_trigger(state: str, on: str = "on", off: str = "off") -> Column:
    """The starts (off -> on) and stops (on -> off) among the state changes."""
    p, c = F.col(f"prev_{state}"), F.col(state)
    return ((p == F.lit(off)) & (c == F.lit(on))) | ((p == F.lit(on)) & (c == F.lit(off)))


def held_onoff(sessions: DataFrame, entity: str, gap: int, kind) -> DataFrame:
    """Session partials of starts and stops as hold intervals; those without a start light nothing."""
    return sessions.filter("n > 0").select(
        entity, time_of(F.col("start"), kind).alias("hold_start"),
        F.when(F.col("last_on") == 0, time_of(F.col("last") + F.lit(gap), kind)).alias("hold_end"), F.col("n").alias("n_triggers"))
