"""E1-E3 on streams: state per entity as versioned tables, joined to the skew-safe batch operators.

Each micro-batch is united with what earlier ones left of its entities (one last row, or the
open sessions) and run through :mod:`brisa.operators.ordered`, so an entity with a third of
the events is spread over tasks like in batch; no task holds an entity's rows.  The
results and the new state of an epoch are folders of that epoch: a query that fails or is
stopped anywhere goes on from its checkpoint and ends with the same rows.

Events of one micro-batch are taken in order of ``(ts, tiebreak)``, micro-batches in order of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brisa.operators import events as ev
from brisa.operators.ordered import (
    ActivityRule,
    OnOffRule,
    activity_events,
    merged_sessions,
    onoff_events,
    state_changes,
)
from brisa.operators.sequence import micros_of
from brisa.session import passing_scratch
from brisa.streaming.versions import Keyed, Versions


@dataclass(frozen=True)
class EventColumns:
    """The columns of an event stream."""
    entity: str
    ts: str
    state: str | None
    tiebreak: str


def _start(stream: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    def epoch_of(batch: DataFrame, epoch: int) -> None:
        with passing_scratch(batch.sparkSession):
            write(batch, epoch)

    writer = stream.writeStream.foreachBatch(epoch_of).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def _last_states(path: str, schema: T.StructType, c: EventColumns) -> Keyed:
    return Keyed(f"{path}/last", T.StructType([schema[x] for x in (c.entity, c.ts, c.tiebreak, c.state)]), key=c.entity)


def _changes(last: Keyed, batch: DataFrame, epoch: int, c: EventColumns, trigger: Column | None) -> DataFrame:
    """State changes of a micro-batch against the last state of its entities before ``epoch``, with ``_new`` (true)."""
    spark = batch.sparkSession
    touched = batch.select(F.col(c.entity).alias("_e")).distinct()
    known = last.before(spark, epoch)
    known = known.join(touched, known[c.entity].eqNullSafe(touched["_e"]), "left_semi")  # one row per entity
    rows = known.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)))
    return state_changes(rows, c.entity, ["_new", c.ts, c.tiebreak], c.state, trigger).filter("_new")


def _remember(last: Keyed, batch: DataFrame, epoch: int, c: EventColumns) -> None:
    """The newest row of every entity of the micro-batch (partial aggregation: a hot entity ships one row per task)."""
    newest = batch.groupBy(c.entity).agg(F.max_by(F.struct(c.ts, c.tiebreak, c.state), F.struct(c.ts, c.tiebreak)).alias("_r"))
    last.write(newest.select(c.entity, "_r.*"), epoch)


def _start_changes(stream: DataFrame, out_path: str, checkpoint: str, c: EventColumns, trigger: Column | None,
                   available_now: bool) -> StreamingQuery:
    last = _last_states(out_path, stream.schema, c)

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.select(c.entity, c.ts, c.tiebreak, c.state).persist()
        try:
            last.fold(batch.sparkSession, epoch)
            told = ev._told(_changes(last, batch, epoch, c, trigger), c.entity, c.ts, c.tiebreak, c.state)
            told.write.mode("overwrite").parquet(f"{out_path}/changes/epoch={int(epoch)}")
            _remember(last, batch, epoch, c)
        finally:
            batch.unpersist()

    return _start(stream, write, checkpoint, available_now)


def start_transitions(stream: DataFrame, out_path: str, checkpoint: str, entity: str, ts: str, state: str, tiebreak: str,
                      from_state: str | None = None, to_state: str | None = None, available_now: bool = True) -> StreamingQuery:
    """E1 on a stream: a row whenever an entity's state differs from the state it last reported.

    Read the rows with :func:`read_changes`; they equal :func:`brisa.operators.events.transitions` if the
    stream comes in time order.
    """
    return _start_changes(stream, out_path, checkpoint, EventColumns(entity, ts, state, tiebreak),
                          ev.transition_trigger(state, from_state, to_state), available_now)


def start_leave_state(stream: DataFrame, out_path: str, checkpoint: str, entity: str, ts: str, state: str, tiebreak: str, zone: str,
                      zone_is_home: bool = False, home_state: str = ev.HOME_STATE, available_now: bool = True) -> StreamingQuery:
    """E2 on a stream; read the rows with :func:`read_changes`."""
    return _start_changes(stream, out_path, checkpoint, EventColumns(entity, ts, state, tiebreak),
                          ev.leave_trigger(state, zone, zone_is_home, home_state), available_now)


def read_changes(spark: SparkSession, out_path: str) -> DataFrame:
    """entity, ts, tiebreak, from_state, to_state told so far."""
    return spark.read.option("basePath", f"{out_path}/changes").parquet(f"{out_path}/changes").drop("epoch")


# ------------------------------------------------------------------ hold intervals

def _watermark(clock: Versions, batch_latest: int | None, epoch: int, spark: SparkSession, delay: int) -> int | None:
    """The time that no event is awaited before any more: the latest one so far less the delay (microseconds)."""
    before = clock.before(spark, epoch).first()
    latest = max((x for x in (before and before["latest"], batch_latest) if x is not None), default=None)
    clock.write(spark.createDataFrame([(latest,)], "latest long").coalesce(1), epoch)
    return None if latest is None else latest - delay


def _advance(spark: SparkSession, out_path: str, epoch: int, rule, group: T.StructField, new: DataFrame, closed_at: Column,
             watermark: int | None) -> None:
    """Merge the open sessions with the partials of a micro-batch; what the watermark has passed is told, the rest stays open."""
    open_table = _open_sessions(out_path, group, rule)
    columns = [group.name, *rule.columns]
    rows = (open_table.before(spark, epoch).withColumns({"_new": F.lit(0), "_tie": F.lit(None).cast(new.schema["_tie"].dataType)})
            .unionByName(new.withColumn("_new", F.lit(1))))
    # open sessions come first only where the rule goes by order, not by time
    order = ["_new", "first", "_tie"] if isinstance(rule, OnOffRule) else ["first", "_new", "_tie"]
    sessions = merged_sessions(rows, group.name, order, rule).withColumn("_over", F.coalesce(closed_at <= F.lit(watermark), F.lit(False)))
    sessions = sessions.persist()
    try:
        sessions.filter("_over").select(*columns).write.mode("overwrite").parquet(f"{out_path}/closed/epoch={int(epoch)}")
        open_table.write(sessions.filter("not _over").select(*columns), epoch)
    finally:
        sessions.unpersist()
    open_table.forget(spark, epoch)


def _open_sessions(out_path: str, group: T.StructField, rule) -> Versions:
    return Versions(f"{out_path}/open", T.StructType([group, *(T.StructField(c, T.LongType()) for c in rule.columns)]))


def _read_sessions(spark: SparkSession, out_path: str, group: T.StructField, rule, include_open: bool) -> DataFrame:
    table = _open_sessions(out_path, group, rule)
    told = spark.read.schema(table.schema).parquet(f"{out_path}/closed").drop("epoch")
    return told.unionByName(table.newest(spark)) if include_open else told


def start_hold_intervals(stream: DataFrame, out_path: str, checkpoint: str, entity: str, ts: str, tiebreak: str,
                         hold_seconds: int = ev.DEFAULT_HOLD_SECONDS, delay_seconds: int = 0, available_now: bool = True) -> StreamingQuery:
    """E3 (activity events) on a stream.

    Sessions stay open until the latest event seen, less ``delay_seconds``, is ``hold_seconds`` past their
    last event; late events up to that delay extend or join them.  An event that comes later still is an
    interval of its own: no event is dropped.  Read the intervals with :func:`read_hold_intervals`.
    """
    gap, kind = ev.check_hold(hold_seconds), stream.schema[ts].dataType
    group, rule, clock = stream.schema[entity], ActivityRule(gap), Versions(f"{out_path}/clock", "latest long")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        events = activity_events(batch, entity, micros_of(F.col(ts), kind), tiebreak).persist()
        try:
            watermark = _watermark(clock, events.agg(F.max("last")).first()[0], epoch, spark, int(delay_seconds) * 1_000_000)
            _advance(spark, out_path, epoch, rule, group, events, F.col("last") + F.lit(gap), watermark)
        finally:
            events.unpersist()
        clock.forget(spark, epoch)

    return _start(stream, write, checkpoint, available_now)


def read_hold_intervals(spark: SparkSession, out_path: str, entity: T.StructField, ts_type: T.DataType,
                        hold_seconds: int = ev.DEFAULT_HOLD_SECONDS, include_open: bool = True) -> DataFrame:
    """Hold intervals told so far; with ``include_open`` also those that a new event could still extend."""
    gap = ev.check_hold(hold_seconds)
    return ev.held_activity(_read_sessions(spark, out_path, entity, ActivityRule(gap), include_open), entity.name, gap, ts_type)


def start_hold_onoff(stream: DataFrame, out_path: str, checkpoint: str, entity: str, ts: str, state: str, tiebreak: str,
                     hold_seconds: int = ev.DEFAULT_HOLD_SECONDS, delay_seconds: int = 0, on: str = "on", off: str = "off",
                     available_now: bool = True) -> StreamingQuery:
    """E3 (motion-light rule) on a stream: starts and stops against each entity's last state, merged into its open sessions.

    A session is told once it has stopped and the latest event seen, less ``delay_seconds``, is ``hold_seconds``
    past the stop.  Read the intervals with :func:`read_hold_onoff`.
    """
    gap, kind = ev.check_hold(hold_seconds), stream.schema[ts].dataType
    c, group, rule = EventColumns(entity, ts, state, tiebreak), stream.schema[entity], OnOffRule(gap)
    last, clock = _last_states(out_path, stream.schema, c), Versions(f"{out_path}/clock", "latest long")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.select(c.entity, c.ts, c.tiebreak, c.state).persist()
        try:
            last.fold(spark, epoch)
            latest = batch.agg(F.max(micros_of(F.col(ts), kind))).first()[0]
            watermark = _watermark(clock, latest, epoch, spark, int(delay_seconds) * 1_000_000)
            trig = _changes(last, batch, epoch, c, ev.onoff_trigger(state, on, off))
            new = onoff_events(trig, entity, micros_of(F.col(ts), kind), F.col(state) == F.lit(on), F.col(tiebreak).alias("_tie"))
            stopped = F.when(F.col("last_on") == 0, F.col("last") + F.lit(gap))
            _advance(spark, out_path, epoch, rule, group, new, stopped, watermark)
            _remember(last, batch, epoch, c)
        finally:
            batch.unpersist()
        clock.forget(spark, epoch)

    return _start(stream, write, checkpoint, available_now)


def read_hold_onoff(spark: SparkSession, out_path: str, entity: T.StructField, ts_type: T.DataType,
                    hold_seconds: int = ev.DEFAULT_HOLD_SECONDS, include_open: bool = True) -> DataFrame:
    """Hold intervals told so far; with ``include_open`` also those that still last (``hold_end`` null while on)."""
    gap = ev.check_hold(hold_seconds)
    return ev.held_onoff(_read_sessions(spark, out_path, entity, OnOffRule(gap), include_open), entity.name, gap, ts_type)
