"""One ordered pass over ranges: state changes and mergeable session partials.

Rows are range-partitioned on ``(entity, time, tiebreak)`` and sorted once, so a hot
entity spreads over many tasks and there is one exchange.  Each task walks its
range in Arrow batches with vector operations and emits only summaries:

* state changes: the rows whose state differs from the row before, and the edge rows;
* sessions: one partial per session of the range.  Partials merge associatively, so a
  session over many ranges is put together from one partial of each of them, and
  partials kept from earlier (the state of a stream) merge with new events the same way.

The summaries are written once.  What crosses ranges is resolved over a table with two
rows per range at most, which is broadcast; its size depends on the partition count only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.operators import sequence
from brisa.operators.sequence import PID, boundary_window, range_partitioned

_FIRST, _LAST = "_first_in_range", "_last_in_range"

NO_START = (1 << 63) - 1  # the earliest start of a session that has none yet


def sorted_ranges(df: DataFrame, keys: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Rows in the global order of ``keys``, a contiguous range in each task, tagged with the range's number."""
    return range_partitioned(df, keys, num_partitions).sortWithinPartitions(*keys)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Null-safe equality of two arrays."""
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _joined(a: pa.Array | None, b: pa.Array) -> pa.Array:
    return b if a is None else pa.concat_arrays([a, b])


# ------------------------------------------------------------------ state changes

def state_changes(df: DataFrame, group: str, order: Sequence[str], state: str, trigger: Column | None = None,
                  num_partitions: int | None = None) -> DataFrame:
    """Rows of ``df`` (group, order, state) whose state differs from the state of the group's previous row.

    Adds ``prev_<state>``.  Null states never differ; null groups are one group.  ``trigger`` is a
    further condition on ``<state>`` and ``prev_<state>``; it is applied before anything is written.
    """
    prev = f"prev_{state}"
    df = df.select(group, *order, state)
    rows = sorted_ranges(df, [group, *order], num_partitions)
    names = [*rows.columns, prev, _FIRST, _LAST]
    flags = [T.StructField(_FIRST, T.BooleanType()), T.StructField(_LAST, T.BooleanType())]
    schema = T.StructType([*rows.schema.fields, T.StructField(prev, df.schema[state].dataType), *flags])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wanted = None, False  # the newest row; whether it goes out even if it isn't the last
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g, s = batch.column(group), batch.column(state)
            newest = batch.slice(0, 1) if held is None else held  # the very first row has none before it
            before_g = _joined(newest.column(group), g)[:n]
            before_s = _joined(newest.column(state), s)[:n]
            same = _same(g, before_g)
            first = np.zeros(n, dtype=bool)
            if held is None:
                same[0], first[0] = False, True
            out = same & pc.fill_null(pc.not_equal(before_s, s), False).to_numpy(zero_copy_only=False)
            before_s = pc.if_else(pa.array(same), before_s, pa.scalar(None, before_s.type))
            rows = pa.RecordBatch.from_arrays([*batch.columns, before_s, pa.array(first), pa.array(np.zeros(n, dtype=bool))], names=names)
            if held is not None and wanted:
                yield held
            out |= first
            yield rows.filter(pa.array(np.append(out[:-1], False)))
            held, wanted = rows.slice(n - 1), bool(out[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array([True])], names=names)

    changed = F.col(prev).isNotNull() & (F.col(prev) != F.col(state))
    wanted = changed if trigger is None else changed & trigger
    wanted = F.coalesce(wanted, F.lit(False))
    edges = sequence.materialize(rows.mapInArrow(run, schema).filter(wanted | F.col(_FIRST) | F.col(_LAST)))
    carry = (edges.filter(_LAST).select(PID, F.struct(F.col(group).alias("g"), F.col(state).alias("s")).alias("_row"))
             .select(PID, F.lag("_row").over(boundary_window()).alias("_carry")))  # one row per range
    known = F.when(F.col("_carry").isNotNull() & F.col("_carry.g").eqNullSafe(F.col(group)), F.col("_carry.s"))
    return (edges.join(F.broadcast(carry), PID, "left")
            .withColumn(prev, F.when(F.col(_FIRST), known).otherwise(F.col(prev)))
            .filter(wanted).select(*df.columns, prev))


# ------------------------------------------------------------------ sessions

#: column -> how it merges; times are epoch microseconds
ACTIVITY = {"first": "min", "last": "max", "n": "sum"}
ONOFF = {"first": "first", "last": "last", "n": "sum", "first_on": "first", "last_on": "last", "start": "min"}


class ActivityRule:
    """A session ends where the next event is ``gap`` or more after the latest one.

    ``first`` and ``last`` are times, ``n`` counts events.  A partial may cover later ones whole.
    """
    columns = ACTIVITY

    def __init__(self, gap: int):
        self.gap = gap

    def superfluous(self, v: dict[str, np.ndarray], same: np.ndarray) -> np.ndarray | None:
        return None

    def breaks(self, v: dict[str, np.ndarray], same: np.ndarray) -> np.ndarray:
        group = np.concatenate([[0], np.cumsum(~same)])
        latest = pd.Series(v["last"]).groupby(group).cummax().to_numpy()
        return v["first"][1:] - latest[:-1] >= self.gap


class OnOffRule:
    """A session ends where a start follows the stop that it waits after by ``gap`` or more.

    Rows are starts (``first_on`` = ``last_on`` = 1) and stops in order.  A stop counts if it is the first one
    after a start; further ones before the next start find nothing to stop.  ``last`` is the time of the
    last row that counts, ``n`` and ``start`` are the number and the earliest of the starts.
    """
    columns = ONOFF

    def __init__(self, gap: int):
        self.gap = gap

    def superfluous(self, v: dict[str, np.ndarray], same: np.ndarray) -> np.ndarray | None:
        return np.concatenate([[False], same & (v["n"][1:] == 0) & (v["last_on"][:-1] == 0)])

    def breaks(self, v: dict[str, np.ndarray], same: np.ndarray) -> np.ndarray:
        return (v["first_on"][1:] == 1) & (v["last_on"][:-1] == 0) & (v["first"][1:] - v["last"][:-1] >= self.gap)


_MERGE = {"min": np.minimum, "max": np.maximum, "sum": np.add}


def _partials(rule, group: str, names: list[str]):
    """The sessions of each range from its sorted rows, in one pass.

    ``place`` is 0 for the range's first partial and 1 for one that depends on it; ``tail`` marks the last one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_g, open_v, pid, told, lone = None, None, None, 0, False

        def out(g: pa.Array, v: dict[str, np.ndarray], tail: bool) -> pa.RecordBatch:
            nonlocal told, lone
            places = np.full(min(told, 2) + len(g), 2)
            if told == 0:
                lone = isinstance(rule, OnOffRule) and v["n"][0] == 0
            # what follows a lone stop at the head hangs on whether an earlier range has stopped already
            places[0], places[1:2] = 0, 1 if lone else 2
            places, told = places[min(told, 2):], told + len(g)
            return pa.RecordBatch.from_arrays(
                [g, *(pa.array(v[c], pa.int64()) for c in rule.columns), pa.array(np.full(len(g), pid), pa.int32()),
                 pa.array(places, pa.int32()), pa.array(np.full(len(g), tail))], names=names)

        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column(PID)[0].as_py()
            g = _joined(open_g, batch.column(group))
            v = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in rule.columns}
            if open_v is not None:
                v = {c: np.concatenate([open_v[c], x]) for c, x in v.items()}
            same = _same(g[1:], g[:-1])
            drop = rule.superfluous(v, same)
            if drop is not None and drop.any():
                g, v = g.filter(pa.array(~drop)), {c: x[~drop] for c, x in v.items()}
                same = _same(g[1:], g[:-1])
            cut = ~same | rule.breaks(v, same)
            if isinstance(rule, OnOffRule) and not seen and len(cut):
                cut[0] |= v["n"][0] == 0  # a lone stop at the head stays apart
            seen = seen or len(cut) > 0
            starts = np.flatnonzero(np.concatenate([[True], cut]))
            ends = np.append(starts[1:], len(g)) - 1
            v = {c: v[c][starts] if how == "first" else v[c][ends] if how == "last" else _MERGE[how].reduceat(v[c], starts)
                 for c, how in rule.columns.items()}
            g = g.take(pa.array(starts))
            if len(g) > 1:
                yield out(g[:-1], {c: x[:-1] for c, x in v.items()}, False)
            open_g, open_v = g[-1:], {c: x[-1:] for c, x in v.items()}
        if open_g is not None:
            yield out(open_g, open_v, True)

    return run


def _carried(rule, group: str, names: list[str]):
    """For each range the open activity session before it, from the last partial of all ranges in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (group, latest time, chain)
        for batch in batches:
            g, pids, carried = batch.column(group), batch.column(PID).to_pylist(), []
            for i, (first, last) in enumerate(zip(batch.column("first").to_pylist(), batch.column("last").to_pylist())):
                carried.append(before)
                here = g[i].as_py()
                if before is not None and before[0] == here and first - before[1] < rule.gap:
                    before = (here, max(before[1], last), before[2])
                else:
                    before = (here, last, pids[i])
            known = [(p, c) for p, c in zip(pids, carried) if c is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in known], pa.int32()), pa.array([c[0] for _, c in known], g.type),
                 pa.array([c[1] for _, c in known], pa.int64()), pa.array([c[2] for _, c in known], pa.int32())], names=names)

    return run


def merged_sessions(partials: DataFrame, group: str, order: Sequence[str], rule, num_partitions: int | None = None) -> DataFrame:
    """Sessions of ``partials`` (group, the rule's columns, order) as one partial each.

    An event is a partial of its own.  Merging the partials of a part of the rows with the partials of
    the rest gives the sessions of all rows, so a stream keeps partials between micro-batches.
    """
    columns = list(rule.columns)
    keys = [group, *order]
    kind = partials.schema[group].dataType
    session_fields = [T.StructField(group, kind), *(T.StructField(c, T.LongType()) for c in columns)]
    local_schema = T.StructType([*session_fields, T.StructField(PID, T.IntegerType()), T.StructField("place", T.IntegerType()),
                                 T.StructField("tail", T.BooleanType())])
    walk = _partials(rule, group, local_schema.names)
    rows = sorted_ranges(partials.select(*dict.fromkeys([*keys, *columns])), keys, num_partitions)
    local = sequence.materialize(rows.select(group, *columns, PID).mapInArrow(walk, local_schema), "sessions")
    if isinstance(rule, OnOffRule):
        # what touches the edges of a range is walked once more: three partials per range at most, in one task
        edge = F.col("place").isin(0, 1) | F.col("tail")
        edges = local.filter(edge).repartition(1).sortWithinPartitions(PID, "tail", "place").select(group, *columns, F.lit(0).alias(PID))
        return local.filter(~edge).select(group, *columns).unionByName(edges.mapInArrow(walk, local_schema).select(group, *columns))
    # every partial within the gap of what earlier ranges have open joins it; one row per range tells which
    carry_schema = T.StructType([T.StructField(PID, T.IntegerType()), T.StructField("_g", kind), T.StructField("_latest", T.LongType()),
                                 T.StructField("_head", T.IntegerType())])
    carry = (local.filter("tail").repartition(1).sortWithinPartitions(PID).select(group, *columns, PID)
             .mapInArrow(_carried(rule, group, carry_schema.names), carry_schema))
    joins = F.col("_head").isNotNull() & F.col("_g").eqNullSafe(F.col(group)) & (F.col("first") - F.col("_latest") < rule.gap)
    chained = (local.join(F.broadcast(carry), PID, "left")
               .withColumn("_chain", F.when(joins, F.col("_head")).when(F.col("tail"), F.col(PID))))
    whole = chained.filter("_chain is null").select(group, *columns)
    merge = {"min": F.min, "max": F.max, "sum": F.sum}
    parts = (chained.filter("_chain is not null").groupBy(group, "_chain")
             .agg(*(merge[how](c).alias(c) for c, how in rule.columns.items())).select(group, *columns))
    return whole.unionByName(parts)


def activity_events(df: DataFrame, group: str, micros: Column, tiebreak: str) -> DataFrame:
    """Events as partials for :class:`ActivityRule`; rows without a time open no session."""
    return (df.select(F.col(group), micros.alias("first"), micros.alias("last"), F.lit(1).cast("long").alias("n"), F.col(tiebreak).alias("_tie"))
            .filter("first is not null"))


def onoff_events(df: DataFrame, group: str, micros: Column, is_start: Column, *order: Column) -> DataFrame:
    """Start and stop triggers as partials for :class:`OnOffRule`, with the ``order`` columns given."""
    on = is_start.cast("long")
    return df.select(
        F.col(group), *order, micros.alias("first"), micros.alias("last"), on.alias("n"), on.alias("first_on"), on.alias("last_on"),
        F.when(is_start, micros).otherwise(F.lit(NO_START)).alias("start")).filter("first is not null")


def time_of(micros: Column, dtype: T.DataType) -> Column:
    """The TIMESTAMP or TIMESTAMP_NTZ at ``micros``, whatever the session time zone."""
    if isinstance(dtype, T.TimestampNTZType):
        day = 86_400_000_000
        return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
                + F.make_dt_interval(days=F.floor(micros / F.lit(day)).cast("int"),
                                     secs=(F.pmod(micros, F.lit(day)).cast("decimal(18,6)") / F.lit(1_000_000)).cast("decimal(18,6)")))
    return F.timestamp_micros(micros)
