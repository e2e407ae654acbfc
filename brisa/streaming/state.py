"""E3 as one continuous Spark operator: session windows with a watermark.

:mod:`brisa.streaming.keyed` has the operators that keep their own state tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.operators.events import check_hold
from brisa.operators.sequence import micros_of


def hold_intervals_stream(df: DataFrame, entity: str, ts: str, hold_seconds: int,
                          watermark: str) -> DataFrame:
    """E3 on a stream: Spark's event-time ``session_window`` per entity.

    A session closes when no event arrives for ``hold_seconds`` (an event exactly
    ``hold_seconds`` later opens a new one) - the batch rule of
    :func:`brisa.operators.events.hold_intervals` - and, in append mode, is emitted
    once the watermark passes its end, after which its state is dropped.  With
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` on (a
    :func:`brisa.session.build_session` default) sessions are pre-merged in each
    input partition, so a dominant entity ships sessions rather than events.
    """
    gap_us = check_hold(hold_seconds) - 1
    fields = {f.name: f.dataType for f in df.schema.fields}
    inst = F.timestamp_micros(micros_of(F.col(ts), fields[ts]))
    if int(hold_seconds) == 0:
        # zero delay: every event is its own interval, closed at once (Spark's
        # session_window would emit nothing for a zero gap)
        return df.select(entity, inst.alias("hold_start"), inst.alias("hold_end"),
                         F.lit(1).cast("long").alias("n_events"))
    src = df.select(entity, inst.alias("_t")).withWatermark("_t", watermark)
    # session_window joins events exactly ``gap`` apart (touching sessions merge);
    # the hold rule starts a new interval there.  A gap 1 us shorter splits them,
    # and the microsecond is added back to the reported end.
    sess = src.groupBy(entity, F.session_window("_t", f"{gap_us} microseconds").alias("_s")).agg(
        F.count(F.lit(1)).alias("n_events"))
    return sess.select(entity, F.col("_s.start").alias("hold_start"),
                       F.timestamp_micros(F.unix_micros(F.col("_s.end")) + F.lit(1)).alias("hold_end"),
                       "n_events")
