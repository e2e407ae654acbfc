"""S4/L1/L2 as a stream: a source whose offsets follow the rate schedule.

An offset is a second of the schedule; what a micro-batch sends is the messages of its
seconds, known in closed form.  The source emits ranges of sequence numbers, not rows: the
rows are read from the stored dataset by their index, of which a micro-batch opens
only the part it sends.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from brisa.operators.replay import (
    FIXED_RATE,
    STRESS_EVERY_SECONDS,
    STRESS_START_RATE,
    STRESS_STEP,
    fixed_rate_second,
    with_ramp_second,
)
from brisa.operators.sequence import with_sequence
from brisa.session import passing_scratch

#: sequence numbers in one emitted range
RANGE_ROWS = 1 << 20
INDEX = "_idx"


@dataclass(frozen=True)
class Schedule:
    """Messages per second: ``start`` at first, ``step`` more every ``every`` seconds; ``total`` in all (None: without end)."""
    start: int = STRESS_START_RATE
    step: int = STRESS_STEP
    every: int = STRESS_EVERY_SECONDS
    total: int | None = None

    @classmethod
    def fixed(cls, rate: int = FIXED_RATE, total: int | None = None) -> Schedule:
        return cls(rate, 0, 1, total)

    def __post_init__(self):
        if self.start <= 0 or self.step < 0 or self.every <= 0:
            raise ValueError("need start > 0, step >= 0, every > 0")

    def sent_before(self, second: int) -> int:
        """Messages sent before the beginning of ``second``."""
        blocks, rest = divmod(second, self.every)
        sent = self.every * (self.start * blocks + self.step * (blocks * (blocks - 1) // 2)) + rest * (self.start + self.step * blocks)
        return sent if self.total is None else min(sent, self.total)

    def with_second(self, df: DataFrame, seq: str = "seq", out: str = "emit_second") -> DataFrame:
        """The second in which each message is sent."""
        if self.step == 0:
            return df.withColumn(out, fixed_rate_second(seq, self.start))
        return with_ramp_second(df, seq, out, self.start, self.step, self.every)

    def options(self) -> dict[str, str]:
        out = {"start": str(self.start), "step": str(self.step), "every": str(self.every)}
        return out if self.total is None else {**out, "total": str(self.total)}


@dataclass
class SeqRange(InputPartition):
    first: int
    end: int


class ReplaySource(DataSource):
    """``format("brisa_replay")``: rows (first_seq, end_seq).

    Options: those of a :class:`Schedule`; ``secondsPerBatch`` advances the schedule by that
    much at every micro-batch; without it the schedule follows the clock from ``startedAt`` (seconds
    since the epoch, default: when the query starts).  ``fromSecond`` and ``fromSent`` are where a restarted query stands.
    """

    @classmethod
    def name(cls) -> str:
        return "brisa_replay"

    def schema(self) -> str:
        return "first_seq long, end_seq long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ReplayReader(dict(self.options))


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.schedule = Schedule(int(o["start"]), int(o["step"]), int(o["every"]), int(o["total"]) if "total" in o else None)
        self.per_batch = int(o["secondsperbatch"]) if "secondsperbatch" in o else None
        self.second, self.sent = int(o.get("fromsecond", 0)), int(o.get("fromsent", 0))
        self.started = float(o["startedat"]) if "startedat" in o else time.time() - self.second

    def initialOffset(self) -> dict:
        return {"second": 0, "sent": 0}

    def latestOffset(self) -> dict:
        second = int(time.time() - self.started) if self.per_batch is None else self.second + self.per_batch
        if self.schedule.sent_before(second) > self.sent:  # else all is sent, or nothing yet
            self.second, self.sent = second, self.schedule.sent_before(second)
        return {"second": self.second, "sent": self.sent}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [SeqRange(a, min(a + RANGE_ROWS, end["sent"])) for a in range(start["sent"], end["sent"], RANGE_ROWS)]

    def read(self, partition: SeqRange) -> Iterator[tuple]:
        yield partition.first, partition.end


def store_replayable(df: DataFrame, order_cols: Sequence[str], path: str) -> int:
    """Write ``df`` with its position in the order of ``order_cols`` (unique), sorted by it; the number of rows.

    Row groups then hold contiguous positions, which is what lets a micro-batch skip the others.
    """
    with passing_scratch(df.sparkSession):
        indexed, n = with_sequence(df, order_cols, INDEX, with_count=True)
        indexed.sortWithinPartitions(INDEX).write.mode("overwrite").parquet(path)
    return n


def replay_slice(indexed: DataFrame, n: int, first: int, end: int) -> DataFrame:
    """Messages ``first`` to ``end`` (exclusive) of the endless replay of ``n`` indexed rows, with ``seq`` and ``cycle``.

    Reads only the positions in that span (comparisons that reach the parquet scan) and
    repeats a row in place for every cycle of it.
    """
    at = F.col(INDEX)
    if n <= 0 or end <= first:
        part = indexed.filter(F.lit(False))
    elif end - first >= n:
        part = indexed
    elif first % n <= (end - 1) % n:
        part = indexed.filter((at >= first % n) & (at <= (end - 1) % n))
    else:
        part = indexed.filter((at >= first % n) | (at <= (end - 1) % n))
    n = max(n, 1)
    cycles = F.expr(f"sequence(({first}L - {INDEX} + {n - 1}L) div {n}L, ({end - 1}L - {INDEX}) div {n}L)")
    return (part.withColumn("cycle", F.explode(cycles)).withColumn("seq", F.col("cycle") * F.lit(n).cast("long") + at).drop(INDEX))


def _resumes_at(spark: SparkSession, checkpoint: str) -> dict:
    """The offset up to which a stopped query has planned its micro-batches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    planned = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()] if fs.exists(at) else []
    if not planned:
        return {"second": 0, "sent": 0}
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{max(planned)}").collect()]  # three lines
    return json.loads(lines[-1])


def start_replay(spark: SparkSession, stored: str, n: int, schedule: Schedule, write, checkpoint: str,
                 seconds_per_batch: int | None = None, started_at: float | None = None) -> StreamingQuery:
    """Replay the dataset that :func:`store_replayable` wrote (``n`` rows) on a schedule, until stopped or ``total`` is sent.

    ``write(rows, epoch)`` gets the rows of each micro-batch with ``seq``, ``cycle`` and ``emit_second``; it
    is called again with the same rows if an epoch is retried (see :func:`to_folder`, :func:`to_topic`).
    """
    spark.dataSource.register(ReplaySource)
    stands = _resumes_at(spark, checkpoint)
    options = {**schedule.options(), "fromSecond": str(stands["second"]), "fromSent": str(stands["sent"])}
    if seconds_per_batch is not None:
        options["secondsPerBatch"] = str(int(seconds_per_batch))
    if started_at is not None:
        options["startedAt"] = str(float(started_at))

    def send(ranges: DataFrame, epoch: int) -> None:
        span = ranges.agg(F.min("first_seq").alias("a"), F.max("end_seq").alias("z")).first()
        if span["a"] is not None:
            rows = replay_slice(ranges.sparkSession.read.parquet(stored), n, span["a"], span["z"])
            write(schedule.with_second(rows), epoch)

    ranges = spark.readStream.format("brisa_replay").options(**options).load()
    return ranges.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()


def to_folder(path: str):
    """Each epoch's rows in a folder of its own (a retry overwrites it)."""
    return lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{path}/epoch={int(epoch)}")


def to_topic(options: dict, topic: str):
    """Each epoch's ``value`` column as keyless Kafka records (at least once)."""
    from brisa.sources.kafka import to_frame, write_frames

    return lambda rows, epoch: write_frames(to_frame(rows, topic, "value", partition=None), "kafka", options)


def run_until_sent(query: StreamingQuery) -> None:
    """Wait until a replay with a total has sent it, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
