"""Kafka-shaped frames, reader/writer options, file transport.

A frame is ``key binary, value binary, topic string, partition int`` on the write
side; the read side adds ``offset``, ``timestamp``, ``timestampType``.  The
Kafka connector is not bundled with every Spark install, so the same frames can
travel through parquet files (``transport="files"``), which tests use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brisa.operators.route import place_balanced
from brisa.schema import FRAME_READ_SCHEMA

# --- fixed values: producer presets (client settings of the two senders) ---
# Cleaning job sink: lz4, 64 MB buffer, no idempotence, acks=1, 64 KB batches, 20 ms linger.
CLEANER_SINK_PRESET = {
    "kafka.compression.type": "lz4",
    "kafka.buffer.memory": "67108864",
    "kafka.enable.idempotence": "false",
    "kafka.acks": "1",
    "kafka.batch.size": "65536",
    "kafka.linger.ms": "20",
}
# Loader sink: snappy, 64 KB batches, 10 ms linger.
LOADER_SINK_PRESET = {
    "kafka.compression.type": "snappy",
    "kafka.batch.size": "65536",
    "kafka.linger.ms": "10",
}
# Frame files: payloads of neighbouring rows are alike, which zstd makes less than half as large as snappy does.
FILE_SINK_PRESET = {"compression": "zstd"}


def source_options(bootstrap: str, topic: str, starting: str = "earliest",
                   group_id: str | None = None, extra: dict | None = None) -> dict:
    """S2 (``earliest``, the cleaning job) / S3 (``latest``, the observers).

    Spark tracks offsets in the query checkpoint; a group id is only advisory.
    """
    if starting not in ("earliest", "latest"):
        raise ValueError("starting must be 'earliest' or 'latest'")
    opts = {"kafka.bootstrap.servers": bootstrap, "subscribe": topic, "startingOffsets": starting}
    if group_id:
        opts["kafka.group.id"] = group_id
    opts.update(extra or {})
    return opts


def sink_options(bootstrap: str, preset: dict | None = None, topic: str | None = None,
                 extra: dict | None = None) -> dict:
    opts = {"kafka.bootstrap.servers": bootstrap, **(preset or {})}
    if topic:
        opts["topic"] = topic
    opts.update(extra or {})
    return opts


#: columns that the Kafka sink takes, and the types it accepts
SINK_COLUMNS = {"key": ("binary", "string"), "value": ("binary", "string"), "topic": ("string",), "partition": ("int",),
                "headers": ("array<struct<key:string,value:binary>>",)}


@dataclass(frozen=True)
class FrameSink:
    """Where a stream of frames goes: the data source, its options and the columns that lay out files."""
    format: str
    options: dict[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()

    def shaped(self, frames: DataFrame) -> DataFrame:
        """The columns that the sink takes; fails if a Kafka record would lack its value or topic, or has a wrong type."""
        if self.format != "kafka":
            return frames
        types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
        missing = {"value"} - types.keys() | ({"topic"} - types.keys() - self.options.keys())
        if missing:
            raise ValueError(f"frames for Kafka lack {sorted(missing)}")
        for name, accepted in SINK_COLUMNS.items():
            if name in types and types[name] not in accepted:
                raise ValueError(f"frame column {name} is {types[name]}, the Kafka sink takes {' or '.join(accepted)}")
        return frames.select(*[c for c in frames.columns if c in SINK_COLUMNS])

    def writer(self, frames: DataFrame, checkpoint: str, available_now: bool = True, every: str = "1 second") -> DataStreamWriter:
        """The configured append writer; ``start()`` runs it.

        The checkpoint makes the Kafka sink at-least-once and the file sink exactly-once.
        """
        writer = (self.shaped(frames).writeStream.format(self.format).options(**self.options)
                  .option("checkpointLocation", checkpoint).outputMode("append"))
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


def frame_sink(transport: str, target, preset: dict | None = None, placed: bool = True) -> FrameSink:
    """K1/K2: the streaming sink of frames.

    ``transport="kafka"``: ``target`` is the bootstrap address (``preset`` gives the producer
    settings) or a whole option map.  Rows are placed by their ``partition`` column if they have
    one, else the client spreads them.  ``transport="files"``: ``target`` is a folder, laid out by
    ``partition`` if ``placed``.
    """
    if transport == "kafka":
        return FrameSink("kafka", sink_options(target, preset) if isinstance(target, str) else dict(target))
    if transport == "files":
        return FrameSink("parquet", {**FILE_SINK_PRESET, "path": target}, ("partition",) if placed else ())
    raise ValueError(f"unknown transport {transport!r}")


def to_frame(df: DataFrame, topic: str, value: str | Column = "value",
             partition: str | Column | None = "partition", extra: list[str] | None = None
             ) -> DataFrame:
    """Shape rows as Kafka records: null key, explicit partition (or none = D3 spread)."""
    v = F.col(value) if isinstance(value, str) else value
    cols = [F.lit(None).cast("binary").alias("key"), v.alias("value"), F.lit(topic).alias("topic")]
    if partition is not None:
        p = F.col(partition) if isinstance(partition, str) else partition
        cols.append(p.cast("int").alias("partition"))
    return df.select(*cols, *(extra or []))


def read_frames(spark: SparkSession, transport: str, path_or_options, stream: bool = False,
                files_per_trigger: int | None = None) -> DataFrame:
    """Read frames from Kafka (options dict) or from parquet files (a path; a stream takes
    ``files_per_trigger`` of them in a micro-batch)."""
    if transport == "kafka":
        reader = spark.readStream if stream else spark.read
        return reader.format("kafka").options(**path_or_options).load()
    if transport == "files":
        if stream:
            reader = spark.readStream.schema(FRAME_READ_SCHEMA)
            if files_per_trigger:
                reader = reader.option("maxFilesPerTrigger", int(files_per_trigger))
            return reader.parquet(path_or_options)
        return spark.read.schema(FRAME_READ_SCHEMA).parquet(path_or_options)
    raise ValueError(f"unknown transport {transport!r}")


def write_frames(df: DataFrame, transport: str, path_or_options, mode: str = "append", balanced: bool = False,
                 num_tasks: int | None = None) -> None:
    """Batch write.  Kafka places each row by its ``partition`` column; files are
    laid out by ``partitionBy("partition")`` when the column is present, with ``balanced``
    by tasks of about equal size (:func:`brisa.operators.route.place_balanced`)."""
    if transport == "kafka":
        df.write.format("kafka").options(**path_or_options).save()
        return
    if transport == "files":
        if balanced:
            df = place_balanced(df, num_tasks)
        w = df.write.mode(mode)
        if "partition" in df.columns:
            w = w.partitionBy("partition")
        w.parquet(path_or_options)
        return
    raise ValueError(f"unknown transport {transport!r}")
