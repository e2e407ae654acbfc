"""Streaming queries: the cleaning job (T1), the observers - screen rate, throughput
log, exporter (S3, A1-A3, K3-K5) - and the replay source (S4/L1).

Sources are Kafka or folders of frame files; every query needs a checkpoint
location under the shared checkpoint folder, so a restarted driver or a lost
executor resumes from committed offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from brisa.functions.columns import rate_per_unit, round_half_up, truncate_int
from brisa.operators.parse import load_readings, malformed_records
from brisa.operators.throughput import window_counts
from brisa.plans.pipeline import IN_TOPIC, clean_job, load_frames
from brisa.session import shared_path
from brisa.sources.csv import csv_stream
from brisa.sources.kafka import CLEANER_SINK_PRESET, LOADER_SINK_PRESET, frame_sink
from brisa.streaming.versions import Summed

FOLD_EPOCHS = 20  # epochs of window counts that are folded into one table at a time
PARTIAL_COUNTS = "_start_us long, n_msgs long, window_seconds int, unit_seconds double"


def start_clean_stream(frames: DataFrame, target, checkpoint: str, available_now: bool = True, transport: str = "files",
                       preset: dict | None = CLEANER_SINK_PRESET, **job_kwargs) -> StreamingQuery:
    """Stateless frames -> clean job -> frames (append), no watermark.

    ``target`` is a folder (``transport="files"``), or the bootstrap address or option map of
    the Kafka sink (``transport="kafka"``), where every frame goes to the partition of its station.
    """
    sink = frame_sink(transport, target, preset)
    return sink.writer(clean_job(frames, **job_kwargs), checkpoint, available_now).start()


def start_loader_stream(spark: SparkSession, csv_path: str, target, checkpoint: str, available_now: bool = True,
                        transport: str = "files", preset: dict | None = LOADER_SINK_PRESET, topic: str = IN_TOPIC,
                        malformed: str = "fail", files_per_trigger: int | None = None, stamp: bool = False,
                        **scan) -> StreamingQuery:
    """S1 -> P1 -> P3 -> D3 -> K2 as a stream: CSV files of a folder become keyless frames as they arrive.

    Every file is loaded once, however late it comes and however often the query restarts.
    ``malformed`` is the policy of :func:`brisa.operators.parse.load_readings`; under ``"skip"`` the
    dropped records can be kept by a :func:`start_malformed_stream` on the same folder.  ``stamp`` adds the
    time of loading as ``timestamp`` (brokers do that themselves).  ``scan`` goes to :func:`csv_stream`, where
    ``drop_read`` deletes files once their frames are committed.
    """
    readings = load_readings(csv_stream(spark, csv_path, files_per_trigger=files_per_trigger, **scan), malformed)
    frames = load_frames(readings, topic)
    if stamp:
        frames = frames.withColumn("timestamp", F.current_timestamp())
    return frame_sink(transport, target, preset, placed=False).writer(frames, checkpoint, available_now).start()


def start_malformed_stream(spark: SparkSession, csv_path: str, out_path: str, checkpoint: str, available_now: bool = True,
                           **scan) -> StreamingQuery:
    """The malformed records of a folder of CSV files as text, with the names of their bad cells."""
    sink = frame_sink("files", out_path, placed=False)
    return sink.writer(malformed_records(csv_stream(spark, csv_path, **scan)), checkpoint, available_now).start()


def _stamped(frames: DataFrame, ts_col: str) -> DataFrame:
    """``frames`` whose ``ts_col`` must be set: a message without it would vanish from every count."""
    missing = F.raise_error(F.lit(f"an observer got a message without {ts_col}"))
    return frames.withColumn(ts_col, F.when(F.col(ts_col).isNull(), missing).otherwise(F.col(ts_col)))


def start_window_counts(frames: DataFrame, out_path: str, checkpoint: str, window_seconds: int,
                        unit_seconds: float = 1.0, ts_col: str = "timestamp",
                        available_now: bool = True) -> StreamingQuery:
    """A1-A3 over a stream: what arrives is counted, whenever it arrives.

    Each micro-batch writes its own count per window to its epoch folder (a retried
    epoch overwrites its folder), and old epochs are folded into one row per window;
    readers sum them.  There is no watermark and no state, so no message is late and the
    last window is there too.
    """
    table = _counts(out_path)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        table.fold(batch.sparkSession, epoch_id)
        counts = window_counts(_stamped(batch, ts_col), ts_col, window_seconds)
        table.write(counts.withColumns({"window_seconds": F.lit(int(window_seconds)), "unit_seconds": F.lit(float(unit_seconds))}), epoch_id)

    w = frames.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _counts(path: str) -> Summed:
    return Summed(path, PARTIAL_COUNTS, fold_every=FOLD_EPOCHS, sums=("n_msgs",))


def _summed(spark: SparkSession, path: str) -> DataFrame:
    """Messages per window over all epochs."""
    return _counts(path).before(spark).withColumn("_rate", rate_per_unit("n_msgs", F.col("window_seconds"), F.col("unit_seconds")))


def start_throughput_table(frames: DataFrame, out_path: str, checkpoint: str,
                           window_seconds: int, unit_seconds: float = 1.0,
                           available_now: bool = True) -> StreamingQuery:
    """A1: maintain the window table of a stream; read it with :func:`read_throughput_table`."""
    return start_window_counts(frames, out_path, checkpoint, window_seconds, unit_seconds, available_now=available_now)


def read_throughput_table(spark: SparkSession, path: str) -> DataFrame:
    """Current window table: start (ms), messages, rate rounded half-up and truncated, end (ms)."""
    start = (F.col("_start_us") / F.lit(1000)).cast("long")
    return _summed(spark, path).select(
        start.alias("window_start_unix"), "n_msgs", round_half_up(F.col("_rate")).alias("throughput_msgs_sec"),
        truncate_int(F.col("_rate")).alias("throughput_truncated"),
        (start + F.col("window_seconds") * 1000).alias("timestamp_unix"))


def start_throughput_log(frames: DataFrame, out_path: str, checkpoint: str,
                         window_seconds: int = 10, unit_seconds: float = 1.0,
                         available_now: bool = True) -> StreamingQuery:
    """A2/K4 over a stream: counts for the log lines that :func:`read_throughput_log` gives."""
    return start_window_counts(frames, out_path, checkpoint, window_seconds, unit_seconds, available_now=available_now)


def read_throughput_log(spark: SparkSession, path: str, window_seconds: int | None = None) -> DataFrame:
    """``timestamp_unix,throughput_msgs_sec`` lines of the windows counted so far, the last one included.

    With ``window_seconds``, empty windows between the first and the last one come
    as zero-rate lines; the grid is a distributed ``spark.range``, only its bounds
    reach the driver.  :func:`brisa.sources.csv.write_log` writes them as text.
    """
    log = read_throughput_table(spark, path).select(
        "timestamp_unix", F.col("throughput_truncated").alias("throughput_msgs_sec"))
    if not window_seconds:
        return log
    b = log.agg(F.min("timestamp_unix").alias("lo"), F.max("timestamp_unix").alias("hi")).first()
    if b is None or b["lo"] is None:
        return log
    step = int(window_seconds) * 1000
    grid = spark.range(b["lo"], b["hi"] + step, step).select(
        F.col("id").alias("timestamp_unix"), F.lit(0).alias("throughput_msgs_sec"))
    return (log.unionByName(grid).groupBy("timestamp_unix")
            .agg(F.max("throughput_msgs_sec").cast("int").alias("throughput_msgs_sec")))


def start_decoded_rate(frames: DataFrame, out_path: str, checkpoint: str, window_seconds: int = 1,
                       unit_seconds: float = 1.0, available_now: bool = True) -> StreamingQuery:
    """A3 over a stream: throughput of the frames that decode."""
    from brisa.operators.codec import decode

    decoded = decode(frames, "value", mode="permissive", keep=["timestamp"])
    return start_window_counts(decoded, out_path, checkpoint, window_seconds, unit_seconds, available_now=available_now)


class RateListener(StreamingQueryListener):
    """K5: rate to screen from query progress (no extra job, no driver data)."""

    def __init__(self, printer=print, keep: int = 1000):
        from collections import deque

        self.printer = printer
        self.rates = deque(maxlen=keep)  # recent rates only: the stream never ends

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        rate = p.inputRowsPerSecond or 0.0  # arrivals over elapsed time, not over time spent on the batch
        self.rates.append(rate)
        if p.numInputRows > 0:
            self.printer(f"rate: {rate:.0f} msgs/s")
        dec = (p.observedMetrics or {}).get("decode")
        if dec is not None and dec["dropped"]:
            self.printer(f">>> [DECODE] {dec['dropped']} of {dec['received']} frames undecodable")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.printer(f"query {event.id} failed: {event.exception}")


def run_to_completion(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output path, checkpoint path) under the shared checkpoint folder."""
    base = shared_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def replay_stream(indexed: DataFrame, n: int, rows_per_second: int, idx_col: str = "_idx",
                  source: str = "rate", rows_per_batch: int | None = None) -> DataFrame:
    """S4/L1 as a stream: a rate source emits ``seq`` = 0, 1, 2, ... at the fixed
    rate, and each tick is joined to row ``seq % n`` of the sequence-numbered
    dataset (``operators.sequence.with_sequence``), i.e. the dataset replayed in a
    loop.  ``source="rate-micro-batch"`` gives a deterministic ``rows_per_batch``.

    The static side is joined on its index each micro-batch; keep it stored
    sorted by the index so the scan prunes to the row groups a batch needs.
    """
    spark = indexed.sparkSession
    reader = spark.readStream.format(source)
    if source == "rate":
        reader = reader.option("rowsPerSecond", int(rows_per_second))
    else:
        reader = reader.option("rowsPerBatch", int(rows_per_batch or rows_per_second))
    ticks = reader.load().select(F.col("value").alias("seq"), F.col("timestamp").alias("emit_ts"))
    cycle = F.floor(F.col("seq") / F.lit(int(n))).cast("long")
    return (ticks.withColumn(idx_col, F.pmod(F.col("seq"), F.lit(int(n))))
            .withColumn("cycle", cycle)
            .join(indexed, idx_col, "inner"))


def start_exporter(frames: DataFrame, out_path: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    """K3 + P5 over a stream: decodable frames become quoted CSV rows under the
    export header; undecodable ones are skipped and counted (``observedMetrics
    ["decode"]`` of each progress event: ``dropped``, ``received``)."""
    from brisa.operators.codec import decode
    from brisa.operators.export import to_text_columns
    from brisa.sources.csv import EXPORT_OPTIONS

    text = to_text_columns(decode(frames, "value", mode="permissive", observation="decode"))
    w = (text.writeStream.format("csv").options(**EXPORT_OPTIONS).option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def start_observers(spark: SparkSession, frames_source, base: str, transport: str = "files",
                    available_now: bool = True) -> dict[str, StreamingQuery]:
    """S3: the three independent consumers of the cleaned topic - screen rate
    (1 s windows), throughput log (10 s windows) and exporter - each its own
    query reading the source from its own checkpoint."""
    from brisa.sources.kafka import read_frames

    def frames():
        return read_frames(spark, transport, frames_source, stream=True)

    return {
        "screen": start_throughput_table(frames(), f"{base}/screen", f"{base}/screen_ckpt", 1,
                                         available_now=available_now),
        "log": start_throughput_log(frames(), f"{base}/log", f"{base}/log_ckpt", 10,
                                    available_now=available_now),
        "decoded": start_decoded_rate(frames(), f"{base}/decoded", f"{base}/decoded_ckpt", 1,
                                      available_now=available_now),
        "export": start_exporter(frames(), f"{base}/export", f"{base}/export_ckpt", available_now),
    }


def start_observer(spark: SparkSession, frames_source, base: str, mode: str = "normal",
                   transport: str = "files", available_now: bool = True) -> StreamingQuery:
    """One observer, chosen like the source program's read mode: ``"normal"``
    (1 s screen rate), ``"logger"`` (10 s throughput log) or ``"exporter"``
    (CSV export of decodable readings)."""
    from brisa.sources.kafka import read_frames

    frames = read_frames(spark, transport, frames_source, stream=True)
    if mode == "normal":
        return start_throughput_table(frames, f"{base}/screen", f"{base}/screen_ckpt", 1,
                                      available_now=available_now)
    if mode == "logger":
        return start_throughput_log(frames, f"{base}/log", f"{base}/log_ckpt", 10,
                                    available_now=available_now)
    if mode == "exporter":
        return start_exporter(frames, f"{base}/export", f"{base}/export_ckpt", available_now)
    raise ValueError(f"mode must be 'normal', 'logger' or 'exporter', got {mode!r}")
