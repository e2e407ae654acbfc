"""The cleaning job and the loader, as plans over frames.

``clean_job``: frames -> decode -> zero-to-null -> route by station -> encode ->
frames.  Catalyst collapses it to one projection stage over the scan: no
exchange; the only Python is the payload codec when the built-in one is absent.
The same function serves batch and streaming frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.operators.clean import zero_to_null
from brisa.operators.codec import decode, encode
from brisa.operators.route import route
from brisa.operators.sequence import as_instant
from brisa.sources.kafka import to_frame

# --- fixed values: topic names and output partition count of the deployment ---
IN_TOPIC = "topic-clima-entrada"
OUT_TOPIC = "topic-clima-saida"
OUT_PARTITIONS = 12


def load_frames(readings: DataFrame, topic: str = IN_TOPIC, ts_col: str | None = None,
                engine: str = "auto") -> DataFrame:
    """Loader: readings -> keyless frames (no partition: the client spreads them).

    ``ts_col`` (optional) becomes the frame ``timestamp``, the arrival time seen
    by consumers in file transport.
    """
    keep = [ts_col] if ts_col else []
    enc = encode(readings, keep=keep, engine=engine)
    if not ts_col:
        return to_frame(enc, topic, "value", partition=None)
    enc = enc.withColumn("timestamp", as_instant(enc, ts_col))
    return to_frame(enc, topic, "value", partition=None, extra=["timestamp"])


Transform = Callable[[DataFrame], DataFrame]


def clean_job(frames: DataFrame, out_topic: str = OUT_TOPIC, num_partitions: int = OUT_PARTITIONS,
              overflow: str = "error", mode: str = "failfast", engine: str = "auto",
              decoder: Transform | None = None, transform: Transform | None = None,
              router: Transform | None = None, encoder: Transform | None = None) -> DataFrame:
    """The cleaning job.  Each stage is a pluggable ``DataFrame -> DataFrame``
    (U1-U3): ``decoder`` (frames -> readings), ``transform`` (the row map,
    default zero-to-null), ``router`` (adds ``partition``) and ``encoder``
    (readings + partition -> ``partition, value``).  Defaults reproduce the
    reference job.  A ``timestamp`` of the frames is carried along for the observers."""
    stamp = ["timestamp"] if "timestamp" in frames.columns else []
    decoder = decoder or (lambda df: decode(df, "value", mode=mode, engine=engine, keep=stamp))
    transform = transform or zero_to_null
    router = router or (lambda df: route(df, "codnum", num_partitions, overflow))
    encoder = encoder or (lambda df: encode(
        df, keep=["partition", *[c for c in stamp if c in df.columns]], engine=engine))
    out = encoder(router(transform(decoder(frames))))
    return to_frame(out, out_topic, "value", "partition", extra=[c for c in stamp if c in out.columns])


def frame_summary(frames: DataFrame) -> DataFrame:
    """``topic, partition, payload_bytes`` per frame (comparable with SQL)."""
    return frames.select("topic", "partition", F.octet_length("value").alias("payload_bytes"))
