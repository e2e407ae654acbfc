"""brisa: a Spark-native engine for sensor-reading streams.

Every operator is a ``DataFrame -> DataFrame`` function built from Catalyst
expressions or built-in Spark operators, so the same code runs on batch tables
and on Structured Streaming sources.  The names below are the public surface.
"""

from brisa.operators.clean import presence_flags, zero_to_null
from brisa.operators.codec import decode, encode
from brisa.operators.events import (
    domain_filter,
    hold_intervals,
    hold_intervals_onoff,
    leave_state,
    transitions,
)
from brisa.operators.export import to_text_columns
from brisa.operators.parse import blank_to_null, parse_readings, parsed_date, typed_parse
from brisa.operators.replay import fixed_rate_second, replay, with_ramp_second
from brisa.operators.route import place_by_partition, route, spread
from brisa.operators.sequence import with_previous, with_sequence
from brisa.operators.throughput import throughput_log, throughput_screen
from brisa.plans.pipeline import clean_job, load_frames
from brisa.schema import CLEAN_COLS, EXPORT_HEADER, READING_SCHEMA
from brisa.session import build_session
from brisa.sources.csv import csv_scan, csv_stream, write_export, write_log
from brisa.sources.kafka import read_frames, sink_options, source_options, to_frame, write_frames

__version__ = "0.1.0"

__all__ = [
    "CLEAN_COLS", "EXPORT_HEADER", "READING_SCHEMA", "blank_to_null", "build_session", "clean_job",
    "csv_scan", "csv_stream", "decode", "domain_filter", "encode", "fixed_rate_second",
    "hold_intervals", "hold_intervals_onoff", "leave_state", "load_frames", "parse_readings",
    "parsed_date", "place_by_partition", "presence_flags", "read_frames", "replay", "route",
    "sink_options", "source_options", "spread", "throughput_log", "throughput_screen",
    "to_frame", "to_text_columns", "transitions", "typed_parse", "with_previous",
    "with_ramp_second", "with_sequence", "write_export", "write_frames", "write_log", "zero_to_null",
]
