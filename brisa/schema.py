"""The sensor-reading data model.

One flat record of 26 fields.  The names, order, wire tags and types below are
fixed values: they must equal the reference message layout and CSV column order
for results (and payloads) to be interchangeable.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: reading fields in CSV / wire-tag order (tag = position + 1) ---
# name, Spark type, has presence (optional) on the wire
READING_FIELDS: list[tuple[str, T.DataType, bool]] = [
    ("objectid", T.LongType(), False),
    ("data", T.StringType(), False),
    ("codnum", T.IntegerType(), True),
    ("estacao", T.StringType(), True),
    ("chuva", T.DoubleType(), True),
    ("pres", T.DoubleType(), True),
    ("rs", T.DoubleType(), True),
    ("temp", T.DoubleType(), True),
    ("ur", T.DoubleType(), True),
    ("dir_vento", T.DoubleType(), True),
    ("vel_vento", T.DoubleType(), True),
    ("so2", T.DoubleType(), True),
    ("no2", T.DoubleType(), True),
    ("hcnm", T.DoubleType(), True),
    ("hct", T.DoubleType(), True),
    ("ch4", T.DoubleType(), True),
    ("co", T.DoubleType(), True),
    ("no", T.DoubleType(), True),
    ("nox", T.DoubleType(), True),
    ("o3", T.DoubleType(), True),
    ("pm10", T.DoubleType(), True),
    ("pm2_5", T.DoubleType(), True),
    ("lat", T.DoubleType(), True),
    ("lon", T.DoubleType(), True),
    ("x_utm_sirgas2000", T.DoubleType(), True),
    ("y_utm_sirgas2000", T.DoubleType(), True),
]

# --- fixed values: the 18 measurements whose zero reading means "faulty" ---
CLEAN_COLS: list[str] = [
    "chuva", "pres", "rs", "temp", "ur", "dir_vento", "vel_vento", "so2", "no2",
    "hcnm", "hct", "ch4", "co", "no", "nox", "o3", "pm10", "pm2_5",
]

# --- fixed values: header of the exported text file (last two names shortened) ---
EXPORT_HEADER: list[str] = [
    "objectid", "data", "codnum", "estacao", "chuva", "pres", "rs", "temp", "ur",
    "dir_vento", "vel_vento", "so2", "no2", "hcnm", "hct", "ch4", "co", "no", "nox",
    "o3", "pm10", "pm2_5", "lat", "lon", "x_utm", "y_utm",
]

# --- fixed values: header of the throughput log ---
LOG_HEADER: list[str] = ["timestamp_unix", "throughput_msgs_sec"]

READING_COLS: list[str] = [name for name, _, _ in READING_FIELDS]
OPTIONAL_COLS: list[str] = [name for name, _, opt in READING_FIELDS if opt]
FIELD_TYPES: dict[str, T.DataType] = {name: t for name, t, _ in READING_FIELDS}

READING_SCHEMA = T.StructType(
    [T.StructField(name, t, nullable=opt) for name, t, opt in READING_FIELDS]
)

# Positional text scan: 26 strings, typed afterwards.
TEXT_SCHEMA = T.StructType([T.StructField(name, T.StringType(), True) for name in READING_COLS])

# Kafka-shaped frame used as transport (write side; read side adds offset/timestamp).
FRAME_WRITE_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType(), True),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("partition", T.IntegerType(), True),
])
FRAME_READ_SCHEMA = T.StructType(list(FRAME_WRITE_SCHEMA.fields) + [
    T.StructField("offset", T.LongType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("timestampType", T.IntegerType(), True),
])

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp_unix", T.LongType(), False),
    T.StructField("throughput_msgs_sec", T.IntegerType(), False),
])
