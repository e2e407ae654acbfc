"""Positional CSV scan and the CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.operators.parallelism import ensure_parallelism
from brisa.schema import TEXT_SCHEMA

# Reader: the first line is a header and is dropped unread; columns map by
# position (enforceSchema ignores header names); PERMISSIVE null-fills short rows
# and cuts extra columns; typing happens afterwards (parse.typed_parse), where
# bad numbers fail or become null.
SCAN_OPTIONS = {
    "header": "true",
    "enforceSchema": "true",
    "mode": "PERMISSIVE",
}

# How a quote is written inside a quoted cell: twice (our own export), or behind a backslash.
DIALECTS = {
    "doubled": {"quote": '"', "escape": '"'},
    "backslash": {"quote": '"', "escape": "\\"},
}

_RAW = "__raw_record"

# Writer: every field quoted, quotes doubled, nulls written as empty text.
EXPORT_OPTIONS = {
    "header": "true",
    "quoteAll": "true",
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
}

LOG_OPTIONS = {"header": "true", "quoteAll": "false"}


def _scan(reader, path: str, schema: T.StructType, dialect: str, multiline: bool, options: dict | None) -> DataFrame:
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {sorted(DIALECTS)}, got {dialect!r}")
    reader = reader.options(**{**SCAN_OPTIONS, **DIALECTS[dialect], "multiLine": str(bool(multiline)).lower(), **(options or {})})
    if multiline:
        return reader.schema(schema).csv(path)
    raw = reader.option("columnNameOfCorruptRecord", _RAW).schema(T.StructType([*schema.fields, T.StructField(_RAW, T.StringType())])).csv(path)
    text = F.col(_RAW) if dialect == "doubled" else F.regexp_replace(_RAW, r"\\.", "")
    broken = (F.length(text) - F.length(F.replace(text, F.lit('"')))) % 2 == 1
    first = schema.fields[0].name
    checked = F.when(broken, F.raise_error(F.concat(F.lit("a quoted cell does not end on its line, scan with multiline=True: "), F.left(_RAW, F.lit(200)))))
    return raw.withColumn(first, checked.otherwise(F.col(first))).drop(_RAW)


def csv_scan(spark: SparkSession, path: str, schema: T.StructType = TEXT_SCHEMA, dialect: str = "doubled",
             multiline: bool = False, options: dict | None = None) -> DataFrame:
    """Batch scan of reading CSV files as 26 text columns.

    ``dialect`` says how quotes inside quoted cells are written (``DIALECTS``).  With ``multiline`` a
    quoted cell may hold line breaks; a file is then read by one task.  Without it files are split at
    any line end, and a record that a quoted line break cuts in two fails the scan: the rows of
    such a record that do not have all columns hold an odd number of quotes.
    """
    return _scan(spark.read, path, schema, dialect, multiline, options)


def csv_stream(spark: SparkSession, path: str, schema: T.StructType = TEXT_SCHEMA, dialect: str = "doubled",
               multiline: bool = False, options: dict | None = None, files_per_trigger: int | None = None,
               drop_read: bool = False) -> DataFrame:
    """Streaming twin of :func:`csv_scan` (new files in a folder, ``files_per_trigger`` of them in a micro-batch).

    With ``drop_read`` the files of a micro-batch go when the next one begins, those of the last one when the query
    is started again and finds more: only for a folder that no other query reads.
    """
    every = {"maxFilesPerTrigger": str(int(files_per_trigger))} if files_per_trigger else {}
    drop = {"cleanSource": "delete"} if drop_read else {}
    return _scan(spark.readStream, path, schema, dialect, multiline, {**every, **drop, **(options or {})})


def write_export(df: DataFrame, path: str, mode: str = "overwrite", records_per_file: int | None = None) -> None:
    """K3: text columns to quoted CSV with a header (one file per task, or as many as ``records_per_file``
    asks for: a file that is scanned with ``multiline`` is read by one task, and a stream takes whole files)."""
    most = {"maxRecordsPerFile": str(int(records_per_file))} if records_per_file else {}
    ensure_parallelism(df).write.mode(mode).options(**EXPORT_OPTIONS, **most).csv(path)


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """K4: ``timestamp_unix,throughput_msgs_sec`` lines."""
    df.write.mode(mode).options(**LOG_OPTIONS).csv(path)
