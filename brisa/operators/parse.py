"""Blank detection and typed parsing of text cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.functions.columns import blank_to_null_col
from brisa.schema import FIELD_TYPES

_INTEGER_TEXT = r"^[+-]?[0-9]+$"


def blank_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing / whitespace-only cells become null, other text is kept verbatim."""
    return df.withColumns({c: blank_to_null_col(c) for c in cols})


def _ansi(df: DataFrame) -> bool:
    return str(df.sparkSession.conf.get("spark.sql.ansi.enabled")).lower() == "true"  # Spark's own default counts too


def _parse_col(name: str, text: Column, dtype: T.DataType, errors: str, strict_integers: bool,
               ansi: bool) -> Column:
    if isinstance(dtype, T.StringType):
        return text
    strict_int = strict_integers and isinstance(dtype, (T.IntegerType, T.LongType))
    if errors == "null":
        parsed = text.try_cast(dtype)
        # Integer parsing in the source system rejects padding; Spark's cast trims it.
        return F.when(text.rlike(_INTEGER_TEXT), parsed) if strict_int else parsed
    if ansi:
        # ANSI cast fails the task on a bad value (CAST_INVALID_INPUT) at the cost
        # of a plain cast; an explicit per-cell check would cost about 4x more.
        if strict_int:
            return F.when(text.isNull() | text.rlike(_INTEGER_TEXT), text.cast(dtype)).otherwise(
                F.raise_error(F.concat(F.lit(f"cannot parse {name} as {dtype.simpleString()}: "), text)))
        return text.cast(dtype)
    parsed = text.try_cast(dtype)
    if strict_int:
        parsed = F.when(text.rlike(_INTEGER_TEXT), parsed)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(
        F.concat(F.lit(f"cannot parse {name} as {dtype.simpleString()}: "), text))).otherwise(parsed)


def typed_parse(df: DataFrame, types: Mapping[str, T.DataType], errors: str = "fail",
                strict_integers: bool = False, defaults: Mapping[str, object] | None = None
                ) -> DataFrame:
    """Blank -> null, then cast each listed column to its type.

    ``errors="fail"`` raises on the first bad cell (the load aborts, as the source
    loader does); ``errors="null"`` turns bad cells into null.  ``defaults`` gives
    the value of fields without presence (absent -> default).
    """
    if errors not in ("fail", "null"):
        raise ValueError(f"errors must be 'fail' or 'null', got {errors!r}")
    defaults = dict(defaults or {})
    ansi = _ansi(df)
    out = {}
    for name, dtype in types.items():
        col = _parse_col(name, blank_to_null_col(name), dtype, errors, strict_integers, ansi)
        if name in defaults:
            col = F.coalesce(col, F.lit(defaults[name]).cast(dtype))
        out[name] = col
    return df.withColumns(out)


def parse_readings(text_df: DataFrame, errors: str = "fail",
                   strict_integers: bool = False) -> DataFrame:
    """26 text cells -> typed reading record (ids default to 0 / "")."""
    parsed = typed_parse(text_df, FIELD_TYPES, errors=errors, strict_integers=strict_integers,
                         defaults={"objectid": 0, "data": ""})
    return parsed.select(*FIELD_TYPES.keys())


def bad_cells(types: Mapping[str, T.DataType] = FIELD_TYPES, strict_integers: bool = False) -> Column:
    """Names of the cells of a text row that are set but no value of their type, in column order."""
    wrong = []
    for name, dtype in types.items():
        if isinstance(dtype, T.StringType):
            continue
        text = blank_to_null_col(name)
        parsed = text.try_cast(dtype)
        if strict_integers and isinstance(dtype, (T.IntegerType, T.LongType)):
            parsed = F.when(text.rlike(_INTEGER_TEXT), parsed)
        wrong.append(F.when(text.isNotNull() & parsed.isNull(), F.lit(name)))
    return F.array_compact(F.array(*wrong))


def load_readings(text_df: DataFrame, malformed: str = "fail", strict_integers: bool = False,
                  observation: str = "load") -> DataFrame:
    """:func:`parse_readings` under a policy for malformed records, those with a bad cell.

    ``"fail"`` ends the load at the first one, ``"null"`` keeps the record without the bad cells,
    ``"skip"`` drops the record.  ``"skip"`` counts ``received`` and ``malformed`` under ``observation``, in
    ``observedMetrics`` of every progress event of a stream.
    """
    if malformed in ("fail", "null"):
        return parse_readings(text_df, malformed, strict_integers)
    if malformed != "skip":
        raise ValueError(f"malformed must be 'fail', 'null' or 'skip', got {malformed!r}")
    bad = F.size(bad_cells(strict_integers=strict_integers)) > 0
    marked = text_df.withColumn("__bad", bad).observe(
        observation, F.count(F.lit(1)).alias("received"), F.count_if("__bad").alias("malformed"))
    return parse_readings(marked.filter(~F.col("__bad")), "null", strict_integers)


def malformed_records(text_df: DataFrame, strict_integers: bool = False) -> DataFrame:
    """The text records with a bad cell, and ``bad_cells``: their names."""
    return text_df.withColumn("bad_cells", bad_cells(strict_integers=strict_integers)).filter(F.size("bad_cells") > 0)


def parsed_date(df: DataFrame, col: str = "data", out: str = "data_ts",
                fmt: str | None = None) -> DataFrame:
    """Optional: the ``data`` string as a timestamp (null when unparseable)."""
    ts = F.try_to_timestamp(F.col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(col))
    return df.withColumn(out, ts)


__all__ = ["blank_to_null", "typed_parse", "parse_readings", "bad_cells", "load_readings", "malformed_records", "parsed_date"]
