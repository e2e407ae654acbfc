"""How the driver's tables stand in for sensor data.

``lineitem`` rows become readings with all 26 fields set: the line number is the
station (line 7 has none, lines 5 and 6 have stations below 1), the measurements hold
true zeros, negative zeros, negative values and absent ones, and the coordinates zeros
that stay.  ``events`` rows become timed readings and state changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.schema import READING_FIELDS
from brisa.sources.tables import table

# reading column -> Spark expression; unlisted columns are null.  The oracles spell out their own.
_LINEITEM_MAP = {
    "objectid": "cast(l_orderkey * 10 + l_linenumber as bigint)",
    # a TIMESTAMP_NTZ cast to text is zone-free (date_format would go through the
    # session time zone and shift wall clocks that fall in a DST gap)
    "data": "cast(l_shipdate as string)",
    "codnum": "CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN 0 WHEN 5 THEN -5 ELSE l_linenumber END",
    "estacao": "concat(l_returnflag, l_linestatus)",
    "chuva": "l_discount",
    "pres": "l_tax",
    "rs": "l_quantity",
    "temp": "l_extendedprice",
    "ur": "l_quantity - 25",
    "dir_vento": "CASE WHEN l_tax = 0 THEN double('-0.0') ELSE l_tax END",
    "vel_vento": "nullif(l_discount, double('0.05'))",
    "so2": "double(l_linenumber - 1)",
    "no2": "double(l_linenumber - 4)",
    "hcnm": "CASE WHEN l_returnflag = 'R' THEN double(0) ELSE l_quantity END",
    "hct": "CASE WHEN l_linestatus = 'F' THEN l_discount END",
    "ch4": "-l_tax",
    "co": "nullif(l_tax, double('0.08'))",
    "no": "l_quantity - 1",
    "nox": "CASE WHEN l_returnflag = 'A' THEN double(0) ELSE l_extendedprice END",
    "o3": "CASE WHEN l_tax = 0 THEN l_discount ELSE l_quantity END",
    "pm10": "double(l_suppkey) - 1",
    "pm2_5": "-l_discount",
    "lat": "l_discount",
    "lon": "-l_tax",
    "x_utm_sirgas2000": "CASE WHEN l_discount = 0 THEN double('-0.0') ELSE l_extendedprice END",
    "y_utm_sirgas2000": "CASE WHEN l_linestatus = 'O' THEN double(l_partkey) END",
}

_EVENTS_MAP = {
    "objectid": "event_id",
    "data": "cast(ts as string)",
    "codnum": "cast(user_id as int)",
    "estacao": "event_type",
    "chuva": "value",
}


def _select_exprs(mapping: dict[str, str]) -> list[str]:
    return [f"{mapping.get(name, f'cast(null as {dtype.simpleString()})')} AS {name}" for name, dtype, _ in READING_FIELDS]


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_select_exprs(_LINEITEM_MAP))


def events_readings(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(keep or []), *_select_exprs(_EVENTS_MAP))


def events_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as state changes: entity = user, state = event type."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), "ts", "event_id", F.col("event_type").alias("state"))
