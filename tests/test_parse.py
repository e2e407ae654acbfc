import os

import pytest
from pyspark.sql import types as T

from brisa.operators.parse import blank_to_null, parse_readings, typed_parse
from brisa.sources.csv import csv_scan


def test_blank_variants(spark):
    df = spark.createDataFrame([("",), ("   ",), ("\t",), (None,), (" A ",), ("x",)], "c string")
    assert [r.c for r in blank_to_null(df, ["c"]).collect()] == [None, None, None, None, " A ", "x"]


def test_typed_parse_fail_and_tolerant(spark):
    df = spark.createDataFrame([("1", "abc"), ("2", "3.5")], "a string, b string")
    tol = typed_parse(df, {"a": T.LongType(), "b": T.DoubleType()}, errors="null").collect()
    assert [(r.a, r.b) for r in tol] == [(1, None), (2, 3.5)]
    with pytest.raises(Exception, match="cannot parse b|CAST_INVALID_INPUT"):
        typed_parse(df, {"b": T.DoubleType()}, errors="fail").collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="cannot parse b"):
            typed_parse(df, {"b": T.DoubleType()}, errors="fail").collect()
        assert typed_parse(df.filter("a = '2'"), {"b": T.DoubleType()}, errors="fail").first().b == 3.5
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_strict_integers_reject_padding(spark):
    df = spark.createDataFrame([(" 5",), ("+7",)], "a string")
    lenient = typed_parse(df, {"a": T.IntegerType()}, errors="null").collect()
    strict = typed_parse(df, {"a": T.IntegerType()}, errors="null", strict_integers=True).collect()
    assert [r.a for r in lenient] == [5, 7]
    assert [r.a for r in strict] == [None, 7]
    with pytest.raises(Exception, match="cannot parse a"):
        typed_parse(df, {"a": T.IntegerType()}, errors="fail", strict_integers=True).collect()


CSV = "\n".join([
    ",".join(["h"] * 26),
    "1,d1,3,\"A, B\"," + ",".join(["1.5"] * 22),       # full, quoted comma
    "2,d2,0, A ,0,0.0" + "," * 20,                      # zeros, padded station, zero station
    "3,d3,,x,,\"   \",\t" + "," * 19,                   # blanks of several kinds, absent station
    "4,d4,8,s,1",                                       # short row (5 columns)
    "5,d5,-5,s," + ",".join(["2"] * 22) + ",extra1,extra2",  # long row
    ",,-2147483648,s" + "," * 22,                       # absent id and date, int minimum
    "",                                                 # blank line: skipped
]) + "\n"


def _write(path, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.csv"), "w") as f:
        f.write(text)
    return path


def test_positional_csv_scan(spark, scratch):
    path = _write(os.path.join(scratch, "in"), CSV)
    rows = {r.objectid: r for r in parse_readings(csv_scan(spark, path)).collect()}
    assert len(rows) == 6
    assert rows[1].estacao == "A, B" and rows[1].y_utm_sirgas2000 == 1.5
    assert rows[2].codnum == 0 and rows[2].estacao == " A " and rows[2].chuva == 0.0
    assert rows[3].codnum is None and rows[3].chuva is None and rows[3].pres is None and rows[3].rs is None
    assert rows[4].chuva == 1.0 and rows[4].pres is None and rows[4].y_utm_sirgas2000 is None
    assert rows[5].y_utm_sirgas2000 == 2.0 and rows[5].codnum == -5
    assert rows[0].data == "" and rows[0].codnum == -2147483648


def test_bad_number_strict_fails_tolerant_nulls(spark, scratch):
    text = ",".join(["h"] * 26) + "\n" + "1,d,1,s,1,2,3,abc\n"
    path = _write(os.path.join(scratch, "bad"), text)
    with pytest.raises(Exception, match="cannot parse temp|CAST_INVALID_INPUT"):
        parse_readings(csv_scan(spark, path), errors="fail").collect()
    assert parse_readings(csv_scan(spark, path), errors="null").collect()[0].temp is None


def test_header_only_is_empty(spark, scratch):
    path = _write(os.path.join(scratch, "hdr"), ",".join(["h"] * 26) + "\n")
    assert parse_readings(csv_scan(spark, path)).count() == 0
