import math

from pyspark.sql import functions as F

from brisa.operators.clean import presence_flags, zero_to_null
from brisa.schema import CLEAN_COLS, READING_SCHEMA


def _row(**kw):
    base = {f.name: None for f in READING_SCHEMA.fields}
    base.update(objectid=1, data="2020-01-01")
    base.update(kw)
    return base


def test_zero_negative_zero_nan_and_untouched_columns(spark):
    rows = [
        _row(objectid=1, chuva=0.0, temp=0.0, pres=5.0),
        _row(objectid=2, pm10=-0.0),
        _row(objectid=3, o3=float("nan")),
        _row(objectid=4, lat=0.0, lon=0.0, codnum=0),
        _row(objectid=5, **{c: 1.5 for c in CLEAN_COLS}),
    ]
    df = spark.createDataFrame(rows, READING_SCHEMA)
    out = {r.objectid: r for r in zero_to_null(df).collect()}
    assert out[1].chuva is None and out[1].temp is None and out[1].pres == 5.0
    assert out[2].pm10 is None
    assert math.isnan(out[3].o3)
    assert out[4].lat == 0.0 and out[4].lon == 0.0 and out[4].codnum == 0
    assert all(getattr(out[5], c) == 1.5 for c in CLEAN_COLS)


def test_cleaning_plan_is_one_projection(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = zero_to_null(df.select("l_orderkey", F.col("l_discount").alias("chuva")), ["chuva"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "PythonUDF" not in text and "ArrowEvalPython" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in text


def test_presence_flags(spark):
    df = spark.createDataFrame([_row(objectid=1, chuva=0.0), _row(objectid=2, chuva=2.0)], READING_SCHEMA)
    out = {r.objectid: r for r in presence_flags(zero_to_null(df), ["chuva", "temp"], keep=["objectid"]).collect()}
    assert out[1].has_chuva is False and out[2].has_chuva is True
    assert out[1].has_temp is False
