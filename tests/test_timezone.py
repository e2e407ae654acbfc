from pyspark.sql import functions as F

from brisa.operators.sequence import as_instant, ts_micros
from brisa.operators.throughput import throughput_log


def test_ntz_handling_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        # 1996-10-06 00:00 did not exist in Sao Paulo (DST started at midnight)
        df = spark.sql("select cast('1996-10-06 00:00:00' as timestamp_ntz) as ts")
        r = df.select(F.col("ts").cast("string").alias("s"), ts_micros(df, "ts").alias("us"),
                      F.unix_micros(as_instant(df, "ts")).alias("inst")).first()
        assert r.s == "1996-10-06 00:00:00"
        assert r.us == 844560000 * 1_000_000 and r.inst == r.us
        log = throughput_log(df, "ts", 10).first()
        assert log.timestamp_unix == 844560000 * 1000 + 10_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
