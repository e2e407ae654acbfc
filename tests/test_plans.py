from pyspark.sql import functions as F

from brisa.operators import sequence
from brisa.plans.pipeline import clean_job, load_frames
from brisa.schema import READING_FIELDS


def _wide_readings(spark, n_parts):
    cols = []
    for name, dtype, _ in READING_FIELDS:
        if name == "objectid":
            cols.append(F.col("id").alias(name))
        elif name == "codnum":
            cols.append((F.col("id") % 9).cast("int").alias(name))
        elif dtype.simpleString() == "string":
            cols.append(F.lit("s").alias(name))
        else:
            cols.append((F.col("id") % 3).cast("double").alias(name))
    return spark.range(0, 4000, numPartitions=n_parts).select(*cols)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_job_plans_no_exchange_when_input_is_wide(spark):
    wide = spark.sparkContext.defaultParallelism + 4
    plan = _plan(clean_job(load_frames(_wide_readings(spark, wide))))
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 2  # loader encode + (decode, encode) of the job


def test_narrow_input_is_spread_for_the_codec(spark):
    plan = _plan(load_frames(_wide_readings(spark, 1)))
    assert "RoundRobinPartitioning" in plan


def test_range_partition_count_follows_size(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    assert sequence._num_parts(df, None) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(sequence, "TARGET_PARTITION_BYTES", 64 * 1024)
    assert sequence._num_parts(df, None) > 8
    assert sequence._num_parts(df, 3) == 3


def test_permissive_decode_runs_the_codec_once(spark):
    from brisa.operators.codec import decode, encode

    frames = encode(_wide_readings(spark, 1)).select(
        F.when(F.col("value").isNull(), F.lit(b"\xff")).otherwise(F.col("value")).alias("value"))
    plan = _plan(decode(frames, mode="permissive"))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1


def test_domain_filter_reaches_the_scan(spark, scratch):
    import os

    from brisa.operators.events import domain_filter

    path = os.path.join(scratch, "entities")
    spark.createDataFrame([("sensor.a",), ("sensor",), ("sensorx.a",), ("switch.k",), ("light.b",)],
                          "entity_id string").write.parquet(path)
    df = domain_filter(spark.read.parquet(path))
    assert "StringStartsWith(entity_id,sensor.)" in _plan(df)
    assert sorted(r.entity_id for r in df.collect()) == ["sensor", "sensor.a", "switch.k"]


def test_windows_over_ranges_need_no_hash_exchange(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(sequence, "materialize", lambda df, name="stage": plans.append(_plan(df)) or df)
    df = spark.range(100).selectExpr("id % 3 AS e", "timestamp_seconds(id) AS t", "cast(id % 5 as string) AS s", "id AS k")
    sequence.with_previous(df, "e", ["t", "k"], ["s"], num_partitions=64)
    assert len(plans) == 1 and "hashpartitioning(_pid" not in plans[0] and ", 64)" in plans[0]


def test_ordered_operators_shuffle_once(spark, monkeypatch):
    from brisa.operators import events

    plans = []
    monkeypatch.setattr(sequence, "materialize", lambda df, name="stage": plans.append(_plan(df)) or df)
    df = spark.range(100).selectExpr("id % 3 AS e", "timestamp_seconds(id) AS t", "cast(id % 5 as string) AS s", "id AS k")
    events.transitions(df, "e", "t", "s", "k", from_state="1", num_partitions=64)
    events.leave_state(df, "e", "t", "s", "k", zone="2", num_partitions=64)
    events.hold_intervals(df, "e", "t", "k", 60, num_partitions=64)
    assert len(plans) == 3
    for plan in plans:  # of what is written: one range exchange, no window, no hash exchange
        assert plan.count("Exchange rangepartitioning") == 1 and ", 64)" in plan
        assert "hashpartitioning" not in plan and "Window" not in plan
    # the trigger is applied before the write
    assert "s#" in plans[0] and "= 1)" in plans[0] and "= 2)" in plans[1]


def test_written_rows_follow_changes_and_sessions(spark, monkeypatch):
    """Edges and results are written, not the events: two rows per range at most besides them."""
    from brisa.operators import events

    written, write = [], sequence.materialize

    def counted(df, name="stage"):
        out = write(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(sequence, "materialize", counted)
    ranges = 16
    # one entity holds half of 40 000 events; an event each second, a pause of 50 minutes after every 1000
    df = spark.range(40_000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('e', id % 7) END AS e",
        "timestamp_seconds(id + 3000 * (id div 1000)) AS t", "CASE WHEN id % 5000 < 2500 THEN 'on' ELSE 'off' END AS s", "id AS k")
    sessions = events.hold_intervals(df, "e", "t", "k", 120, num_partitions=ranges).count()
    assert sessions == 40 * 8 and written[0] <= sessions + 2 * ranges
    changes = events.transitions(df, "e", "t", "s", "k", num_partitions=ranges).count()
    assert changes and written[1] <= changes + 2 * ranges
    # a session over all ranges
    assert [(r.n_events) for r in events.hold_intervals(df.filter("e = 'hot'"), "e", "t", "k", 3600, num_partitions=ranges).collect()] == [20_000]
    assert written[2] <= 1 + 2 * ranges
