import pytest
from pyspark.sql import functions as F

from brisa.operators.replay import replay, with_ramp_second
from brisa.operators.sequence import with_sequence


def _brute_ramp(n, a, d, k):
    out, t, sent = [], 0, 0
    while sent < n:
        rate = a + d * (t // k)
        for _ in range(rate):
            if sent == n:
                break
            out.append(t)
            sent += 1
        t += 1
    return out


@pytest.mark.parametrize("a,d,k", [(3, 2, 2), (10000, 1000, 5), (7, 0, 3), (1, 1, 1)])
def test_ramp_closed_form_matches_simulation(spark, a, d, k):
    n = 200_000 if a >= 1000 else 3000
    df = spark.range(n).withColumnRenamed("id", "seq")
    got = [r.emit_second for r in with_ramp_second(df, "seq", "emit_second", a, d, k).orderBy("seq").collect()]
    assert got == _brute_ramp(n, a, d, k)


def test_sequence_is_contiguous_in_order(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = with_sequence(df, ["k"], "i", num_partitions=5).collect()
    assert sorted((r.k, r.i) for r in rows) == [(k, k) for k in range(5000)]


def test_replay_cycles_and_total(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    out = replay(df, ["x"], total=25).collect()
    assert sorted(r.seq for r in out) == list(range(25))
    assert all(r.seq == r.cycle * 10 + r.x for r in out)
    assert replay(df, ["x"], cycles=2).count() == 20


def test_replay_empty_input(spark):
    df = spark.range(0).withColumnRenamed("id", "x")
    assert replay(df, ["x"], total=100).count() == 0


def test_sender_modes(spark):
    from brisa.operators.replay import with_emit_second

    df = spark.range(60000).withColumnRenamed("id", "seq")
    fixed = {r.emit_second: r.n for r in with_emit_second(df, "fixed", 20000)
             .groupBy("emit_second").agg(F.count("*").alias("n")).collect()}
    assert fixed == {0: 20000, 1: 20000, 2: 20000}
    stress = with_emit_second(df, "stress").agg(F.max("emit_second")).first()[0]
    assert stress == 5  # 5 s at 10 000/s, then 11 000/s
    with pytest.raises(ValueError):
        with_emit_second(df, "burst")


def test_replay_continues_from_a_later_pass(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    out = replay(df, ["x"], total=15, start_cycle=3).collect()
    assert sorted(r.seq for r in out) == list(range(30, 45))
    assert {r.cycle for r in out} == {3, 4}


def test_replay_of_nothing(spark):
    df = spark.range(5).withColumnRenamed("id", "x")
    assert replay(df, ["x"], total=0).count() == 0
    assert replay(df, ["x"], cycles=0).count() == 0
