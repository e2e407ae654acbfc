import pytest

from brisa.operators.route import place_by_partition, route


def test_partition_rule(spark):
    df = spark.createDataFrame([(0,), (None,), (8,), (-5,), (-2147483648,), (1,)], "codnum int")
    out = [r.partition for r in route(df, num_partitions=12).collect()]
    assert out == [0, 0, 7, 0, 0, 0]


def test_overflow_error_and_modulo(spark):
    df = spark.createDataFrame([(13,)], "codnum int")
    with pytest.raises(Exception, match="out of range"):
        route(df, num_partitions=12, overflow="error").collect()
    assert route(df, num_partitions=8, overflow="modulo").first().partition == 4


def test_place_by_partition(spark):
    df = route(spark.createDataFrame([(i % 5 + 1,) for i in range(50)], "codnum int"), num_partitions=5)
    placed = place_by_partition(df, 5).rdd.mapPartitionsWithIndex(
        lambda idx, it: [(idx, r.partition) for r in it]).collect()
    assert all(idx == p for idx, p in placed)
