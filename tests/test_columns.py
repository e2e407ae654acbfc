from brisa.functions.columns import blank_to_null_col, partition_index, rate_per_unit, round_half_up, truncate_int


def test_blank_rule_matches_java_trim(spark):
    cells = ["\x00", "\x1f \t\r\n", " ", " ", " x ", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    out = [r.c for r in df.select(blank_to_null_col("c").alias("c")).collect()]
    # code points <= U+0020 are blank; a no-break space or an em space is text
    assert out == [None, None, " ", " ", " x ", None, None]


def test_rate_rounding_and_truncation_at_edges(spark):
    df = spark.createDataFrame([(n,) for n in (0, 5, 9, 10, 15, 19)], "n long")
    rows = df.select(truncate_int(rate_per_unit("n", 10)).alias("t"),
                     round_half_up(rate_per_unit("n", 10)).alias("r")).collect()
    assert [(x.t, x.r) for x in rows] == [(0, 0), (0, 1), (0, 1), (1, 1), (1, 2), (1, 2)]


def test_partition_index_without_bound(spark):
    df = spark.createDataFrame([(None,), (100,), (-3,)], "c int")
    assert [r.p for r in df.select(partition_index("c").alias("p")).collect()] == [0, 99, 0]
