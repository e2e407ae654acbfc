"""Session partials merge associatively; state changes at range and batch edges."""

import random

import pytest
from pyspark.sql import functions as F

from brisa.operators import ordered
from brisa.operators.ordered import ActivityRule, OnOffRule, activity_events, merged_sessions, onoff_events, state_changes, time_of

KINDS = {"activity": ActivityRule, "onoff": OnOffRule}


def plain_sessions(rows, gap):
    """(entity, first, last, n) of interval partials by running maximum."""
    out = []
    for e, f, z, n in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2])):
        if out and out[-1][0] == e and f - out[-1][2] < gap:
            out[-1] = (e, out[-1][1], max(out[-1][2], z), out[-1][3] + n)
        else:
            out.append((e, f, z, n))
    return sorted(out, key=repr)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_interval_partials_of_any_shape(spark, seed):
    """Long partials cover events and partials of later ranges."""
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        f = rng.randrange(20_000)
        rows.append((rng.choice(["hot", "hot", "hot", "a", "b", None]), f, f + rng.choice([0, 0, 0, 5, 300, 6000 if rng.random() < 0.02 else 1]), rng.randrange(1, 4)))
    df = spark.createDataFrame(rows, "e string, first long, last long, n long")
    for ranges, gap in ((1, 50), (13, 50), (40, 7), (13, 0)):
        got = merged_sessions(df, "e", ["first", "last"], ActivityRule(gap), ranges)
        if gap:
            assert rows_of(got, "e", "first", "last", "n") == plain_sessions(rows, gap)
        else:
            assert got.agg(F.sum("n")).first()[0] == sum(r[3] for r in rows)


@pytest.mark.parametrize("kind", ["activity", "onoff"])
def test_parts_merge_to_the_whole(spark, kind):
    """Partials of the first part of the rows and the events of the rest give what all events give."""
    rng = random.Random(5)
    events = sorted((rng.randrange(5000), rng.choice("abh" * 2 + "hhhh"), rng.random() < 0.5) for _ in range(800))
    df = spark.createDataFrame([(e, t, on, i) for i, (t, e, on) in enumerate(events)], "e string, t long, on boolean, i long")
    rule = KINDS[kind](40)

    def partials(part):
        if kind == "activity":
            return activity_events(part, "e", F.col("t"), "i")
        return onoff_events(part, "e", F.col("t"), F.col("on"), F.col("i").alias("_tie"))

    whole = merged_sessions(partials(df), "e", ["first", "_tie"], rule, 9)
    for cut in (0, 300, 799):
        early = merged_sessions(partials(df.filter(F.col("i") < cut)), "e", ["first", "_tie"], rule, 5)
        both = early.withColumn("_tie", F.lit(-1).cast("long")).unionByName(partials(df.filter(F.col("i") >= cut)))
        assert rows_of(merged_sessions(both, "e", ["first", "_tie"], rule, 7), "e", *rule.columns) == rows_of(whole, "e", *rule.columns)


def test_small_arrow_batches_and_empty_input(spark):
    rows = [("a", i, "on" if i % 4 < 2 else "off") for i in range(50)] + [("b", i, None if i % 3 else "x") for i in range(9)]
    df = spark.createDataFrame(rows, "e string, t long, s string")
    want = rows_of(state_changes(df, "e", ["t"], "s", num_partitions=1), "e", "t", "prev_s", "s")
    assert [(r[1]) for r in want if r[0] == "a"] == sorted((i for i in range(1, 50) if (i % 4 < 2) != ((i - 1) % 4 < 2)), key=repr)
    assert not [r for r in want if r[0] == "b"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        assert rows_of(state_changes(df, "e", ["t"], "s", num_partitions=3), "e", "t", "prev_s", "s") == want
        one = merged_sessions(activity_events(df, "e", F.col("t"), "t"), "e", ["first", "_tie"], ActivityRule(2), 3)
        assert rows_of(one, "e", "first", "last", "n") == [("a", 0, 49, 50), ("b", 0, 8, 9)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    none = df.filter("false")
    assert state_changes(none, "e", ["t"], "s").count() == 0
    assert merged_sessions(activity_events(none, "e", F.col("t"), "t"), "e", ["first", "_tie"], ActivityRule(2)).count() == 0
    untimed = spark.createDataFrame([("a", None), ("a", 3)], "e string, t long")
    assert rows_of(merged_sessions(activity_events(untimed, "e", F.col("t"), "t"), "e", ["first", "_tie"], ActivityRule(2)), "first", "n") == [(3, 1)]


def test_time_of_keeps_wall_clocks(spark):
    from brisa.operators.sequence import micros_of

    df = spark.sql("SELECT explode(array(timestamp_ntz'1969-12-31 23:59:59.999999', timestamp_ntz'2024-02-29 12:00:00.000001', timestamp_ntz'9999-12-31 23:59:59')) AS t")
    kind = df.schema["t"].dataType
    assert df.filter(time_of(micros_of(F.col("t"), kind), kind) != F.col("t")).isEmpty()
    assert ordered.time_of(F.lit(5), kind) is not None
