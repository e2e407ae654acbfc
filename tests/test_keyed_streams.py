"""E1-E3 on streams: state over micro-batches, restarts, failures, late events and a hot entity."""

import datetime as dt
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brisa.operators import events as ev
from brisa.streaming import keyed
from brisa.streaming.keyed import read_changes, read_hold_intervals, read_hold_onoff, start_hold_intervals, start_hold_onoff, start_leave_state, start_transitions
from brisa.streaming.pipelines import run_to_completion
from brisa.streaming.versions import Keyed, Versions, list_versions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "entity string, ts timestamp_ntz, id long, state string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed=3, n=400):
    """Events in time order; one entity has half of them, one is null, some states are null."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(40_000) for _ in range(n))
    return [(rng.choice(["hot"] * 4 + ["a", "b", "c", None]), T0 + dt.timedelta(seconds=t), i, rng.choice(["on", "off", "on", "off", "home", None]))
            for i, t in enumerate(times)]


class Stream:
    """Slices of events appended to a folder; the stream is started anew for each."""

    def __init__(self, spark, base, start):
        self.spark, self.base, self.start_query = spark, base, start
        self.out, self.kinds = f"{base}/out", spark.createDataFrame([], SCHEMA).schema

    def start(self, files=None):
        reader = self.spark.readStream.schema(SCHEMA)
        reader = reader.option("maxFilesPerTrigger", files) if files else reader
        return self.start_query(reader.parquet(f"{self.base}/in"), self.out, f"{self.base}/ck")

    def feed(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self, *slices):
        for part in slices:
            self.feed(part)
            run_to_completion(self.start())

    def holds(self, reader, seconds, include_open=True):
        return rows_of(reader(self.spark, self.out, self.kinds["entity"], self.kinds["ts"].dataType, seconds, include_open))


def thirds(rows):
    n = len(rows) // 3
    return rows[:n], rows[n:2 * n], rows[2 * n:]


def test_transitions_and_leaving_over_restarts(spark, scratch):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    s = Stream(spark, f"{scratch}/t", lambda d, out, ck: start_transitions(d, out, ck, "entity", "ts", "state", "id", from_state="off"))
    s.run(*thirds(rows))
    assert rows_of(read_changes(spark, s.out)) == rows_of(ev.transitions(df, "entity", "ts", "state", "id", from_state="off"))
    s = Stream(spark, f"{scratch}/l", lambda d, out, ck: start_leave_state(d, out, ck, "entity", "ts", "state", "id", zone="on", zone_is_home=True))
    s.run(*thirds(rows))
    assert rows_of(read_changes(spark, s.out)) == rows_of(ev.leave_state(df, "entity", "ts", "state", "id", zone="on", zone_is_home=True))


def test_hold_intervals_over_restarts(spark, scratch):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    s = Stream(spark, f"{scratch}/h", lambda d, out, ck: start_hold_intervals(d, out, ck, "entity", "ts", "id", 300))
    s.run(*thirds(rows))
    want = rows_of(ev.hold_intervals(df, "entity", "ts", "id", 300))
    assert s.holds(read_hold_intervals, 300) == want
    told, newest = s.holds(read_hold_intervals, 300, include_open=False), rows[-1][1]
    assert sorted(told, key=repr) == sorted((r for r in want if r[2] <= newest), key=repr) and 0 < len(told) < len(want)
    s = Stream(spark, f"{scratch}/o", lambda d, out, ck: start_hold_onoff(d, out, ck, "entity", "ts", "state", "id", 300))
    s.run(*thirds(rows))
    want = rows_of(ev.hold_intervals_onoff(df, "entity", "ts", "state", "id", 300))
    assert s.holds(read_hold_onoff, 300) == want
    told = s.holds(read_hold_onoff, 300, include_open=False)
    assert told and all(r[2] <= newest for r in told) and set(told) <= set(want)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 300), st.sampled_from(["on", "off", None])), min_size=1, max_size=25),
       gap=st.integers(0, 60), cut=st.integers(0, 300))
def test_streams_equal_batch_in_time_order(spark, rows, gap, cut, tmp_path_factory):
    data = sorted(((e, T0 + dt.timedelta(seconds=t), i, v) for i, (e, t, v) in enumerate(rows)), key=lambda r: r[1])
    parts = [p for p in ([r for r in data if (r[1] - T0).seconds < cut], [r for r in data if (r[1] - T0).seconds >= cut]) if p]
    df, base = spark.createDataFrame(data, SCHEMA), str(tmp_path_factory.mktemp("keyed"))
    s = Stream(spark, f"{base}/o", lambda d, out, ck: start_hold_onoff(d, out, ck, "entity", "ts", "state", "id", gap))
    s.run(*parts)
    assert s.holds(read_hold_onoff, gap) == rows_of(ev.hold_intervals_onoff(df, "entity", "ts", "state", "id", gap))
    s = Stream(spark, f"{base}/t", lambda d, out, ck: start_transitions(d, out, ck, "entity", "ts", "state", "id"))
    s.run(*parts)
    assert rows_of(read_changes(spark, s.out)) == rows_of(ev.transitions(df, "entity", "ts", "state", "id"))


@pytest.mark.parametrize("where", ["_remember", "_advance"])
def test_a_failed_epoch_is_done_again(spark, scratch, monkeypatch, where):
    """Fails after the epoch's results are written, before it is committed."""
    rows = made(seed=9, n=200)
    s = Stream(spark, scratch, lambda d, out, ck: start_hold_onoff(d, out, ck, "entity", "ts", "state", "id", 300))
    one, two, three = thirds(rows)
    s.run(one)
    real = getattr(keyed, where)

    def breaks(*args, **kwargs):
        real(*args, **kwargs)
        raise RuntimeError("the driver is lost here")

    monkeypatch.setattr(keyed, where, breaks)
    s.feed(two)
    with pytest.raises(Exception, match="lost here"):
        run_to_completion(s.start())
    monkeypatch.setattr(keyed, where, real)
    run_to_completion(s.start())
    s.run(three)
    want = ev.hold_intervals_onoff(spark.createDataFrame(rows, SCHEMA), "entity", "ts", "state", "id", 300)
    assert s.holds(read_hold_onoff, 300) == rows_of(want)


def test_late_events(spark, scratch):
    """Within the delay they join; later ones are an interval of their own, and none is lost."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    s = Stream(spark, scratch, lambda d, out, ck: start_hold_intervals(d, out, ck, "entity", "ts", "id", 100, delay_seconds=500))
    s.run([("a", at(0), 1, None), ("a", at(400), 2, None)],
          [("a", at(90), 3, None), ("a", at(180), 4, None), ("b", at(401), 5, None)],   # late by 310: joins the first
          [("b", at(2000), 6, None)],                                                  # closes all before 1500
          [("a", at(95), 7, None)])                                                    # too late
    got = [(e, (a - T0).seconds, (z - T0).seconds, n) for e, a, z, n in s.holds(read_hold_intervals, 100)]
    assert sorted(got) == [("a", 0, 280, 3), ("a", 95, 195, 1), ("a", 400, 500, 1), ("b", 401, 501, 1), ("b", 2000, 2100, 1)]
    assert sum(r[3] for r in got) == 7


def test_state_tables_stay_small(spark, scratch):
    """One base and the changes since; one version of the open sessions besides the newest."""
    table = Keyed(f"{scratch}/k", spark.createDataFrame([], "e string, v int").schema, fold_every=3, key="e")
    want = {}
    for epoch in range(14):
        table.fold(spark, epoch)
        assert rows_of(table.before(spark, epoch)) == sorted(want.items())
        new = {f"e{epoch % 4}": epoch, f"x{epoch}": 1}
        table.write(spark.createDataFrame(list(new.items()), "e string, v int"), epoch)
        table.write(spark.createDataFrame(list(new.items()), "e string, v int"), epoch)  # again
        want |= new
    assert len(list_versions(spark, table.path, "base=")) == 2 and len(list_versions(spark, table.path, "epoch=")) <= 6
    open_rows = Versions(f"{scratch}/v", "v int")
    for epoch in range(6):
        before = rows_of(open_rows.before(spark, epoch))
        assert before == ([(epoch - 1,)] if epoch else [])
        open_rows.write(spark.createDataFrame([(epoch,)], "v int"), epoch)
        assert rows_of(open_rows.before(spark, epoch)) == before  # a retry sees the same
        open_rows.forget(spark, epoch)
    assert list_versions(spark, open_rows.path, "v") == [4, 5] and rows_of(open_rows.newest(spark)) == [(5,)]
    os.makedirs(f"{scratch}/v/v6")  # an attempt without _SUCCESS is no version
    assert rows_of(open_rows.newest(spark)) == [(5,)]


def test_no_task_holds_an_entity(spark, scratch, monkeypatch):
    """The plans of an epoch shuffle by ranges, not by entity; intermediate tables go with the epoch."""
    from brisa.operators import sequence
    from brisa import session

    plans, write = [], sequence.materialize
    monkeypatch.setattr(sequence, "materialize", lambda df, name="stage": plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    s = Stream(spark, scratch, lambda d, out, ck: start_hold_onoff(d, out, ck, "entity", "ts", "state", "id", 300))
    before = list(session._SCRATCH)
    s.run(*thirds(made(n=90))[:2])
    assert len(plans) == 4 and all("rangepartitioning" in p and "FlatMapGroups" not in p and "InPandasWithState" not in p for p in plans)
    assert session._SCRATCH == before
    assert spark.read.parquet(f"{s.out}/closed").select(F.count("*")).first()[0] >= 0
