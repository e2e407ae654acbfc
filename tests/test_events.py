import datetime as dt
import random

import pandas as pd

from brisa.operators import events as ev

T0 = dt.datetime(2024, 1, 1)


def _df(spark, rows):
    return spark.createDataFrame(rows, "entity string, ts timestamp_ntz, id long, state string")


def test_transition_cases(spark):
    rows = [
        ("binary_sensor.m", T0, 1, "off"),
        ("binary_sensor.m", T0 + dt.timedelta(seconds=5), 2, "on"),
        ("binary_sensor.m", T0 + dt.timedelta(seconds=6), 3, "on"),      # repeat: no transition
        ("binary_sensor.m", T0 + dt.timedelta(seconds=9), 4, "off"),
        ("binary_sensor.n", T0, 5, "on"),                                 # first event: none
    ]
    out = ev.transitions(_df(spark, rows), "entity", "ts", "state", "id").collect()
    assert sorted((r.id, r.from_state, r.to_state) for r in out) == [(2, "off", "on"), (4, "on", "off")]
    on = ev.transitions(_df(spark, rows), "entity", "ts", "state", "id", "off", "on").collect()
    assert [r.id for r in on] == [2]


def test_leave_zone_and_home(spark):
    rows = [("person.a", T0, 1, "home"), ("person.a", T0 + dt.timedelta(minutes=1), 2, "not_home"),
            ("person.a", T0 + dt.timedelta(minutes=2), 3, "Work"),
            ("person.a", T0 + dt.timedelta(minutes=3), 4, "not_home")]
    home = ev.leave_state(_df(spark, rows), "entity", "ts", "state", "id", zone="Home", zone_is_home=True)
    assert [r.id for r in home.collect()] == [2]
    work = ev.leave_state(_df(spark, rows), "entity", "ts", "state", "id", zone="Work")
    assert [r.id for r in work.collect()] == [4]


def test_domain_filter(spark):
    df = spark.createDataFrame([("sensor.t",), ("switch.a",), ("light.b",)], "entity_id string")
    assert sorted(r.entity_id for r in ev.domain_filter(df).collect()) == ["sensor.t", "switch.a"]


def test_hold_retrigger_inside_delay_extends(spark):
    rows = [("m", T0, 1, "on"), ("m", T0 + dt.timedelta(seconds=100), 2, "on"),   # inside 120 s
            ("m", T0 + dt.timedelta(seconds=220), 3, "on"),                       # exactly 120 s: new
            ("m", T0 + dt.timedelta(seconds=1000), 4, "on")]
    out = sorted((r.hold_start, r.hold_end, r.n_events)
                 for r in ev.hold_intervals(_df(spark, rows), "entity", "ts", "id", 120).collect())
    s = dt.timedelta(seconds=1)
    assert out == [(T0, T0 + 220 * s, 2), (T0 + 220 * s, T0 + 340 * s, 1), (T0 + 1000 * s, T0 + 1120 * s, 1)]


def _hot_rows(n=6000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ent = "hot" if rnd.random() < 0.5 else f"e{rnd.randrange(40)}"
        rows.append((ent, T0 + dt.timedelta(seconds=rnd.randrange(200_000)), i, rnd.choice(["on", "off", "x"])))
    return rows


def test_hot_entity_matches_brute_force(spark):
    rows = _hot_rows()
    df = _df(spark, rows)
    pdf = pd.DataFrame(rows, columns=["entity", "ts", "id", "state"]).sort_values(["entity", "ts", "id"])
    pdf["prev"] = pdf.groupby("entity")["state"].shift()
    exp_tr = sorted(pdf[(pdf.prev.notna()) & (pdf.prev != pdf.state)][["id", "prev", "state"]]
                    .itertuples(index=False, name=None))
    got_tr = sorted((r.id, r.from_state, r.to_state)
                    for r in ev.transitions(df, "entity", "ts", "state", "id", num_partitions=16).collect())
    assert got_tr == exp_tr

    gap = dt.timedelta(seconds=600)
    pdf["pts"] = pdf.groupby("entity")["ts"].shift()
    pdf["new"] = pdf.pts.isna() | ((pdf.ts - pdf.pts) >= gap)
    pdf["sid"] = pdf.groupby("entity")["new"].cumsum()
    exp = pdf.groupby(["entity", "sid"]).agg(s=("ts", "min"), e=("ts", "max"), n=("id", "count"))
    exp_h = sorted((ent, s.to_pydatetime(), (e + gap).to_pydatetime(), n)
                   for (ent, _), s, e, n in exp[["s", "e", "n"]].itertuples(name=None))
    got_h = sorted((r.entity, r.hold_start, r.hold_end, r.n_events)
                   for r in ev.hold_intervals(df, "entity", "ts", "id", 600, num_partitions=16).collect())
    assert got_h == exp_h


def test_motion_light_onoff_rule(spark):
    s = dt.timedelta(seconds=1)
    rows = [
        ("m", T0, 1, "off"),
        ("m", T0 + 10 * s, 2, "on"),        # off -> on: light on at 10
        ("m", T0 + 20 * s, 3, "on"),        # repeat: nothing
        ("m", T0 + 30 * s, 4, "off"),       # on -> off: wait 120 s
        ("m", T0 + 100 * s, 5, "on"),       # inside the delay: restart, same interval
        ("m", T0 + 110 * s, 6, "off"),      # off at 110 -> light off at 230
        ("m", T0 + 500 * s, 7, "on"),       # outside the delay: new interval, still on at end
        ("n", T0, 8, "on"),                 # first event: no transition
        ("n", T0 + 5 * s, 9, "off"),        # stop before any start
        ("n", T0 + 50 * s, 10, "on"),       # start within the delay of that stop: lights up
        ("n", T0 + 60 * s, 11, "off"),
    ]
    out = sorted((r.entity, r.hold_start, r.hold_end, r.n_triggers) for r in
                 ev.hold_intervals_onoff(_df(spark, rows), "entity", "ts", "state", "id", 120).collect())
    assert out == [("m", T0 + 10 * s, T0 + 230 * s, 2), ("m", T0 + 500 * s, None, 1),
                   ("n", T0 + 50 * s, T0 + 180 * s, 1)]


def test_null_entity_rows_form_one_group(spark):
    rows = [(None, T0, 1, "a"), (None, T0 + dt.timedelta(seconds=1), 2, "b"),
            ("x", T0, 3, "a"), ("x", T0 + dt.timedelta(seconds=2), 4, "a")]
    out = ev.transitions(_df(spark, rows), "entity", "ts", "state", "id", num_partitions=3).collect()
    assert [(r.entity, r.id, r.from_state, r.to_state) for r in out] == [(None, 2, "a", "b")]


def test_sparse_changes_across_many_partitions(spark):
    rnd = random.Random(11)
    rows, state = [], "off"
    for i in range(5000):
        if rnd.random() < 0.004:  # long runs: most partitions hold no change
            state = "on" if state == "off" else "off"
        ent = "hot" if i % 10 else f"e{i % 7}"
        rows.append((ent, T0 + dt.timedelta(seconds=i), i, state if ent == "hot" else rnd.choice("ab")))
    pdf = pd.DataFrame(rows, columns=["entity", "ts", "id", "state"]).sort_values(["entity", "ts", "id"])
    pdf["prev"] = pdf.groupby("entity")["state"].shift()
    exp = sorted(pdf[(pdf.prev.notna()) & (pdf.prev != pdf.state)][["id", "prev", "state"]]
                 .itertuples(index=False, name=None))
    got = sorted((r.id, r.from_state, r.to_state) for r in
                 ev.transitions(_df(spark, rows), "entity", "ts", "state", "id", num_partitions=24).collect())
    assert got == exp
