"""Write the physical plans of the headline queries to docs/PLANS.md.

Usage: python scripts/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brisa.plans.catalog import QUERIES  # noqa: E402
from brisa.session import build_session  # noqa: E402

NOTES = {
    "clean_zero_readings": "One projection fused with the parquet scan: pruned ReadSchema, no exchange, no Python.",
    "clean_pipeline": "Scan -> codec (ArrowEvalPython) -> clean/route projection -> codec. The round-robin "
                      "exchange appears only because the test file has one row group (fewer partitions than "
                      "cores); at scale the scan is already wider and no exchange is planned.",
    "throughput_log": "The window counts (partial + final hash aggregate on the integer window start) "
                      "are written once; the plan shown reads them back, unions the spark.range grid "
                      "of empty windows and re-aggregates (rows = windows, not messages).",
    "state_transition": "Reads the materialized range-partitioned table; boundary rows (one per partition) "
                        "are broadcast - bounded by the partition count.",
    "hold_interval": "Same shape; final aggregate by (entity, hold_start) is partial + final.",
    "rate_ramp": "Closed-form emit second: a projection over the replayed rows, then a count per second.",
    "domain_filter": "The include-list filter runs in the scan stage.",
}


WRITTEN = {
    "csv_scan": "the exported CSV",
    "throughput_log": "window counts (one row per window)",
    "replay_cycle": "sequence-numbered table",
    "rate_ramp": "sequence-numbered table",
    "state_transition": "range-partitioned change candidates",
    "leave_state": "range-partitioned change candidates",
    "hold_interval": "range-partitioned rows with local interval starts",
    "hold_onoff": "change candidates, then trigger rows",
    "stream_clean": "input frames; the stream writes output frames",
    "stream_throughput": "input frames; the stream writes the window table",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/show_plans.py` on `{sf}` (`local[8]`, 8 shuffle partitions).", "",
           "## Summary of all registered queries", "",
           "Counts in the final plan of each query.  Stages written before it (parquet "
           "intermediates in the checkpoint folder, CSV or frame files) are listed "
           "separately: their own plans are one range exchange plus one hash exchange "
           "(ordered operators) or a scan plus an aggregate.  The round-robin exchange "
           "only appears because the test files have one row group each.", "",
           "| query | exchanges (hash / range / round-robin / single) | broadcasts | Python stages | written first |",
           "| --- | --- | --- | --- | --- |"]
    for name, fn in QUERIES.items():
        text = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        ex = [text.count(k) for k in ("Exchange hashpartitioning", "Exchange rangepartitioning",
                                      "Exchange RoundRobinPartitioning", "Exchange SinglePartition")]
        py = sum(text.count(k) for k in ("ArrowEvalPython", "FlatMapGroupsInPandas", "MapInArrow"))
        out.append(f"| {name} | {' / '.join(map(str, ex))} | {text.count('BroadcastExchange')} | {py} "
                   f"| {WRITTEN.get(name, '-')} |")
    out.append("")
    for name, note in NOTES.items():
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        head = plan.split("\n\n")[0]
        scans = [ln.strip() for ln in plan.splitlines()
                 if ln.startswith(("Location:", "PushedFilters:", "ReadSchema:"))]
        out += [f"## {name}", "", note, "", "```", head.strip(), "", *scans, "```", ""]
    spark.stop()
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
