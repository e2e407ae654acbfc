"""Keeping CPU-heavy stages as wide as the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread rows round-robin when a CPU-heavy stage (Python codec, text
    formatting for a file sink) would run on fewer partitions than the cluster
    has cores, e.g. after scanning a file with a single row group.

    At scale the scan already yields far more partitions than cores and this is a
    no-op; only the planned partition count is inspected (no job runs).
    Streaming plans are left alone: their sources split micro-batches.
    """
    if df.isStreaming:
        return df
    try:
        # A plan with exchanges is adaptive: its rows are already spread by the
        # shuffle, and asking for its partitions would run the shuffle stages.
        if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return df
        n = df.rdd.getNumPartitions()
    except Exception:  # no JVM handle (e.g. Spark Connect): leave the plan alone
        return df
    target = int(min_partitions or df.sparkSession.sparkContext.defaultParallelism)
    return df if n >= target else df.repartition(target)
