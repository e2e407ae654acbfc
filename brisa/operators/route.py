"""Routing readings to output partitions by station number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.functions.columns import partition_index


def route(df: DataFrame, station_col: str = "codnum", num_partitions: int | None = None,
          overflow: str = "error", out: str = "partition", default: int = 1) -> DataFrame:
    """Add the explicit output partition: ``max(0, coalesce(station, 1) - 1)``.

    A pure projection - no data moves.  Sinks that understand partitions (Kafka
    ``partition`` column, ``partitionBy`` on files) place rows from it.
    """
    return df.withColumn(out, partition_index(station_col, default, overflow, num_partitions))


def place_by_partition(df: DataFrame, num_partitions: int, col: str = "partition") -> DataFrame:
    """Physically place each row in the Spark partition named by ``col``.

    Uses ``repartitionById`` (a direct partition-id shuffle).  It silently wraps
    out-of-range ids, so validate with ``route(..., overflow=...)`` first.  The
    placement is the point, so a station holding a third of the readings puts a
    third of them in one partition; prefer sink-side placement (the Kafka
    ``partition`` column or ``partitionBy`` on files), which needs no shuffle and
    writes each station's rows from every task in parallel.
    """
    return df.repartitionById(num_partitions, F.col(col))


def place_balanced(df: DataFrame, num_tasks: int | None = None, col: str = "partition",
                   spread_by: Sequence[str] | None = None) -> DataFrame:
    """Deal rows to tasks by ``col``, a hot partition to several of them in proportion to its rows.

    No task holds rows of two partitions, and none much more than ``1 / num_tasks`` of all rows (default:
    ``spark.sql.shuffle.partitions``) or than the usual partition, so a station with half of the readings is written by half of the
    tasks, as that many files of its folder.  Rows of one partition are dealt by a hash of
    ``spread_by`` (default: all columns), so a recomputed task deals them the same; equal rows stay
    together.  One row per partition reaches the driver.
    """
    tasks = int(num_tasks or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = {r[col]: r["n"] for r in df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, sizes = sum(counts.values()), sorted(counts.values())
    share = max(1, -(-total // tasks))
    if sizes:  # not far above the usual partition either, but at most four times the tasks
        share = max(min(share, 3 * sizes[len(sizes) // 2] // 2), -(-total // (4 * max(tasks, len(sizes)))), 1)
    first, slices = 0, []
    for p in sorted(counts, key=lambda p: (p is not None, p)):
        n = -(-counts[p] // share)
        slices.append((p, first, n))
        first += n
    at = F.xxhash64(*(spread_by or df.columns))
    task = F.lit(0)
    for p, a, n in slices:
        task = F.when(F.col(col).eqNullSafe(F.lit(p)), F.lit(a) + F.pmod(at, F.lit(n))).otherwise(task)
    return df.repartitionById(max(1, first), task.cast("int"))


def spread(df: DataFrame, num_partitions: int) -> DataFrame:
    """D3: keyless round-robin spread (no key, no partition column)."""
    return df.repartition(num_partitions)
