"""Order-dependent helpers that stay balanced when one key is hot.

A window ``partitionBy(entity).orderBy(ts)`` sends a whole entity to one task;
if one entity holds a third of all rows that task holds a third of the data.
Instead we range-partition on the *full* sort key ``(entity, ts, tiebreak)``:
the range partitioner samples the composite key, so a hot entity is split over
many partitions.  Per-partition windows compute the local answer, and the only
cross-partition state - the last row of each partition - is a table with one row
per partition (size bounded by the partition count, so broadcasting it is safe).

The partitioned intermediate is written once (a parquet table in the shared
checkpoint folder) because both the rows and the boundary table read it.

Used by: contiguous sequence numbers (replay) and previous-row lookups; state
changes and sessions take the ranges and reduce them in :mod:`brisa.operators.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brisa.session import shared_path

PID = "_pid"


# Target bytes per range partition: the count follows the data.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def _estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate, bounded by the sum of the plan's inputs; None if an input's size is unknown.

    Above joins the root estimate can be wildly inflated; the operators here
    (projections, filters, joins to bounded tables) never emit more bytes than
    they read, so the leaves give an upper bound.  No job runs.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    root = int(str(plan.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    inputs = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    unknown = int(df._jdf.sparkSession().sessionState().conf().defaultSizeInBytes())
    return None if inputs >= unknown else min(root, inputs)


def _num_parts(df: DataFrame, num_partitions: int | None) -> int:
    """Explicit count, else enough partitions for ~TARGET_PARTITION_BYTES each,
    never fewer than ``spark.sql.shuffle.partitions`` (which is used as it is for inputs
    whose size Spark does not know)."""
    if num_partitions:
        return int(num_partitions)
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = _estimated_bytes(df)
    except Exception:  # no JVM handle (e.g. Spark Connect): keep the configured count
        return floor
    return floor if size is None else max(floor, -(-size // TARGET_PARTITION_BYTES))


def range_partitioned(df: DataFrame, keys: Sequence[str],
                      num_partitions: int | None = None, for_windows: bool = False) -> DataFrame:
    """Range-partition on ``keys`` and tag each row with its partition id.

    ``for_windows`` sends every range to the task of its own number, so windows over
    the tag run on as many tasks as there are ranges instead of being hashed together.

    With an explicit count AQE keeps the partitions as planned, so each tag is
    exactly one contiguous key range of the global order.
    """
    n = _num_parts(df, num_partitions)
    ranges = df.repartitionByRange(n, *[F.col(k) for k in keys]).withColumn(PID, F.spark_partition_id())
    return ranges.repartitionById(n, F.col(PID)) if for_windows else ranges


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and
    read it back, cutting the lineage.

    Used where a partitioned intermediate has two consumers (the rows and their
    per-partition boundary table): without it each consumer would re-run the
    range shuffle, since Spark did not reuse that exchange here.  Parquet keeps
    it columnar and compressed, lets the rare boundary rows be found with
    row-group statistics, and survives the loss of an executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def boundary_window() -> Window:
    # Over the per-partition boundary table: one row per partition, so this
    # single-task window is bounded by the partition count, never by the data.
    return Window.orderBy(PID)


def local_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(PID).orderBy(*keys)


def is_last_in_partition(keys: Sequence[str]) -> Column:
    return F.lead(F.lit(1)).over(local_window(keys)).isNull()


def with_sequence(df: DataFrame, order_cols: Sequence[str], out: str = "_idx",
                  num_partitions: int | None = None, with_count: bool = False):
    """Add a contiguous 0-based position in the global order of ``order_cols``.

    ``order_cols`` should be unique per row (append a tiebreak).  Positions are
    fixed by materializing once, so recomputation cannot renumber rows.  With
    ``with_count`` also return the row count (read from the per-partition
    counts, not from another scan of the input).
    """
    parts = range_partitioned(df, order_cols, num_partitions)
    parts = materialize(parts.sortWithinPartitions(*order_cols)
                        .withColumn("_mid", F.monotonically_increasing_id()))
    counts = parts.groupBy(PID).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        PID,
        F.coalesce(F.sum("_n").over(boundary_window().rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    # monotonically_increasing_id = (partition id << 33) + row position in partition
    local = F.col("_mid") - F.shiftleft(F.col(PID).cast("long"), 33)
    indexed = (parts.join(F.broadcast(offsets), PID, "inner")
               .withColumn(out, F.col("_off") + local)
               .drop(PID, "_mid", "_off"))
    if not with_count:
        return indexed
    return indexed, int(parts.count())


def with_previous(df: DataFrame, group: str, order_cols: Sequence[str], cols: Sequence[str],
                  prefix: str = "prev_", num_partitions: int | None = None) -> DataFrame:
    """Add ``prev_<c>``: the value of ``c`` on the previous row of the same group.

    Equivalent to ``lag(c) over (partition by group order by order_cols)`` but
    without routing a whole group through one task.  Where only changes matter,
    :func:`brisa.operators.ordered.state_changes` writes less.
    """
    keys = [group, *order_cols]
    w = local_window(keys)
    local = range_partitioned(df, keys, num_partitions, for_windows=True).withColumn(
        "_rn", F.row_number().over(w)).withColumn("_pg", F.lag(group).over(w)).withColumn(
        "_last", is_last_in_partition(keys))
    for c in cols:
        local = local.withColumn(f"_pl_{c}", F.lag(c).over(w))
    local = materialize(local)
    carry = (local.filter("_last")
             .select(PID, F.struct(F.col(group).alias("g"), *[F.col(c).alias(c) for c in cols]).alias("_row"))
             .select(PID, F.lag("_row").over(boundary_window()).alias("_carry")))
    joined = local.join(F.broadcast(carry), PID, "left")
    first_in_part = F.col("_rn") == 1
    # null-safe: like SQL's PARTITION BY, rows with a null group form one group
    same_as_carry = F.col("_carry").isNotNull() & F.col("_carry.g").eqNullSafe(F.col(group))
    same_as_local = F.col("_pg").eqNullSafe(F.col(group))
    out = joined.withColumns({
        prefix + c: F.when(first_in_part, F.when(same_as_carry, F.col(f"_carry.{c}")))
                     .otherwise(F.when(same_as_local, F.col(f"_pl_{c}")))
        for c in cols
    })
    return out.drop("_rn", "_pg", "_last", "_carry", PID, *[f"_pl_{c}" for c in cols])


def micros_of(c: Column, dtype) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column.

    A TIMESTAMP_NTZ wall clock is read as UTC whatever the session time zone is:
    it is rebuilt from its fields with an explicit UTC ``make_timestamp`` (a cast
    or ``timestamp_diff`` would pass through the session zone and shift wall
    clocks around DST changes).
    """
    from pyspark.sql import types as T

    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(F.make_timestamp(
            F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
            F.date_part(F.lit("SECOND"), c), F.lit("UTC")))
    return F.unix_micros(c)


def ts_micros(df: DataFrame, c: str) -> Column:
    return micros_of(F.col(c), df.schema[c].dataType)


def as_instant(df: DataFrame, c: str) -> Column:
    """TIMESTAMP column for ``c``; a TIMESTAMP_NTZ wall clock is taken as UTC."""
    return F.timestamp_micros(ts_micros(df, c))
