"""Replay a finite dataset in a loop on a rate schedule.

The wall-clock loop of a load generator becomes data: each replayed row gets a
global sequence number ``seq = cycle * n + position`` and the second in which a
rate schedule emits it.  Payloads can be encoded once before the cycle
expansion (``explode`` multiplies rows in place - no shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.operators.sequence import with_sequence

# --- fixed values: load-generator defaults ---
FIXED_RATE = 15000          # messages per second, standalone producer
STRESS_START_RATE = 10000   # messages per second at t = 0
STRESS_STEP = 1000          # added every STRESS_EVERY_SECONDS
STRESS_EVERY_SECONDS = 5


def replay(df: DataFrame, order_cols: Sequence[str], cycles: int | None = None,
           total: int | None = None, num_partitions: int | None = None,
           start_cycle: int = 0) -> DataFrame:
    """Repeat ``df`` in the order of ``order_cols`` (unique), adding ``cycle`` and ``seq``.

    Give ``cycles`` (whole passes) or ``total`` (rows to send; the last pass is
    cut).  Empty input gives empty output.  Each row expands in place through
    ``explode(sequence(0, passes - 1))`` - no shuffle, no cross join - and the
    pass list is built per row, so keep ``passes`` moderate (thousands, not
    millions); to replay longer, continue with ``start_cycle`` (``seq`` and
    ``total`` then count from the start of that pass).
    """
    if (cycles is None) == (total is None):
        raise ValueError("give exactly one of cycles / total")
    indexed, n = with_sequence(df, order_cols, "_idx", num_partitions, with_count=True)
    if n == 0:
        return indexed.withColumn("cycle", F.lit(0).cast("long")).withColumn(
            "seq", F.col("_idx")).drop("_idx")
    passes = cycles if cycles is not None else -(-int(total) // n)
    first = int(start_cycle)
    if passes <= 0:  # nothing to send (sequence(a, a - 1) would count down, not be empty)
        return (indexed.withColumn("cycle", F.lit(first).cast("long"))
                .withColumn("seq", F.col("_idx")).drop("_idx").filter(F.lit(False)))
    out = (indexed
           .withColumn("cycle", F.explode(F.sequence(F.lit(first).cast("long"),
                                                     F.lit(first + passes - 1).cast("long"))))
           .withColumn("seq", F.col("cycle") * F.lit(n) + F.col("_idx"))
           .drop("_idx"))
    if total is not None:
        out = out.filter(F.col("seq") < F.lit(first * n + int(total)))
    return out


def fixed_rate_second(seq: str | Column = "seq", rate: int = FIXED_RATE) -> Column:
    """L1: second in which a fixed-rate sender emits message ``seq``."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(s / F.lit(int(rate))).cast("long")


def with_ramp_second(df: DataFrame, seq: str = "seq", out: str = "emit_second",
                     start_rate: int = STRESS_START_RATE, step: int = STRESS_STEP,
                     every_seconds: int = STRESS_EVERY_SECONDS) -> DataFrame:
    """L2: second in which message ``seq`` is sent when the rate ramps up as
    ``rate(t) = start + step * (t div every)``, computed in closed form.

    Messages sent before block ``b`` (a block is ``every`` seconds at one rate):
    ``C(b) = every * (start*b + step*b*(b-1)/2)``.  The block of message ``s`` is
    the root of that quadratic, corrected one step each way in exact integer
    arithmetic - no schedule table and no join, whatever the data size.
    """
    a, d, k = int(start_rate), int(step), int(every_seconds)
    if a <= 0 or d < 0 or k <= 0:
        raise ValueError("need start_rate > 0, step >= 0, every_seconds > 0")
    if d == 0:
        return df.withColumn(out, fixed_rate_second(seq, a))

    def cum(b: str) -> str:
        return f"({k}L * ({a}L * {b} + {d}L * (({b} * ({b} - 1L)) div 2L)))"

    root = (f"greatest(cast(floor((-({a} - {d} / 2.0) + sqrt(pow({a} - {d} / 2.0, 2) "
            f"+ 2.0 * {d} * `{seq}` / {k})) / {d}) as bigint), 0L)")
    return (df.withColumn("_b", F.expr(root))
            .withColumn("_b", F.expr(f"_b - CASE WHEN {cum('_b')} > `{seq}` THEN 1L ELSE 0L END"))
            .withColumn("_b", F.expr(f"_b + CASE WHEN {cum('(_b + 1L)')} <= `{seq}` THEN 1L ELSE 0L END"))
            .withColumn(out, F.expr(f"_b * {k}L + (`{seq}` - {cum('_b')}) div ({a}L + {d}L * _b)"))
            .drop("_b"))


def with_emit_second(df: DataFrame, mode: str = "fixed", rate: int = FIXED_RATE,
                     seq: str = "seq", out: str = "emit_second") -> DataFrame:
    """The two sender modes: ``"fixed"`` sends ``rate`` messages per second;
    ``"stress"`` starts at STRESS_START_RATE and adds STRESS_STEP every
    STRESS_EVERY_SECONDS (``rate`` is ignored)."""
    if mode == "fixed":
        return df.withColumn(out, fixed_rate_second(seq, rate))
    if mode == "stress":
        return with_ramp_second(df, seq, out)
    raise ValueError(f"mode must be 'fixed' or 'stress', got {mode!r}")
