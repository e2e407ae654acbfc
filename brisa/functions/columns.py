"""Scalar column expressions used by the operators.

Each helper returns a ``Column``; none of them calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Java-style ``trim()`` removes: every code point <= U+0020
# (Spark's ``trim`` only strips spaces, so a lone tab would survive it).
_BLANK_PATTERN = r"^[\x00-\x20]*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """True when the cell is missing, null or whitespace/control-only."""
    c = _c(c)
    return c.isNull() | c.rlike(_BLANK_PATTERN)


def blank_to_null_col(c) -> Column:
    """Blank -> null; any other text is kept exactly as written (no trimming)."""
    c = _c(c)
    return F.when(~is_blank(c), c)


def zero_to_null_col(c) -> Column:
    """A set reading equal to zero (``0.0`` or ``-0.0``) becomes null; NaN stays."""
    return F.nullif(_c(c), F.lit(0.0))


def present(c) -> Column:
    return _c(c).isNotNull()


def partition_index(c, default: int = 1, overflow: str = "error",
                    num_partitions: int | None = None) -> Column:
    """Output partition for a station number.

    ``max(0, coalesce(codnum, default) - 1)`` computed as ``greatest(x, 1) - 1``
    so that the subtraction can never underflow at the integer minimum.
    ``overflow``: ``"error"`` fails the row (a sink would reject it), ``"modulo"``
    wraps with ``pmod``; ``"none"`` leaves the index unchecked.
    """
    p = F.greatest(F.coalesce(_c(c), F.lit(default)), F.lit(1)) - F.lit(1)
    if num_partitions is None or overflow == "none":
        return p
    n = F.lit(int(num_partitions))
    if overflow == "modulo":
        return F.pmod(p, n)
    if overflow == "error":
        return F.when(p < n, p).otherwise(
            F.raise_error(F.concat(F.lit("partition index out of range: "), p.cast("string"))))
    raise ValueError(f"unknown overflow policy {overflow!r}")


def rate_per_unit(count, window_seconds: float | Column, unit_seconds: float | Column = 1.0) -> Column:
    """Messages per ``unit_seconds`` in a window of ``window_seconds`` (double)."""
    unit, window = (F.lit(x).cast("double") for x in (unit_seconds, window_seconds))
    return (_c(count).cast("double") * unit) / window


def truncate_int(x) -> Column:
    """Truncate toward zero, as a Java ``(int)`` cast does."""
    return _c(x).cast("int")


def round_half_up(x) -> Column:
    """Half-up rounding to a whole number, as ``%.0f`` prints it."""
    return F.round(_c(x), 0).cast("long")


def to_text(c) -> Column:
    """Value as text, null -> empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))
