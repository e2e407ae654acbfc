"""Zero-reading cleaning and presence flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from brisa.functions.columns import present, zero_to_null_col
from brisa.schema import CLEAN_COLS


def zero_to_null(df: DataFrame, cols: Sequence[str] = CLEAN_COLS) -> DataFrame:
    """Clear every listed measurement whose value is zero; all other columns pass.

    One projection: Catalyst folds it into the scan stage (no exchange, no UDF).
    Columns absent from ``df`` are ignored so the operator also runs on
    projections of the reading schema.
    """
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({c: zero_to_null_col(c) for c in cols})


def presence_flags(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                   prefix: str = "has_") -> DataFrame:
    """Key columns plus one boolean ``has_<col>`` per listed column."""
    return df.select(*keep, *[present(c).alias(prefix + c) for c in cols])
