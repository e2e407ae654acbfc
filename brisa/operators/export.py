"""Reading record -> text columns for export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from brisa.functions.columns import to_text
from brisa.schema import EXPORT_HEADER, READING_COLS


def to_text_columns(df: DataFrame, cols: Sequence[str] = READING_COLS,
                    names: Sequence[str] = EXPORT_HEADER) -> DataFrame:
    """Every listed column as text (null -> ""), renamed to the export header.

    Doubles print in Java notation (``0.1``, ``1.0E-5``), which is Spark's own
    double-to-string cast.
    """
    if len(cols) != len(names):
        raise ValueError("cols and names differ in length")
    return df.select(*[to_text(c).alias(n) for c, n in zip(cols, names)])
