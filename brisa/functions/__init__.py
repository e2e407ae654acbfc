"""Column-expression building blocks (all JVM-side, codegen-friendly)."""

from brisa.functions.columns import (  # noqa: F401
    blank_to_null_col,
    is_blank,
    partition_index,
    present,
    rate_per_unit,
    round_half_up,
    to_text,
    truncate_int,
    zero_to_null_col,
)
