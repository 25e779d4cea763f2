"""Tables of the core, and broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.tables import quoted, shared_dir, table
from ..sources.tables import written as materialise

__all__ = ["materialise", "quoted", "shared_dir", "small", "table"]

#: A side of a join is broadcast only when it was measured and has no more bytes than this.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, rows: int, width: int = 16) -> DataFrame:
    """df with a broadcast hint if its counted rows of so many bytes are within the bound, else as it is (a shuffled join)."""
    return df.hint("broadcast") if rows * width <= BROADCAST_BYTES else df
