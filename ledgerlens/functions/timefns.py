"""Time helpers that work for TIMESTAMP and TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(c: str | Column) -> Column:
    """Microseconds since the epoch.  NTZ values are read as UTC wall
    clock (the session time zone is UTC)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp"))
