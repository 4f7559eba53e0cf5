"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def station_number(raw: Column, digits: int = 5) -> Column:
    """Without blanks around and filled with leading zeros to ``digits``; longer numbers stay whole."""
    t = F.trim(raw)
    return F.when(F.length(t) < digits, F.lpad(t, digits, "0")).otherwise(t)
