"""Rounding and division with the edge cases of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int) -> Column:
    """Round half to even on the binary value scaled by a power of ten, as numeric libraries do."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale
