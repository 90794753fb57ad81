"""Numeric helpers shared by outputs that are compared across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_scaled(c: Column, digits: int) -> Column:
    """``round(x, d)`` computed as ``round(x · 10^d) / 10^d`` on the binary
    double (half away from zero on the scaled value).

    Spark's ``round`` on a double rounds the value's shortest decimal text, so
    a value such as 2.4803125 (binary 2.48031249999…) goes up while a binary
    rounding goes down.  Scaling first rounds the binary value, which is also
    what SQL engines such as DuckDB do, so both sides publish the same digits.
    The trailing ``+ 0.0`` turns a rounded -0.0 into 0.0.
    """
    scale = F.lit(float(10 ** digits))
    return F.round(c * scale) / scale + F.lit(0.0)
