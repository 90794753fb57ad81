"""Zone-independent helpers for ``timestamp_ntz`` columns.

Timestamps in the driver tables are civil UTC (``timestamp_ntz``).  Functions
such as ``date_trunc`` or ``unix_seconds`` go through the session time zone, so
the helpers below use only field extraction and ``timestampdiff`` on NTZ values,
which give the same answer whatever the session zone is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hour_floor(col: str | Column) -> Column:
    c = _c(col)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                F.lit(0), F.lit(0))


def day_floor(col: str | Column) -> Column:
    c = _c(col)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.lit(0),
                                F.lit(0), F.lit(0))


def epoch_seconds(col: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of an NTZ value (floor)."""
    return F.floor(epoch_micros(col) / F.lit(1_000_000)).cast("bigint")


def epoch_micros(col: str | Column) -> Column:
    c = _c(col)
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c).cast("bigint")


def epoch_hours(col: str | Column) -> Column:
    return F.floor(epoch_micros(col) / F.lit(3_600_000_000)).cast("bigint")


def from_epoch_seconds(col: str | Column) -> Column:
    return F.timestamp_add("SECOND", _c(col), F.expr(EPOCH_NTZ))


def add_hours(col: str | Column, hours: int | Column) -> Column:
    h = F.lit(hours) if isinstance(hours, int) else hours
    return F.timestamp_add("HOUR", h, _c(col))


def instant_to_utc_ntz(col: str | Column) -> Column:
    """An instant (``timestamp``) as its UTC civil time (``timestamp_ntz``),
    independent of the session zone (a plain cast would use the session zone)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(col)), F.expr(EPOCH_NTZ))
