"""Expected slots, coverage, gaps and publish gate.

Expected slots come from real Europe/Paris transitions: a civil day is the
UTC interval between two converted local midnights, so it holds 23, 24 or 25
hourly slots.  The slot grid is generated per active counter with
``sequence`` + ``explode`` (no cross join); gaps are found from consecutive
present hours, without materialising the grid at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.functions.calendar import PARIS, to_local, to_utc
from hourcast.functions.timecols import _c, day_floor, epoch_hours


def slots_in_local_day(local_day: str | Column, tz: str = PARIS) -> Column:
    """Number of hourly UTC slots in a civil day (23 / 24 / 25)."""
    d = _c(local_day)
    start = to_utc(d, tz)
    end = to_utc(F.timestamp_add("DAY", F.lit(1), d), tz)
    return (epoch_hours(end) - epoch_hours(start)).cast("int")


def expected_slots(active: DataFrame, first_col: str, last_col: str, tz: str = PARIS) -> DataFrame:
    """Every hourly UTC slot of the civil days a counter is active.

    ``active`` has one row per counter with its first and last UTC hour; the
    grid is the explode of the UTC sequence between the converted local
    midnights of the first and the day after the last civil day.
    """
    first_day = day_floor(to_local(first_col, tz))
    last_day = day_floor(to_local(last_col, tz))
    start = to_utc(first_day, tz)
    stop = F.timestamp_add("HOUR", F.lit(-1), to_utc(F.timestamp_add("DAY", F.lit(1), last_day), tz))
    return active.select("*", F.explode(F.sequence(start, stop, F.expr("INTERVAL 1 HOUR"))).alias("slot_utc"))


def gaps(series: DataFrame, key: str = "counter_id", ts: str = "ts_utc") -> DataFrame:
    """Runs of missing hours between consecutive present hours."""
    w = Window.partitionBy(key).orderBy(ts)
    prev = F.lag(ts).over(w)
    s = series.select(key, ts, prev.alias("_prev"))
    missing = epoch_hours(ts) - epoch_hours("_prev") - 1
    return (s.filter(missing > 0)
            .select(key, F.timestamp_add("HOUR", F.lit(1), F.col("_prev")).alias("gap_start"),
                    F.col(ts).alias("gap_end"), missing.cast("bigint").alias("n_missing")))


def publish_gate(coverage: DataFrame, key: str, ratio_col: str, required: float,
                 required_col: str = "required") -> DataFrame:
    """Block when a required counter is below the coverage threshold;
    an optional counter below it publishes with a recorded fallback."""
    ok = F.col(ratio_col) >= F.lit(required)
    return coverage.withColumn(
        "decision",
        F.when(ok, F.lit("publish")).when(F.col(required_col), F.lit("block"))
        .otherwise(F.lit("publish_with_fallback")))
