"""Calendar scalars (A34–A42) and DST status (C6, C7) as Column expressions.

Everything is a built-in expression, so it compiles into the surrounding
whole-stage-codegen span; no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.functions.numeric import round_scaled
from hourcast.functions.timecols import _c, epoch_micros

PARIS = "Europe/Paris"

# Period of each cyclic pair (hour/24, day-of-week/7, month/12,
# ISO week/52, day-of-year/365).  Week 53 and day 366 wrap past one turn.
CYCLES = {"hour": 24, "day_of_week": 7, "month": 12, "week": 52, "day_of_year": 365}

# strict formats: offset with or without a colon, space or 'T' separator
STRICT_FORMATS = ["yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXX",
                  "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX"]


def to_local(utc_ntz: str | Column, tz: str = PARIS) -> Column:
    """UTC civil time -> civil time in ``tz`` (DST aware), both NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(utc_ntz))


def to_utc(local_ntz: str | Column, tz: str = PARIS) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(local_ntz))


def parse_utc(text: str | Column) -> Column:
    """Strict ISO format with offset first, lenient parse as fallback.

    The result is the UTC civil time as ``timestamp_ntz``; parsing goes through
    an explicit offset, so the session zone only matters for offset-less input.
    """
    t = _c(text)
    strict = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in STRICT_FORMATS])
    lenient = F.try_to_timestamp(t)
    return _ltz_to_utc_ntz(F.coalesce(strict, lenient))


def parse_utc_whole(df: DataFrame, text: str, keys: list[str], out: str, lenient: str | None = None,
                    formats: tuple[str, ...] = tuple(STRICT_FORMATS[2:])) -> DataFrame:
    """One decision per column and key: if every text has one of the strict
    ``formats`` (a T and an offset), all are parsed so; a single other text sends the key's whole column
    to the lenient parse (``lenient``, if named, says which it was).

    The decision is one map-side aggregate joined back; the texts are parsed once.
    """
    strict = F.coalesce(*[F.try_to_timestamp(F.col(text), F.lit(f)) for f in formats])
    parsed = df.withColumn("_strict", strict)
    fails = F.count(F.when(F.col("_strict").isNull() & F.col(text).isNotNull(), 1)) > 0
    decided = parsed.groupBy(*keys).agg(fails.alias("_lenient")).select(*[F.col(k).alias("_k_" + k) for k in keys], "_lenient")
    both = parsed.join(decided, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys])
    value = F.when(F.col("_lenient"), F.try_to_timestamp(F.col(text))).otherwise(F.col("_strict"))
    new = {out: _ltz_to_utc_ntz(value), **({lenient: F.col("_lenient")} if lenient else {})}
    return both.withColumns(new).drop("_strict", "_lenient", *["_k_" + k for k in keys])


def _ltz_to_utc_ntz(ltz: Column) -> Column:
    # unix_micros is an absolute instant; rebuild the UTC civil time from it.
    return F.timestamp_add("MICROSECOND", F.unix_micros(ltz), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def weekday0(c: Column) -> Column:
    """Day of week with Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(c)


def calendar_columns(ts_local: str | Column, prefix: str) -> dict[str, Column]:
    """A36–A40 on a local civil time: parts, weekend flag and cyclic pairs."""
    t = _c(ts_local)
    parts = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t),
        "day_of_year": F.dayofyear(t), "day_of_week": weekday0(t),
        "hour": F.hour(t), "week": F.weekofyear(t),
    }
    cols = {f"{prefix}_{k}": v.cast("int") for k, v in parts.items()}
    cols[f"{prefix}_week_end"] = F.when(parts["day_of_week"].isin(5, 6), 1).otherwise(0)
    for name, period in CYCLES.items():
        angle = F.lit(2 * math.pi) * parts[name] / F.lit(float(period))
        cols[f"{prefix}_sin_{name}"] = F.sin(angle)
        cols[f"{prefix}_cos_{name}"] = F.cos(angle)
    return cols


def add_calendar(df: DataFrame, ts_utc: str, prefix: str | None = None,
                 tz: str = PARIS, drop_source: bool = False) -> DataFrame:
    """``extract_datetime_periodic_features``: local time plus calendar columns."""
    prefix = prefix or ts_utc
    local = to_local(ts_utc, tz)
    out = df.withColumn(f"{prefix}_local", local)
    out = out.withColumns(calendar_columns(f"{prefix}_local", prefix))
    return out.drop(ts_utc) if drop_source else out


def freshness_days(last_ts: str | Column, asof: str | Column) -> Column:
    """Elapsed days between ``asof`` and the last timestamp (both UTC NTZ)."""
    return (epoch_micros(asof) - epoch_micros(last_ts)) / F.lit(86_400_000_000.0)


def clamp_round(x: str | Column, lo: float = 0.0, hi: float = 100.0, digits: int = 2) -> Column:
    """``round(max(lo, min(hi, x)), digits)``."""
    return round_scaled(F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x).cast("double"))), digits)


def dst_status(local_ntz: str | Column, tz: str = PARIS) -> Column:
    """C6: 'nonexistent', 'ambiguous' or 'ok' for a local civil time.

    Nonexistent: local -> UTC -> local does not come back.  Ambiguous: the hour
    before or after the UTC instant maps to the same local wall-clock value.
    """
    loc = _c(local_ntz)
    utc = to_utc(loc, tz)
    back = to_local(utc, tz)
    before = to_local(F.timestamp_add("HOUR", F.lit(-1), utc), tz)
    after = to_local(F.timestamp_add("HOUR", F.lit(1), utc), tz)
    return (F.when(back != loc, F.lit("nonexistent"))
            .when((before == loc) | (after == loc), F.lit("ambiguous"))
            .otherwise(F.lit("ok")))
