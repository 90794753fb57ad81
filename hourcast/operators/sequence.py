"""Per-series sequence operators.

All windows share one spec ``partitionBy(key).orderBy(ts, tie)`` so Catalyst
plans a single Exchange + Sort and evaluates every lag, rolling mean, row
number and count in the same Window operator.  A counter holds at most one row
per hour (8,760 a year), so a per-counter window partition is small even when
the table is huge; parallelism comes from the number of counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "counter_id"
TS = "ts_utc"
TARGET = "hourly_count"


def series_window(key: str | list[str] = KEY, order: list[str] | None = None):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(*(order or [TS]))


def whole(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def number_rows(df: DataFrame, key=KEY, order=None, rn="rn", n="n") -> DataFrame:
    """Chronological renumbering (1-based) plus the series length."""
    w = series_window(key, order)
    return df.withColumns({rn: F.row_number().over(w).cast("bigint"),
                           n: F.count(F.lit(1)).over(whole(w))})


def percent_bounds(n: Column, start_pct: Column, end_pct: Column) -> tuple[Column, Column]:
    """``int(n * (s / 100))`` with the same IEEE operation order as the reference."""
    lo = F.floor(n.cast("double") * (start_pct.cast("double") / F.lit(100.0))).cast("bigint")
    hi = F.floor(n.cast("double") * (end_pct.cast("double") / F.lit(100.0))).cast("bigint")
    return lo, hi


def percent_slice_filter(rn: Column, n: Column, start_pct: Column, end_pct: Column) -> Column:
    """Keep 0-based positions in ``[int(n*s/100), int(n*e/100))``; empty if s >= e."""
    lo, hi = percent_bounds(n, start_pct, end_pct)
    pos = rn - F.lit(1)
    return (start_pct < end_pct) & (pos >= lo) & (pos < hi)


def percent_slice(df: DataFrame, start_pct: float, end_pct: float, key=KEY, order=None) -> DataFrame:
    numbered = number_rows(df, key, order)
    return numbered.filter(percent_slice_filter(F.col("rn"), F.col("n"),
                                                F.lit(float(start_pct)), F.lit(float(end_pct))))


def n_test(n: Column, ratio: Column | float) -> Column:
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.floor(n.cast("double") * r).cast("bigint")


def time_split(df: DataFrame, ratio: float, key=KEY, order=None) -> DataFrame:
    """The last ``int(n * ratio)`` rows of each series are the test split."""
    numbered = number_rows(df, key, order)
    return numbered.withColumn("is_test", F.col("rn") > F.col("n") - n_test(F.col("n"), ratio))


def lag_columns(target: str, nb_ar: int, w) -> dict[str, Column]:
    """``target_ar_k = lag(target, k)`` (row based: a missing hour shifts it)."""
    return {f"target_ar_{k}": F.lag(F.col(target).cast("double"), k).over(w)
            for k in range(1, nb_ar + 1)}


def rolling_mean_columns(target: str, nb_mm: int, roll: int, w) -> dict[str, Column]:
    """Mean of the ``k*roll`` rows before the current one.

    Spark averages partial frames; the reference (pandas ``rolling``) returns
    null until the frame is full or when it holds a null, so guard by count.
    """
    out = {}
    for k in range(1, nb_mm + 1):
        size = k * roll
        frame = w.rowsBetween(-size, -1)
        y = F.col(target).cast("double")
        full = (F.count(y).over(frame) == size) & (F.count(F.lit(1)).over(frame) == size)
        out[f"target_mm_{roll}_{k}"] = F.when(full, F.avg(y).over(frame))
    return out


def add_ar_features(df: DataFrame, nb_ar: int, nb_mm: int, roll: int,
                    target: str = TARGET, key=KEY, order=None) -> DataFrame:
    w = series_window(key, order)
    cols = {**lag_columns(target, nb_ar, w), **rolling_mean_columns(target, nb_mm, roll, w)}
    return df.withColumns(cols) if cols else df


def complete_case(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Drop rows with a null or NaN in any feature (target not checked)."""
    return df.na.drop(how="any", subset=feature_cols)


def cv_folds(df: DataFrame, n_splits: int = 5, key=KEY, order=None) -> DataFrame:
    """Expanding-window folds, test size ``n // (n_splits + 1)``.

    Returns one row per (row, fold) where the row takes part, with its role.
    Each row appears in at most ``n_splits`` folds, so the output is bounded
    by ``n_splits`` times the input; no pairs are formed.
    """
    numbered = number_rows(df, key, order)
    ts_size = F.floor(F.col("n") / F.lit(n_splits + 1)).cast("bigint")
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    exploded = numbered.withColumn("fold", F.explode(folds)).withColumn("_ts", ts_size)
    test_end = F.col("n") - (F.lit(n_splits - 1) - F.col("fold")) * F.col("_ts")
    test_start = test_end - F.col("_ts")
    role = (F.when(F.col("rn") <= test_start, F.lit("train"))
            .when(F.col("rn") <= test_end, F.lit("test")))
    return exploded.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_ts")


def union_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row-wise union filling the columns one side lacks with null."""
    return a.unionByName(b, allowMissingColumns=True)


def align(df: DataFrame, survivors: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the rows whose key survived another step."""
    return df.join(survivors.select(*keys), on=keys, how="left_semi")
