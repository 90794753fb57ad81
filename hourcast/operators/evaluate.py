"""Evaluation aggregates.

Metrics are built from additive sums (count, Σe, Σe², Σ|e|, Σy, Σy²), so the
aggregate is a partial/final HashAggregate pair: each task pre-aggregates its
rows and the shuffle carries one small row per group per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.functions.numeric import round_scaled


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def metric_aggs(y_true: str, y_pred: str, prefix: str = "") -> list[Column]:
    """A77 + A78 over the rows of a group.

    ``r2`` is the usual coefficient of determination; ``r2_ref`` reproduces the
    reference call with the arguments swapped (variance of the prediction).
    """
    t, p = _d(y_true), _d(y_pred)
    e = t - p
    n = F.count(e)
    sse = F.sum(F.when(e.isNotNull(), e * e))
    tt = F.when(e.isNotNull(), t)
    pp = F.when(e.isNotNull(), p)
    ss_t, ss_p = F.var_pop(tt) * n, F.var_pop(pp) * n  # centred: large counts do not cancel digits
    return [
        n.alias(f"{prefix}n_obs"),
        F.sqrt(sse / n).alias(f"{prefix}rmse"),
        F.avg(F.abs(e)).alias(f"{prefix}mae"),
        (F.avg(F.abs(e) / F.greatest(F.abs(tt), F.lit(1e-6))) * 100).alias(f"{prefix}mape"),
        (F.lit(1.0) - sse / F.nullif(ss_t, F.lit(0.0))).alias(f"{prefix}r2"),
        (F.lit(1.0) - sse / F.nullif(ss_p, F.lit(0.0))).alias(f"{prefix}r2_ref"),
    ]


def evaluate(df: DataFrame, keys: list[str], y_true: str, y_pred: str) -> DataFrame:
    return df.groupBy(*keys).agg(*metric_aggs(y_true, y_pred))


# Metric names of the published samples (KPI gauges per
# counter, step duration and record count per run).
KPI_GAUGES = [("bike_rmse", "rmse"), ("bike_mape", "mape"), ("bike_r2", "r2"),
              ("bike_data_freshness_days", "freshness_days"),
              ("bike_data_day_offset_days", "day_offset_days")]
OBS_COUNT_METRIC = "bike_obs_count"  # one sample for each kind label: true, pred
STEP_DURATION_METRIC = "bike_task_duration_seconds"
STEP_RECORDS_METRIC = "bike_records_total"
# Our own class sample (dashboard colour of the MAPE as 0 / 1 / 2).
MAPE_CLASS_METRIC = "bike_threshold_mape"


def kpi_unpivot(wide: DataFrame, keys: list[str], gauges=KPI_GAUGES) -> DataFrame:
    """Wide KPI row -> long metric samples ``(keys, metric, value)``."""
    return wide.unpivot(keys, [F.col(c).cast("double").alias(m) for m, c in gauges],
                        "metric", "value")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used on outputs compared against SQL)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            # "+ 0.0" maps -0.0 to 0.0 so hashes agree across engines
            cols.append(round_scaled(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def response_tally(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Response classes, shares and per-second rate over an access log."""
    s = F.col("status")
    keys = keys or []
    span = (F.max("ts").cast("timestamp_ntz"), F.min("ts").cast("timestamp_ntz"))
    total = F.count(F.lit(1))
    secs = F.timestamp_diff("MICROSECOND", span[1], span[0]) / F.lit(1e6)
    return log.groupBy(*keys).agg(
        total.alias("n_requests"),
        F.sum(F.when(s == 200, 1).otherwise(0)).cast("bigint").alias("n_200"),
        F.sum(F.when((s >= 200) & (s < 300), 1).otherwise(0)).cast("bigint").alias("n_2xx"),
        F.sum(F.when((s >= 400) & (s < 500), 1).otherwise(0)).cast("bigint").alias("n_4xx"),
        F.sum(F.when(s >= 500, 1).otherwise(0)).cast("bigint").alias("n_5xx"),
        F.sum(F.when((s < 200) | ((s >= 300) & (s < 400)), 1).otherwise(0)).cast("bigint").alias("n_other"),
        (F.avg(F.when(s == 200, 1.0).otherwise(0.0)) * 100).alias("pct_200"),
        (F.avg(F.when(s >= 500, 1.0).otherwise(0.0)) * 100).alias("pct_5xx"),
        (total / F.nullif(secs, F.lit(0.0))).alias("requests_per_second"),
    )
