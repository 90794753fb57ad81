"""Metric queries (PromQL layer, B1–B19) over long sample tables.

Range vectors are evaluated at fixed steps.  Raw samples are first reduced to
one row per (series, step bucket) by a partially-aggregated ``groupBy`` – the
only operator that touches every sample – and the range functions then run as
windows over that small bucket table (``rangeBetween`` on the bucket index).
No window is ever partitioned by a raw series over raw samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.functions.timecols import epoch_hours, from_epoch_seconds
from hourcast.operators.bucketed import bucketed_lag

# Default latency histogram bounds of the Prometheus Python
# client (seconds) and the "predictions per response" bounds of the API.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
PREDICTION_BOUNDS = [1.0, 5.0, 10.0, 20.0, 50.0, 100.0]
SCRAPE_SECONDS = 5


def rate_window(window_s: int, scrape_s: int = SCRAPE_SECONDS) -> int:
    """``clamp_min(window + scrape, 4 * scrape)``."""
    return max(window_s + scrape_s, 4 * scrape_s)


def rate_window_col(window_s: Column, scrape_s: int = SCRAPE_SECONDS) -> Column:
    """B19 on a column of window lengths."""
    return F.greatest(window_s + F.lit(scrape_s), F.lit(4 * scrape_s)).cast("bigint")


def hour_bucket(ts: str = "ts") -> Column:
    return epoch_hours(ts)


def bucket_start(bucket: str = "bucket") -> Column:
    return from_epoch_seconds(F.col(bucket) * 3600)


def counter_increase(samples: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """B1: per-sample increase of a counter with reset handling.

    ``delta = v - prev`` and, when the counter went down (a reset), ``v``.
    The previous sample is found with the bucketed lag, so one busy series
    is spread over its hour buckets.
    """
    s = samples.withColumn("bucket", hour_bucket())
    s = bucketed_lag(s, keys, order, "bucket", value, "_prev")
    v, p = F.col(value), F.col("_prev")
    delta = F.when(p.isNull(), F.lit(0)).when(v < p, v).otherwise(v - p)
    return s.withColumn("delta", delta.cast("bigint")).drop("_prev")


def rate(samples: DataFrame, keys: list[str], value: str, order: list[str],
         window_s: int = 3600) -> DataFrame:
    """Tumbling ``increase`` and ``rate`` per series and hour."""
    inc = counter_increase(samples, keys, value, order)
    return (inc.groupBy(*keys, "bucket")
            .agg(F.sum("delta").cast("bigint").alias("increase"))
            .withColumn("rate", F.col("increase") / F.lit(float(window_s))))


def bucket_of(x: Column, bounds: list[float]) -> Column:
    """Upper bound ``le`` of the histogram bucket holding ``x`` (``+Inf`` last)."""
    expr = None
    for b in bounds:
        expr = (F.when(x <= F.lit(b), F.lit(b)) if expr is None
                else expr.when(x <= F.lit(b), F.lit(b)))
    return expr.otherwise(F.lit(math.inf))


def lower_of(le: Column, bounds: list[float]) -> Column:
    expr = F.when(le == F.lit(bounds[0]), F.lit(0.0))
    for lo, hi in zip(bounds, bounds[1:]):
        expr = expr.when(le == F.lit(hi), F.lit(lo))
    return expr.otherwise(F.lit(bounds[-1]))


def histogram_counts(obs: DataFrame, keys: list[str], x: str, bounds: list[float]) -> DataFrame:
    """Per (keys, le) observation counts (the ``sum by (le)`` of bucket rates)."""
    return (obs.withColumn("le", bucket_of(F.col(x), bounds))
            .groupBy(*keys, "le").agg(F.count(F.lit(1)).alias("n")))


def histogram_quantile(hist: DataFrame, keys: list[str], qs: list[float],
                       bounds: list[float], spark) -> DataFrame:
    """``histogram_quantile`` with linear interpolation inside the bucket.

    Works on the (keys × buckets) count table; each row is fanned out over the
    fixed quantile list (a literal array, no join).  A rank in the ``+Inf``
    bucket returns the highest finite bound, as Prometheus does.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    cum = hist.withColumns({
        "cum": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding,
                                               Window.unboundedFollowing))})
    q = F.array(*[F.lit(float(v)) for v in qs])
    ranked = cum.withColumn("q", F.explode(q)).withColumn("rank", F.col("q") * F.col("total"))
    hit = ranked.filter(F.col("cum") >= F.col("rank"))
    pick = hit.groupBy(*keys, "q").agg(
        F.min_by(F.struct("le", "cum", "n", "rank"), F.col("le")).alias("b"))
    le, cumv, n, rk = (F.col("b.le"), F.col("b.cum"), F.col("b.n"), F.col("b.rank"))
    lower = lower_of(le, bounds)
    value = (F.when(le == F.lit(math.inf), F.lit(bounds[-1]))
             .otherwise(lower + (le - lower) * (rk - (cumv - n)) / n))
    return pick.select(*keys, "q", value.alias("value"))


def step_aggregates(samples: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Per (series, hour bucket): sum, count and last value (by ``order``)."""
    s = samples.withColumn("bucket", hour_bucket())
    return s.groupBy(*keys, "bucket").agg(
        F.sum(F.col(value).cast("double")).alias("_sum"), F.count(value).alias("_cnt"),
        F.max_by(F.col(value), F.struct(*[F.col(o) for o in order])).alias("_last"))


def over_time(samples: DataFrame, keys: list[str], value: str, order: list[str],
              range_steps: int) -> DataFrame:
    """``avg_over_time`` and ``last_over_time`` over the last
    ``range_steps`` hourly buckets, evaluated at every hour of the series span
    (a missing hour still gets a value while a sample is in range)."""
    agg = step_aggregates(samples, keys, value, order)
    span = agg.groupBy(*keys).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("bucket"))
    g = grid.join(agg, [*keys, "bucket"], "left")
    w = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-(range_steps - 1), 0)
    return g.select(*keys, "bucket",
                    (F.sum("_sum").over(w) / F.nullif(F.sum("_cnt").over(w), F.lit(0))).alias("avg_over_time"),
                    F.last("_last", ignorenulls=True).over(w).alias("last_over_time"),
                    F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("samples_in_range"))


def topk(df: DataFrame, k: int, by: list[str], value: str, ties: list[str]) -> DataFrame:
    """Top ``k`` rows per ``by`` group (per time step), ties broken by name."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), *[F.col(t) for t in ties])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def classify(x: Column, amber: float, red: float, higher_is_better: bool = False) -> Column:
    """Dashboard colour by threshold steps."""
    if higher_is_better:
        return (F.when(x.isNull(), F.lit(None)).when(x >= F.lit(red), F.lit("green"))
                .when(x >= F.lit(amber), F.lit("amber")).otherwise(F.lit("red")))
    return (F.when(x.isNull(), F.lit(None)).when(x >= F.lit(red), F.lit("red"))
            .when(x >= F.lit(amber), F.lit("amber")).otherwise(F.lit("green")))
