"""Monitoring queries (PromQL layer B1–B19) over samples and the access log."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.catalog.series import FEATURES_SQL, _features, TEST_RATIO
from hourcast.operators import metrics as M
from hourcast.operators import sequence as seq
from hourcast.operators.evaluate import metric_aggs, round_doubles
from hourcast.sources.tables import access_log, materialize, samples, with_views

FAM = "monitoring"
HOUR_SQL = "CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT)"
SERIES = ["job", "instance"]
ORDER = ["ts", "event_id"]


def _le_sql(x, bounds):
    parts = " ".join(f"WHEN {x} <= {b} THEN {b}" for b in bounds)
    return f"CASE {parts} ELSE 'Infinity'::DOUBLE END"


def _lower_sql(le, bounds):
    parts = [f"WHEN {le} = {bounds[0]} THEN 0.0"]
    parts += [f"WHEN {le} = {hi} THEN {lo}" for lo, hi in zip(bounds, bounds[1:])]
    return f"CASE {' '.join(parts)} ELSE {bounds[-1]} END"


def _quantile_sql(src, keys, x, bounds, qs):
    k = ", ".join(keys)
    qv = ", ".join(f"({q}::DOUBLE)" for q in qs)  # double, as on the Spark side
    return f"""
h AS (SELECT {k}, {_le_sql(x, bounds)} AS le, count(*) AS n FROM {src} GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY le ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(n) OVER (PARTITION BY {k}) AS total FROM h),
r AS (SELECT c.*, q.q, q.q * c.total AS rnk FROM c CROSS JOIN (VALUES {qv}) q(q)),
p AS (SELECT *, row_number() OVER (PARTITION BY {k}, q ORDER BY le) AS pos FROM r WHERE cum >= rnk)
SELECT {k}, q, round(CASE WHEN le = 'Infinity'::DOUBLE THEN {bounds[-1]}
  ELSE {_lower_sql('le', bounds)} + (le - {_lower_sql('le', bounds)}) * (rnk - (cum - n)) / n END, 6) AS value
FROM p WHERE pos = 1"""


RATE_SQL = with_views("samples") + f""",
d AS (SELECT job, instance, {HOUR_SQL} AS bucket, counter_value AS v,
        lag(counter_value) OVER (PARTITION BY job, instance ORDER BY ts, event_id) AS p FROM samples),
r AS (SELECT job, instance, bucket,
        CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END) AS BIGINT) AS increase
      FROM d GROUP BY 1, 2, 3)
"""


@query("rate_reset", RATE_SQL + """
SELECT job, instance, bucket, increase, round(increase / 3600.0, 6) AS rate FROM r""", FAM)
def rate_reset(spark, sf_dir):
    """B1: tumbling hourly increase/rate per series with counter-reset handling."""
    r = M.rate(materialize(samples(spark, sf_dir)), SERIES, "counter_value", ORDER)
    return round_doubles(r.select(*SERIES, "bucket", "increase", "rate"))


@query("job_rates", RATE_SQL + """
SELECT job, bucket, CAST(sum(increase) AS BIGINT) AS increase, round(sum(increase) / 3600.0, 6) AS rate,
       count(*) AS n_series FROM r GROUP BY 1, 2""", FAM)
def job_rates(spark, sf_dir):
    """``sum by (job) (rate(counter[1h]))`` per hour."""
    r = M.rate(materialize(samples(spark, sf_dir)), SERIES, "counter_value", ORDER)
    g = r.groupBy("job", "bucket").agg(F.sum("increase").cast("bigint").alias("increase"),
                                       F.count(F.lit(1)).alias("n_series"))
    return round_doubles(g.withColumn("rate", F.col("increase") / F.lit(3600.0))
                         .select("job", "bucket", "increase", "rate", "n_series"))


@query("container_panels", RATE_SQL + f""",
g AS (SELECT job, instance, {HOUR_SQL} AS bucket, sum(value) / count(value) AS memory, max(value) AS peak FROM samples GROUP BY 1, 2, 3)
SELECT job || '-' || CAST(instance AS VARCHAR) AS container, bucket, round(100 * increase / 3600.0, 6) AS cpu_pct,
       round(memory, 6) AS memory_mean, round(peak, 6) AS memory_peak
FROM r JOIN g USING (job, instance, bucket)""", FAM)
def container_panels(spark, sf_dir):
    """Per container and hour the CPU rate times 100 of a counter, and the
    plain mean and peak of a gauge (a rate of a gauge means nothing)."""
    s = materialize(samples(spark, sf_dir))
    r = M.rate(s, SERIES, "counter_value", ORDER)
    g = s.groupBy(*SERIES, M.hour_bucket().alias("bucket")).agg((F.sum("value") / F.count("value")).alias("memory_mean"), F.max("value").alias("memory_peak"))
    return round_doubles(r.join(g, [*SERIES, "bucket"]).select(
        F.concat_ws("-", "job", F.col("instance").cast("string")).alias("container"), "bucket", (F.lit(100) * F.col("increase") / F.lit(3600.0)).alias("cpu_pct"),
        "memory_mean", "memory_peak"))


@query("request_rates", with_views("access_log") + f"""
SELECT {HOUR_SQL} AS bucket, count(*) AS n_requests,
  round(count(*) / 3600.0, 6) AS rate_total,
  round(count(*) FILTER (WHERE handler <> '/metrics') / 3600.0, 6) AS rate_no_metrics,
  round(count(*) FILTER (WHERE status >= 500) / 3600.0, 6) AS rate_5xx,
  round(100.0 * count(*) FILTER (WHERE status >= 500) / nullif(count(*), 0), 6) AS error_share_pct,
  round(sum(seconds) / count(seconds), 6) AS mean_seconds
FROM access_log GROUP BY 1""", FAM)
def request_rates(spark, sf_dir):
    """B2 + B4 + B8: request rate (all, without /metrics), 5xx rate and share,
    mean latency = rate(sum) / rate(count), per hour."""
    a = access_log(spark, sf_dir).withColumn("bucket", M.hour_bucket())
    n = F.count(F.lit(1))
    n5 = F.count(F.when(F.col("status") >= 500, 1))
    g = a.groupBy("bucket").agg(
        n.alias("n_requests"), (n / 3600.0).alias("rate_total"),
        (F.count(F.when(F.col("handler") != "/metrics", 1)) / 3600.0).alias("rate_no_metrics"),
        (n5 / 3600.0).alias("rate_5xx"),
        (F.try_divide(n5 * 100.0, n)).alias("error_share_pct"),
        (F.sum("seconds") / F.count("seconds")).alias("mean_seconds"))
    return round_doubles(g)


@query("rate_by_status", with_views("access_log") + f"""
SELECT {HOUR_SQL} AS bucket, status, count(*) AS n_requests, round(count(*) / 3600.0, 6) AS rate
FROM access_log GROUP BY 1, 2""", FAM)
def rate_by_status(spark, sf_dir):
    """``sum by (status) (rate(requests[1h]))``."""
    a = access_log(spark, sf_dir).withColumn("bucket", M.hour_bucket())
    g = a.groupBy("bucket", "status").agg(F.count(F.lit(1)).alias("n_requests"))
    return round_doubles(g.withColumn("rate", F.col("n_requests") / F.lit(3600.0)))


QS = [0.5, 0.9, 0.99]


@query("latency_quantiles", with_views("access_log") + f""",
src AS (SELECT {HOUR_SQL} AS bucket, seconds FROM access_log),
""" + _quantile_sql("src", ["bucket"], "seconds", M.LATENCY_BOUNDS, QS).strip(), FAM)
def latency_quantiles(spark, sf_dir):
    """p50 / p90 / p99 latency per hour from histogram buckets."""
    a = access_log(spark, sf_dir).withColumn("bucket", M.hour_bucket())
    h = M.histogram_counts(a, ["bucket"], "seconds", M.LATENCY_BOUNDS)
    return round_doubles(M.histogram_quantile(h, ["bucket"], QS, M.LATENCY_BOUNDS, spark))


@query("endpoint_quantiles", with_views("access_log") + f""",
src AS (SELECT {HOUR_SQL} AS bucket, handler, seconds FROM access_log
        WHERE regexp_full_match(handler, '.*predictions.*')),
""" + _quantile_sql("src", ["bucket", "handler"], "seconds", M.LATENCY_BOUNDS, QS).strip(), FAM)
def endpoint_quantiles(spark, sf_dir):
    """The quantiles restricted to handlers matching ``.*predictions.*``."""
    a = (access_log(spark, sf_dir).filter(F.col("handler").rlike("^.*predictions.*$"))
         .withColumn("bucket", M.hour_bucket()))
    h = M.histogram_counts(a, ["bucket", "handler"], "seconds", M.LATENCY_BOUNDS)
    return round_doubles(M.histogram_quantile(h, ["bucket", "handler"], QS, M.LATENCY_BOUNDS, spark))


@query("predictions_per_response", with_views("access_log") + f""",
src AS (SELECT {HOUR_SQL} AS bucket, CAST(CAST(floor(seconds * 100) AS BIGINT) % 120 AS DOUBLE) AS n_pred
        FROM access_log WHERE handler = '/predictions'),
pq AS (WITH """ + _quantile_sql("src", ["bucket"], "n_pred", M.PREDICTION_BOUNDS, [0.9]).strip() + """),
ps AS (SELECT bucket, round(sum(n_pred) / 3600.0, 6) AS predictions_per_second FROM src GROUP BY 1)
SELECT ps.bucket, ps.predictions_per_second, pq.value AS p90_per_response
FROM ps JOIN pq ON ps.bucket = pq.bucket""", FAM)
def predictions_per_response(spark, sf_dir):
    """Predictions returned per second and the p90 per response
    (buckets 1, 5, 10, 20, 50, 100, +Inf)."""
    a = (access_log(spark, sf_dir).filter(F.col("handler") == "/predictions")
         .select(M.hour_bucket().alias("bucket"),
                 (F.floor(F.col("seconds") * 100).cast("bigint") % 120).cast("double").alias("n_pred")))
    h = M.histogram_counts(a, ["bucket"], "n_pred", M.PREDICTION_BOUNDS)
    pq = M.histogram_quantile(h, ["bucket"], [0.9], M.PREDICTION_BOUNDS, spark)
    ps = a.groupBy("bucket").agg((F.sum("n_pred") / 3600.0).alias("predictions_per_second"))
    return round_doubles(ps.join(pq.select("bucket", F.col("value").alias("p90_per_response")),
                                 "bucket"))


@query("topk_handlers", with_views("access_log") + f""",
g AS (SELECT {HOUR_SQL} AS bucket, handler, status, count(*) AS n FROM access_log GROUP BY 1, 2, 3)
SELECT bucket, handler, status, round(n / 3600.0, 6) AS rate, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, handler, status) AS rk FROM g)
WHERE rk <= 5""", FAM)
def topk_handlers(spark, sf_dir):
    """``topk(5, sum by (handler, status) (rate(requests[1h])))`` per hour."""
    a = access_log(spark, sf_dir).withColumn("bucket", M.hour_bucket())
    g = (a.groupBy("bucket", "handler", "status").agg(F.count(F.lit(1)).alias("n"))
         .withColumn("rate", F.col("n") / F.lit(3600.0)))
    t = M.topk(g, 5, ["bucket"], "n", ["handler", "status"])
    return round_doubles(t.select("bucket", "handler", "status", "rate", "rank"))


@query("over_time", with_views("samples") + f""",
a AS (SELECT job, instance, {HOUR_SQL} AS bucket, sum(value) AS s, count(value) AS c,
        arg_max(value, (ts, event_id)) AS last_v FROM samples GROUP BY 1, 2, 3),
span AS (SELECT job, instance, min(bucket) AS lo, max(bucket) AS hi FROM a GROUP BY 1, 2),
grid AS (SELECT job, instance, unnest(range(lo, hi + 1)) AS bucket FROM span),
g AS (SELECT grid.job, grid.instance, grid.bucket, a.s, a.c, a.last_v FROM grid
      LEFT JOIN a ON grid.job = a.job AND grid.instance = a.instance AND grid.bucket = a.bucket)
SELECT job, instance, bucket,
  round(sum(s) OVER w / nullif(sum(c) OVER w, 0), 6) AS avg_over_time,
  last(last_v IGNORE NULLS) OVER w AS last_over_time,
  CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) AS samples_in_range
FROM g WINDOW w AS (PARTITION BY job, instance ORDER BY bucket RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)""", FAM)
def over_time(spark, sf_dir):
    """B11 + B12 (+ B13 within range): ``avg_over_time`` and ``last_over_time``
    over 6 h, evaluated every hour of each series' span."""
    o = M.over_time(samples(spark, sf_dir, with_counter=False), SERIES, "value", ORDER, range_steps=6)
    return round_doubles(o.withColumn("samples_in_range", F.col("samples_in_range").cast("bigint")))


@query("availability", with_views("samples") + f"""
SELECT job, instance, {HOUR_SQL} AS bucket, round(100.0 * avg(up), 6) AS availability_pct,
  CASE WHEN 100.0 * avg(up) >= 99 THEN 'green' WHEN 100.0 * avg(up) >= 95 THEN 'amber' ELSE 'red' END AS availability_class
FROM samples GROUP BY 1, 2, 3""", FAM)
def availability(spark, sf_dir):
    """B5 + B14: ``avg_over_time(up[1h]) * 100`` per series and hour, classed."""
    s = samples(spark, sf_dir, with_counter=False).withColumn("bucket", M.hour_bucket())
    g = s.groupBy(*SERIES, "bucket").agg((F.avg("up") * 100.0).alias("availability_pct"))
    g = g.withColumn("availability_class",
                     M.classify(F.col("availability_pct"), 95.0, 99.0, higher_is_better=True))
    return round_doubles(g)


@query("last_sample", with_views("samples") + """
SELECT job, instance, arg_max(value, (ts, event_id)) AS last_value, max(ts) AS last_ts
FROM samples WHERE value IS NOT NULL GROUP BY 1, 2""", FAM)
def last_sample(spark, sf_dir):
    """Last non-null value per series."""
    s = samples(spark, sf_dir, with_counter=False).filter(F.col("value").isNotNull())
    return s.groupBy(*SERIES).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"),
                                  F.max("ts").alias("last_ts"))


@query("threshold_classes", FEATURES_SQL + """,
m AS (SELECT counter_id,
  sqrt(sum((hourly_count - seasonal_pred) * (hourly_count - seasonal_pred)) / count(hourly_count - seasonal_pred)) AS rmse,
  avg(abs(hourly_count - seasonal_pred) / greatest(abs(CASE WHEN seasonal_pred IS NOT NULL THEN hourly_count END), 1e-6)) * 100 AS mape,
  1.0 - sum((hourly_count - seasonal_pred) * (hourly_count - seasonal_pred))
    / nullif(sum(CASE WHEN seasonal_pred IS NOT NULL THEN hourly_count * hourly_count END)
      - sum(CASE WHEN seasonal_pred IS NOT NULL THEN hourly_count END) * sum(CASE WHEN seasonal_pred IS NOT NULL THEN hourly_count END)
        / count(hourly_count - seasonal_pred), 0.0) AS r2
  FROM f WHERE rn > n - CAST(floor(CAST(n AS DOUBLE) * 0.25) AS BIGINT) GROUP BY 1)
SELECT counter_id,
  CASE WHEN mape >= 60 THEN 'red' WHEN mape >= 30 THEN 'amber' ELSE 'green' END AS mape_class,
  CASE WHEN rmse >= 100 THEN 'red' WHEN rmse >= 50 THEN 'amber' ELSE 'green' END AS rmse_class,
  CASE WHEN r2 IS NULL THEN NULL WHEN r2 >= 0.8 THEN 'green' WHEN r2 >= 0.5 THEN 'amber' ELSE 'red' END AS r2_class
FROM m""", FAM)
def threshold_classes(spark, sf_dir):
    """Dashboard classes of the forecast KPIs (MAPE 30/60, RMSE 50/100, R² .5/.8)."""
    f = _features(spark, sf_dir)
    test = f.filter(F.col("rn") > F.col("n") - seq.n_test(F.col("n"), TEST_RATIO))
    m = test.groupBy("counter_id").agg(*metric_aggs("hourly_count", "seasonal_pred"))
    return m.select("counter_id",
                    M.classify(F.col("mape"), 30.0, 60.0).alias("mape_class"),
                    M.classify(F.col("rmse"), 50.0, 100.0).alias("rmse_class"),
                    M.classify(F.col("r2"), 0.5, 0.8, higher_is_better=True).alias("r2_class"))


@query("label_values", with_views("access_log") + """
SELECT DISTINCT handler FROM access_log WHERE regexp_full_match(handler, '/(predictions|counters).*')""", FAM)
def label_values(spark, sf_dir):
    """``label_values(requests, handler)`` with a regex filter."""
    a = access_log(spark, sf_dir)
    return (a.filter(F.col("handler").rlike("^/(predictions|counters).*$"))
            .select("handler").distinct().orderBy("handler"))


@query("series_counts", with_views("samples") + """
SELECT job, count(DISTINCT (job, instance)) AS n_series, count(*) AS n_samples
FROM samples GROUP BY ROLLUP (job)""", FAM)
def series_counts(spark, sf_dir):
    """B16 + B18: distinct series and samples per name, with the grand total."""
    s = samples(spark, sf_dir, with_counter=False)
    return (s.rollup("job")
            .agg(F.count_distinct("job", "instance").alias("n_series"),
                 F.count(F.lit(1)).alias("n_samples")))
