"""Queries over the hourly count series: slicing, splitting, lags, calendar,
evaluation (SURVEY §2.1–2.5, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.functions.numeric import round_scaled
from hourcast.functions.calendar import add_calendar, clamp_round, dst_status, freshness_days
from hourcast.operators import sequence as seq
from hourcast.operators.evaluate import KPI_GAUGES, OBS_COUNT_METRIC, MAPE_CLASS_METRIC, kpi_unpivot, metric_aggs, round_doubles
from hourcast.plans.scenarios import scenario_array
from hourcast.sources.tables import counts, table, with_views

FAM = "series"

# The modelling defaults of the reference scenarios
# (ar = 7 lags, mm = 1 mean, roll = 24 rows, test ratio 0.25).
NB_AR, NB_MM, ROLL, TEST_RATIO = 7, 1, 24, 0.25

PARIS_SQL = "timezone('Europe/Paris', timezone('UTC', {c}))"


def _features(spark, sf_dir):
    c = counts(spark, sf_dir)
    w = seq.series_window()
    return c.withColumns({
        "rn": F.row_number().over(w),
        "n": F.count(F.lit(1)).over(seq.whole(w)),
        "seasonal_pred": F.lag(F.col("hourly_count").cast("double"), 24).over(w),
        **seq.lag_columns("hourly_count", NB_AR, w),
        **seq.rolling_mean_columns("hourly_count", NB_MM, ROLL, w),
    })


def forecast_eval(spark, sf_dir):
    """Flagship: counts -> Paris calendar -> lags + 24-row mean -> 75/25 split
    -> seasonal-naive and mean-24 predictions -> metrics per counter."""
    f = _features(spark, sf_dir)
    f = add_calendar(f, "ts_utc", prefix="ts")
    test = f.filter(F.col("rn") > F.col("n") - seq.n_test(F.col("n"), TEST_RATIO))
    out = test.groupBy("counter_id").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sum("ts_week_end").cast("bigint").alias("n_weekend"),
        *metric_aggs("hourly_count", "seasonal_pred", prefix="seasonal_"),
        *metric_aggs("hourly_count", "target_mm_24_1", prefix="mean24_"),
    )
    return round_doubles(out)


def _metric_sql(t, p, prefix):
    e = f"(CAST({t} AS DOUBLE) - {p})"
    tt = f"CASE WHEN {p} IS NOT NULL THEN CAST({t} AS DOUBLE) END"
    pp = f"CASE WHEN {p} IS NOT NULL AND {t} IS NOT NULL THEN {p} END"
    return f"""count({e}) AS {prefix}n_obs,
    round(sqrt(sum({e}*{e}) / count({e})), 6) AS {prefix}rmse,
    round(avg(abs({e})), 6) AS {prefix}mae,
    round(avg(abs({e}) / greatest(abs({tt}), 1e-6)) * 100, 6) AS {prefix}mape,
    round(1.0 - sum({e}*{e}) / nullif(sum({tt}*{tt}) - sum({tt})*sum({tt})/count({e}), 0.0), 6) AS {prefix}r2,
    round(1.0 - sum({e}*{e}) / nullif(sum({pp}*{pp}) - sum({pp})*sum({pp})/count({e}), 0.0), 6) AS {prefix}r2_ref"""


FEATURES_SQL = with_views("counts") + """, f AS (
  SELECT counter_id, ts_utc, hourly_count,
    row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
    count(*) OVER (PARTITION BY counter_id) AS n,
    CAST(lag(hourly_count, 24) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS DOUBLE) AS seasonal_pred,
    CASE WHEN count(*) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) = 24
         THEN avg(hourly_count) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS target_mm_24_1,
    CASE WHEN isodow(""" + PARIS_SQL.format(c="ts_utc") + """) IN (6, 7) THEN 1 ELSE 0 END AS ts_week_end
  FROM counts)
"""

query("forecast_eval", FEATURES_SQL + f"""
SELECT counter_id, count(*) AS n_test, CAST(sum(ts_week_end) AS BIGINT) AS n_weekend,
    {_metric_sql('hourly_count', 'seasonal_pred', 'seasonal_')},
    {_metric_sql('hourly_count', 'target_mm_24_1', 'mean24_')}
FROM f WHERE rn > n - CAST(floor(CAST(n AS DOUBLE) * 0.25) AS BIGINT)
GROUP BY counter_id""", FAM)(forecast_eval)


@query("hourly_counts", with_views("counts") + """
SELECT counter_id, site, orientation, count(*) AS n_hours, CAST(sum(hourly_count) AS BIGINT) AS total,
       min(ts_utc) AS first_ts, max(ts_utc) AS last_ts
FROM counts GROUP BY 1, 2, 3""", FAM)
def hourly_counts(spark, sf_dir):
    """A81 (group membership, null keys kept) over the count series."""
    return (counts(spark, sf_dir).groupBy("counter_id", "site", "orientation")
            .agg(F.count(F.lit(1)).alias("n_hours"),
                 F.sum("hourly_count").cast("bigint").alias("total"),
                 F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts")))


@query("scenario_slices", with_views("counts") + """,
sc AS (SELECT * FROM (VALUES ('integration', 0.0, 15.0), ('day1', 0.5, 15.5), ('day2', 1.0, 15.0), ('reversed', 80.0, 20.0)) t(scenario, start_pct, end_pct)),
r AS (SELECT counter_id, ts_utc, hourly_count,
        row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts)
SELECT sc.scenario, r.counter_id, r.ts_utc, r.hourly_count, r.rn
FROM r CROSS JOIN sc
WHERE sc.start_pct < sc.end_pct
  AND r.rn - 1 >= CAST(floor(CAST(r.n AS DOUBLE) * (CAST(sc.start_pct AS DOUBLE) / 100.0)) AS BIGINT)
  AND r.rn - 1 <  CAST(floor(CAST(r.n AS DOUBLE) * (CAST(sc.end_pct AS DOUBLE) / 100.0)) AS BIGINT)""", FAM)
def scenario_slices(spark, sf_dir):
    """A9 + A23 + A24: every scenario's percent slice of every counter in one plan.

    The scenarios are a fixed handful of configured runs: each row is fanned
    out over a literal array (no join, no shuffle) and filtered at once.
    """
    numbered = seq.number_rows(counts(spark, sf_dir))
    fanned = numbered.withColumn("sc", F.explode(scenario_array())).select("*", "sc.*")
    keep = seq.percent_slice_filter(F.col("rn"), F.col("n"), F.col("start_pct"), F.col("end_pct"))
    return (fanned.filter(keep)
            .select("scenario", "counter_id", "ts_utc", "hourly_count", "rn"))


@query("time_split", with_views("counts") + """,
r AS (SELECT counter_id, ts_utc, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts)
SELECT counter_id, rn > n - CAST(floor(CAST(n AS DOUBLE) * 0.25) AS BIGINT) AS is_test,
       count(*) AS n_rows, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts
FROM r GROUP BY 1, 2""", FAM)
def time_split(spark, sf_dir):
    """Chronological train/test split sizes per counter."""
    s = seq.time_split(counts(spark, sf_dir), TEST_RATIO)
    return (s.groupBy("counter_id", "is_test")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts_utc").alias("first_ts"),
                 F.max("ts_utc").alias("last_ts")))


def _lag_sql(k):
    return f"CAST(lag(hourly_count, {k}) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS DOUBLE) AS target_ar_{k}"


@query("ar_features", with_views("counts") + """
SELECT counter_id, ts_utc, hourly_count, """ + ", ".join(_lag_sql(k) for k in range(1, NB_AR + 1)) + """,
  round(CASE WHEN count(*) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) = 24
       THEN avg(hourly_count) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END, 6) AS target_mm_24_1,
  round(CASE WHEN count(*) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) = 48
       THEN avg(hourly_count) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) END, 6) AS target_mm_24_2
FROM counts""", FAM)
def ar_features(spark, sf_dir):
    """A29 + A30: 7 lags and two trailing means (24 and 48 rows), one window spec."""
    f = seq.add_ar_features(counts(spark, sf_dir), NB_AR, 2, ROLL)
    return round_doubles(f.select("counter_id", "ts_utc", "hourly_count",
                                  *[f"target_ar_{k}" for k in range(1, NB_AR + 1)],
                                  "target_mm_24_1", "target_mm_24_2"))


@query("complete_case", with_views("counts") + """,
f AS (SELECT counter_id, ts_utc, hourly_count,
  row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
  count(*) OVER (PARTITION BY counter_id) AS n,
  """ + ", ".join(_lag_sql(k) for k in range(1, NB_AR + 1)) + """,
  CASE WHEN count(*) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) = 24
       THEN avg(hourly_count) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS target_mm_24_1
  FROM counts)
SELECT counter_id, count(*) AS n_train_rows, min(ts_utc) AS first_ts,
       CAST(sum(hourly_count) AS BIGINT) AS y_sum
FROM f WHERE rn <= n - CAST(floor(CAST(n AS DOUBLE) * 0.25) AS BIGINT)
  AND """ + " AND ".join(f"target_ar_{k} IS NOT NULL" for k in range(1, NB_AR + 1)) + """
  AND target_mm_24_1 IS NOT NULL
GROUP BY counter_id""", FAM)
def complete_case(spark, sf_dir):
    """A19 + A20 + A25: training rows with every AR feature present.

    As in the reference, features are computed on the training split only,
    so the first test rows never borrow training lags here.
    """
    s = seq.time_split(counts(spark, sf_dir), TEST_RATIO).filter(~F.col("is_test"))
    f = seq.add_ar_features(s, NB_AR, NB_MM, ROLL)
    feats = [f"target_ar_{k}" for k in range(1, NB_AR + 1)] + ["target_mm_24_1"]
    cc = seq.complete_case(f, feats)
    return cc.groupBy("counter_id").agg(F.count(F.lit(1)).alias("n_train_rows"),
                                        F.min("ts_utc").alias("first_ts"),
                                        F.sum("hourly_count").cast("bigint").alias("y_sum"))


@query("cv_folds", with_views("counts") + """,
r AS (SELECT counter_id, ts_utc, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts),
x AS (SELECT r.*, fold, n // 6 AS ts_size FROM r CROSS JOIN range(0, 5) t(fold)),
y AS (SELECT counter_id, CAST(fold AS INTEGER) AS fold, rn,
        CASE WHEN rn <= n - (5 - fold) * ts_size THEN 'train'
             WHEN rn <= n - (4 - fold) * ts_size THEN 'test' END AS role FROM x)
SELECT counter_id, fold, role, count(*) AS n_rows, min(rn) AS first_rn, max(rn) AS last_rn
FROM y WHERE role IS NOT NULL GROUP BY 1, 2, 3""", FAM)
def cv_folds(spark, sf_dir):
    """Expanding-window fold assignment, 5 splits, test size n // 6."""
    f = seq.cv_folds(counts(spark, sf_dir), 5)
    return (f.groupBy("counter_id", F.col("fold").cast("int").alias("fold"), "role")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("rn").cast("bigint").alias("first_rn"),
                 F.max("rn").cast("bigint").alias("last_rn")))


def _cal_sql(src, p):
    loc = PARIS_SQL.format(c=src)
    parts = {"year": f"year({loc})", "month": f"month({loc})", "day": f"day({loc})",
             "day_of_year": f"dayofyear({loc})", "day_of_week": f"isodow({loc}) - 1",
             "hour": f"hour({loc})", "week": f"weekofyear({loc})"}
    cols = [f"{loc} AS {p}_local"]
    cols += [f"CAST({v} AS INTEGER) AS {p}_{k}" for k, v in parts.items()]
    cols.append(f"CASE WHEN isodow({loc}) IN (6, 7) THEN 1 ELSE 0 END AS {p}_week_end")
    for k, period in (("hour", 24), ("day_of_week", 7), ("month", 12), ("week", 52), ("day_of_year", 365)):
        cols.append(f"round(sin(2 * pi() * ({parts[k]}) / {period}.0), 9) + 0.0 AS {p}_sin_{k}")
        cols.append(f"round(cos(2 * pi() * ({parts[k]}) / {period}.0), 9) + 0.0 AS {p}_cos_{k}")
    return ",\n  ".join(cols)


def _round_trig(df, digits=9):
    # "+ 0.0" turns a rounded -0.0 into 0.0 so both engines hash the same value
    cols = [round_scaled(F.col(c), digits).alias(c) if ("_sin_" in c or "_cos_" in c) else F.col(c)
            for c in df.columns]
    return df.select(*cols)


@query("calendar_features", with_views("counts") + f"""
SELECT counter_id, ts_utc, {_cal_sql('ts_utc', 'ts')}
FROM counts""", FAM)
def calendar_features(spark, sf_dir):
    """A34–A40 (+ A17 drop of the source column happens in the model frame)."""
    c = counts(spark, sf_dir).select("counter_id", "ts_utc")
    return _round_trig(add_calendar(c, "ts_utc", prefix="ts"))


@query("calendar_orders", f"""
SELECT o_orderkey, o_orderdate, {_cal_sql('o_orderdate', 'od')}
FROM orders""", FAM)
def calendar_orders(spark, sf_dir):
    """A35–A40 across six years of DST changes (orders span 1995–2001)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return _round_trig(add_calendar(o, "o_orderdate", prefix="od"))


@query("dst_quarantine", """
WITH l AS (SELECT o_orderkey, o_orderdate + INTERVAL 150 MINUTE AS local_ts FROM orders),
s AS (SELECT o_orderkey, local_ts,
        timezone('Europe/Paris', timezone('UTC', timezone('UTC', timezone('Europe/Paris', local_ts)))) AS back,
        timezone('Europe/Paris', timezone('UTC', timezone('UTC', timezone('Europe/Paris', local_ts)) - INTERVAL 1 HOUR)) AS before,
        timezone('Europe/Paris', timezone('UTC', timezone('UTC', timezone('Europe/Paris', local_ts)) + INTERVAL 1 HOUR)) AS after
      FROM l)
SELECT CASE WHEN back <> local_ts THEN 'nonexistent'
            WHEN before = local_ts OR after = local_ts THEN 'ambiguous' ELSE 'ok' END AS dst_status,
       count(*) AS n_rows, count(DISTINCT CAST(local_ts AS DATE)) AS n_days
FROM s GROUP BY 1""", FAM)
def dst_quarantine(spark, sf_dir):
    """Local 02:30 on every order date; DST gap -> nonexistent, fall-back -> ambiguous."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.timestamp_add("MINUTE", F.lit(150), F.col("o_orderdate")).alias("local_ts"))
    return (o.withColumn("dst_status", dst_status("local_ts"))
            .groupBy("dst_status").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.countDistinct(F.to_date("local_ts")).alias("n_days")))


@query("kpi_samples", with_views("counts") + """, f AS (
  SELECT counter_id, ts_utc, hourly_count,
    row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
    count(*) OVER (PARTITION BY counter_id) AS n,
    CAST(lag(hourly_count, 24) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS DOUBLE) AS p
  FROM counts),
g AS (SELECT counter_id,
    sqrt(sum(CASE WHEN rn > n - n // 4 THEN (hourly_count - p) * (hourly_count - p) END)
         / count(CASE WHEN rn > n - n // 4 THEN hourly_count - p END)) AS rmse,
    avg(CASE WHEN rn > n - n // 4 THEN abs(hourly_count - p) / greatest(abs(hourly_count), 1e-6) END) * 100 AS mape,
    count(CASE WHEN rn > n - n // 4 THEN hourly_count - p END) AS n_obs,
    1.0 - sum(CASE WHEN rn > n - n // 4 THEN (hourly_count - p) * (hourly_count - p) END)
      / nullif(sum(CASE WHEN rn > n - n // 4 AND p IS NOT NULL THEN p * p END)
               - sum(CASE WHEN rn > n - n // 4 AND p IS NOT NULL THEN p END) * sum(CASE WHEN rn > n - n // 4 AND p IS NOT NULL THEN p END)
                 / count(CASE WHEN rn > n - n // 4 THEN hourly_count - p END), 0.0) AS r2_ref,
    count(CASE WHEN rn > n - n // 4 THEN hourly_count END) AS n_true, count(CASE WHEN rn > n - n // 4 THEN p END) AS n_pred,
    max(ts_utc) AS last_ts, min(ts_utc) AS first_ts
  FROM f GROUP BY counter_id),
h AS (SELECT g.*, (epoch_us(max(last_ts) OVER ()) - epoch_us(last_ts)) / 86400000000.0 AS freshness_days,
             floor((epoch_us(last_ts) - epoch_us(min(first_ts) OVER ())) / 86400000000.0) AS day_offset_days FROM g)
SELECT counter_id, metric, kind, round(value, 6) AS value FROM (
  SELECT counter_id, 'bike_rmse' AS metric, CAST(NULL AS VARCHAR) AS kind, rmse AS value FROM h UNION ALL
  SELECT counter_id, 'bike_mape', NULL, mape FROM h UNION ALL
  SELECT counter_id, 'bike_r2', NULL, r2_ref FROM h UNION ALL
  SELECT counter_id, 'bike_obs_count', 'true', CAST(n_true AS DOUBLE) FROM h UNION ALL
  SELECT counter_id, 'bike_obs_count', 'pred', CAST(n_pred AS DOUBLE) FROM h UNION ALL
  SELECT counter_id, 'bike_data_freshness_days', NULL, freshness_days FROM h UNION ALL
  SELECT counter_id, 'bike_data_day_offset_days', NULL, day_offset_days FROM h UNION ALL
  SELECT counter_id, 'bike_threshold_mape', NULL, CASE WHEN mape >= 60 THEN 2 WHEN mape >= 30 THEN 1 ELSE 0 END FROM h)""", FAM)
def kpi_samples(spark, sf_dir):
    """A41 + A78 + A79 + B14: per-counter KPIs unpivoted to metric samples.

    ``bike_threshold_mape`` is the dashboard class (0 green, 1 amber, 2 red).
    The as-of for freshness is the latest hour seen over all counters: a
    global max over the small per-counter table (one row per counter).
    """
    f = _features(spark, sf_dir)
    is_test = F.col("rn") > F.col("n") - seq.n_test(F.col("n"), TEST_RATIO)
    e = F.col("hourly_count") - F.col("seasonal_pred")
    g = f.groupBy("counter_id").agg(
        F.sqrt(F.sum(F.when(is_test, e * e)) / F.count(F.when(is_test, e))).alias("rmse"),
        (F.avg(F.when(is_test, F.abs(e) / F.greatest(F.abs(F.col("hourly_count")), F.lit(1e-6))))
         * 100).alias("mape"),
        F.count(F.when(is_test, e)).alias("n_obs"),
        # the published R² is relative to the prediction's variance (arguments swapped)
        (F.lit(1.0) - F.sum(F.when(is_test, e * e))
         / F.nullif(F.sum(F.when(is_test & F.col("seasonal_pred").isNotNull(), F.col("seasonal_pred") ** 2))
                    - F.sum(F.when(is_test, F.col("seasonal_pred"))) ** 2 / F.count(F.when(is_test, e)),
                    F.lit(0.0))).alias("r2_ref"),
        F.count(F.when(is_test, F.col("hourly_count"))).alias("n_true"),
        F.count(F.when(is_test, F.col("seasonal_pred"))).alias("n_pred"),
        F.max("ts_utc").alias("last_ts"), F.min("ts_utc").alias("first_ts"))
    # global as-of as a scalar subquery: no global window, no join
    asof, anchor = g.agg(F.max("last_ts")).scalar(), g.agg(F.min("first_ts")).scalar()
    h = g.withColumns({
        "freshness_days": freshness_days("last_ts", asof),
        # whole days from the anchor (the first hour of any counter)
        "day_offset_days": F.floor(freshness_days(anchor, F.col("last_ts"))).cast("double"),
        "mape_class": F.when(F.col("mape") >= 60, 2.0).when(F.col("mape") >= 30, 1.0).otherwise(0.0),
    })
    gauges = [(m, "r2_ref" if c == "r2" else c) for m, c in KPI_GAUGES] + [(MAPE_CLASS_METRIC, "mape_class")]
    samples = kpi_unpivot(h, ["counter_id"], gauges).withColumn("kind", F.lit(None).cast("string"))
    observed = h.unpivot(["counter_id"], [F.col("n_true").cast("double").alias("true"),
                                          F.col("n_pred").cast("double").alias("pred")], "kind", "value")
    observed = observed.withColumn("metric", F.lit(OBS_COUNT_METRIC))
    return round_doubles(samples.unionByName(observed).select("counter_id", "metric", "kind", "value"))


@query("clamped_window_bounds", """
WITH d AS (SELECT DISTINCT o_orderdate FROM orders),
x AS (SELECT o_orderdate, (epoch_us(o_orderdate) - epoch_us(min(o_orderdate) OVER ())) / 86400000000.0 AS days FROM d)
SELECT o_orderdate, CAST(days AS BIGINT) AS days,
       round(greatest(0.0, least(100.0, greatest(0.0, days * 0.25))), 2) AS start_pct,
       round(greatest(0.0, least(100.0, 75.0 + greatest(0.0, days * 0.25))), 2) AS end_pct
FROM x""", FAM)
def clamped_window_bounds(spark, sf_dir):
    """A42 over every distinct order date: shift = days * 0.25, clamp to [0, 100]."""
    o = table(spark, sf_dir, "orders").select("o_orderdate")
    anchor = o.agg(F.min("o_orderdate")).scalar()
    x = o.distinct().withColumn("days", freshness_days(anchor, F.col("o_orderdate")))
    shift = F.greatest(F.lit(0.0), F.col("days") * 0.25)
    return x.select("o_orderdate", F.col("days").cast("bigint").alias("days"),
                    clamp_round(shift).alias("start_pct"),
                    clamp_round(F.lit(75.0) + shift).alias("end_pct"))
