"""Run planning and job-contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.functions.numeric import round_scaled
from hourcast.functions import labels as L
from hourcast.operators import ledger as LG
from hourcast.operators import validate as V
from hourcast.plans import window_plan as WP
from hourcast.sources.tables import counts, job_log, materialize, table, with_views

FAM = "runs"


def _plan(spark, sf_dir, c=None):
    c = c if c is not None else materialize(counts(spark, sf_dir))
    act = c.groupBy("counter_id").agg(F.to_date(F.min("ts_utc")).alias("first_day"),
                                      F.to_date(F.max("ts_utc")).alias("last_day"))
    anchor = act.agg(F.min("first_day")).scalar()
    return WP.window_plan(act, anchor)


PLAN_SQL = with_views("counts") + """,
act AS (SELECT counter_id, CAST(min(ts_utc) AS DATE) AS d0, CAST(max(ts_utc) AS DATE) AS d1 FROM counts GROUP BY 1),
anc AS (SELECT min(d0) AS anchor FROM act),
days AS (SELECT counter_id, CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS run_day FROM act),
pd AS (SELECT counter_id, run_day, CAST(datediff('day', anchor, run_day) AS INTEGER) AS delta_days,
         greatest(0.0, CAST(datediff('day', anchor, run_day) AS DOUBLE) * 0.25) AS shift FROM days, anc),
plan AS (
  SELECT counter_id, 'daily' AS mode, run_day, delta_days,
    CAST(round(greatest(0.0, least(100.0, shift)), 2) AS DOUBLE) AS start_pct,
    CAST(round(greatest(0.0, least(100.0, 75.0 + shift)), 2) AS DOUBLE) AS end_pct,
    round(greatest(0.0, least(100.0, 75.0 + shift)), 2) > 75.0 AS proceed
  FROM pd
  UNION ALL
  SELECT counter_id, 'init', d0, 0, 0.0, 75.0, true FROM act)
"""


@query("window_plan", PLAN_SQL + """
SELECT counter_id, mode, CAST(run_day AS TIMESTAMP) AS run_day, delta_days, start_pct, end_pct, proceed,
       counter_id || '_day' || CAST(delta_days AS VARCHAR) AS sub_dir FROM plan""", FAM)
def window_plan(spark, sf_dir):
    """A42 + A67 + A76: bootstrap and daily sliding windows of every counter."""
    p = _plan(spark, sf_dir)
    return p.withColumn("run_day", F.col("run_day").cast("timestamp_ntz"))


@query("sliced_by_plan", PLAN_SQL + """,
r AS (SELECT counter_id, ts_utc, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts),
nn AS (SELECT counter_id, max(n) AS n FROM r GROUP BY 1),
b AS (SELECT plan.*, nn.n,
        CAST(floor(CAST(nn.n AS DOUBLE) * (start_pct / 100.0)) AS BIGINT) AS lo,
        CAST(floor(CAST(nn.n AS DOUBLE) * (end_pct / 100.0)) AS BIGINT) AS hi
      FROM plan JOIN nn ON plan.counter_id = nn.counter_id WHERE proceed),
c AS (SELECT *, CAST(CASE WHEN start_pct < end_pct AND hi > lo THEN hi - lo ELSE 0 END AS BIGINT) AS n_rows FROM b)
SELECT c.counter_id, c.mode, CAST(c.run_day AS TIMESTAMP) AS run_day, c.delta_days, c.start_pct, c.end_pct, c.proceed,
  c.counter_id || '_day' || CAST(c.delta_days AS VARCHAR) AS sub_dir, c.n_rows,
  f.ts_utc AS first_ts, l.ts_utc AS last_ts
FROM c LEFT JOIN r f ON c.counter_id = f.counter_id AND f.rn = CASE WHEN c.n_rows > 0 THEN c.lo + 1 END
LEFT JOIN r l ON c.counter_id = l.counter_id AND l.rn = CASE WHEN c.n_rows > 0 THEN c.hi END""", FAM)
def sliced_by_plan(spark, sf_dir):
    """A24 + A76: every planned run's slice, all counters and days in one plan."""
    c = materialize(counts(spark, sf_dir))  # one pass over events for plan and slices
    p = _plan(spark, sf_dir, c)
    out = WP.sliced_by_plan(p, c)
    return out.withColumn("run_day", F.col("run_day").cast("timestamp_ntz")).select(
        "counter_id", "mode", "run_day", "delta_days", "start_pct", "end_pct", "proceed", "sub_dir",
        "n_rows", "first_ts", "last_ts")


def _job_requests(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    jt = (F.when(F.col("event_type") == "click", "ingest").when(F.col("event_type") == "view", "features")
          .when(F.col("event_type") == "purchase", "models").otherwise(F.col("event_type")))
    start = round_scaled(F.col("value") % 100, 2)
    return ev.select(
        jt.alias("job_type"), F.col("user_id").cast("string").alias("counter_id"),
        F.date_format("ts", "yyyyMMdd").alias("run_id"),
        start.alias("start_pct"), (start + (F.col("user_id") % 40) - 5).alias("end_pct"),
        (F.col("user_id") % 9 - 1).alias("ar"), (F.col("user_id") % 3).alias("mm"),
        (F.col("user_id") % 25).alias("roll"), (F.col("user_id") % 4 - 1).alias("grid"),
        ((F.col("user_id") % 20) / 20.0).alias("test_ratio"), (F.col("event_id") % 4).alias("try_number"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                 F.when(F.col("event_type") == "view", "").otherwise("+00:00")).alias("requested_at"),
        F.when(F.col("user_id") % 7 == 0, F.lit("data/../raw.csv"))
        .otherwise(F.concat(F.lit("/data/raw/"), F.col("user_id").cast("string"), F.lit(".csv"))).alias("input_path"),
        F.when(F.col("user_id") % 11 == 0, F.lit("s3://user@bucket/x"))
        .otherwise(F.lit("s3://bucket/models/m.json")).alias("model_uri"))


def request_violations():
    jt = F.col("job_type")
    ingest, models = jt == "ingest", jt == "models"
    path_err = L.local_path_error(F.col("input_path"), allow_absolute=True)
    uri_err = L.object_uri_error(F.col("model_uri"))
    return V.violations([
        ("job_type", ~F.coalesce(jt.isin(*LG.JOB_TYPES), F.lit(False))),
        ("counter_id", F.coalesce(F.trim("counter_id"), F.lit("")) == ""),
        ("run_id", F.coalesce(F.trim("run_id"), F.lit("")) == ""),
        ("try_number", F.coalesce(F.col("try_number"), F.lit(0)) < 1),
        ("requested_at_naive", ~F.coalesce(F.col("requested_at"), F.lit("")).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")),
        ("percent_bounds", ingest & ((F.col("start_pct") < 0) | (F.col("end_pct") > 100))),
        ("start_not_before_end", ingest & (F.col("start_pct") >= F.col("end_pct"))),
        ("ar", models & (F.col("ar") < 0)), ("mm", models & (F.col("mm") < 0)),
        ("roll", models & (F.col("roll") < 1)), ("grid", models & (F.col("grid") < 0)),
        ("test_ratio", models & ((F.col("test_ratio") <= 0) | (F.col("test_ratio") >= 0.95))),
        ("input_path", path_err.isNotNull()),
        ("model_uri", models & uri_err.isNotNull()),
    ])


@query("request_rules", r"""
WITH r AS (SELECT CASE event_type WHEN 'click' THEN 'ingest' WHEN 'view' THEN 'features' WHEN 'purchase' THEN 'models' ELSE event_type END AS job_type,
    CAST(user_id AS VARCHAR) AS counter_id, strftime(ts, '%Y%m%d') AS run_id,
    round(value % 100, 2) AS start_pct, round(value % 100, 2) + (user_id % 40) - 5 AS end_pct,
    user_id % 9 - 1 AS ar, user_id % 3 AS mm, user_id % 25 AS roll, user_id % 4 - 1 AS grid,
    (user_id % 20) / 20.0 AS test_ratio, event_id % 4 AS try_number,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_type = 'view' THEN '' ELSE '+00:00' END AS requested_at,
    CASE WHEN user_id % 7 = 0 THEN 'data/../raw.csv' ELSE '/data/raw/' || CAST(user_id AS VARCHAR) || '.csv' END AS input_path,
    CASE WHEN user_id % 11 = 0 THEN 's3://user@bucket/x' ELSE 's3://bucket/models/m.json' END AS model_uri
  FROM events),
v AS (SELECT job_type, concat_ws(',',
    CASE WHEN job_type IS NULL OR job_type NOT IN ('ingest', 'features', 'models') THEN 'job_type' END,
    CASE WHEN coalesce(trim(counter_id), '') = '' THEN 'counter_id' END,
    CASE WHEN coalesce(trim(run_id), '') = '' THEN 'run_id' END,
    CASE WHEN coalesce(try_number, 0) < 1 THEN 'try_number' END,
    CASE WHEN NOT regexp_matches(coalesce(requested_at, ''), '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN 'requested_at_naive' END,
    CASE WHEN job_type = 'ingest' AND (start_pct < 0 OR end_pct > 100) THEN 'percent_bounds' END,
    CASE WHEN job_type = 'ingest' AND start_pct >= end_pct THEN 'start_not_before_end' END,
    CASE WHEN job_type = 'models' AND ar < 0 THEN 'ar' END,
    CASE WHEN job_type = 'models' AND mm < 0 THEN 'mm' END,
    CASE WHEN job_type = 'models' AND roll < 1 THEN 'roll' END,
    CASE WHEN job_type = 'models' AND grid < 0 THEN 'grid' END,
    CASE WHEN job_type = 'models' AND (test_ratio <= 0 OR test_ratio >= 0.95) THEN 'test_ratio' END,
    CASE WHEN input_path = '' OR regexp_matches(input_path, '^[A-Za-z][A-Za-z0-9+.\-]*:')
           OR list_contains(string_split(input_path, '/'), '..') THEN 'input_path' END,
    CASE WHEN job_type = 'models' AND (lower(regexp_extract(model_uri, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) <> 's3'
           OR regexp_extract(model_uri, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) = ''
           OR regexp_extract(model_uri, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) IN ('', '/')
           OR contains(regexp_extract(model_uri, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '@')) THEN 'model_uri' END
  ) AS violations FROM r)
SELECT job_type, violations, violations = '' AS is_valid, count(*) AS n_requests FROM v GROUP BY 1, 2""", FAM)
def request_rules(spark, sf_dir):
    """A57 (+ A51 job variant, A52): rule-by-rule validation of typed job
    requests, discriminated by ``job_type``."""
    r = _job_requests(spark, sf_dir).withColumn("_v", request_violations())
    return (r.groupBy("job_type", F.array_join("_v", ",").alias("violations"))
            .agg(F.count(F.lit(1)).alias("n_requests"))
            .withColumn("is_valid", F.col("violations") == "")
            .select("job_type", "violations", "is_valid", "n_requests"))


@query("status_rules", with_views("job_log") + """,
j AS (SELECT job_id, arg_max(state, (updated_at, event_id)) AS state, min(updated_at) AS requested_at,
        max(updated_at) AS updated_at, min(updated_at) FILTER (WHERE state = 'running') AS started_at,
        max(updated_at) FILTER (WHERE state IN ('succeeded', 'failed')) AS finished_at,
        count(*) FILTER (WHERE state = 'succeeded') > 0 AS has_result,
        count(*) FILTER (WHERE state = 'failed') > 0 AS has_error,
        count(*) FILTER (WHERE state = 'succeeded') - count(*) FILTER (WHERE state = 'failed') AS records
      FROM job_log GROUP BY 1)
SELECT job_id, state, concat_ws(',',
    CASE WHEN updated_at < requested_at THEN 'updated_before_requested' END,
    CASE WHEN state = 'succeeded' AND NOT has_result THEN 'succeeded_without_result' END,
    CASE WHEN state = 'failed' AND NOT has_error THEN 'failed_without_error' END,
    CASE WHEN state <> 'failed' AND has_error THEN 'error_on_non_failed' END,
    CASE WHEN state NOT IN ('succeeded', 'failed', 'canceled', 'expired') AND has_result THEN 'result_on_non_terminal' END,
    CASE WHEN finished_at < started_at THEN 'finished_before_started' END,
    CASE WHEN records < 0 THEN 'negative_records' END) AS violations
FROM j""", FAM)
def status_rules(spark, sf_dir):
    """Consistency of job status records built from the transition log."""
    jl = job_log(spark, sf_dir)
    st = F.col("state")
    j = jl.groupBy("job_id").agg(
        F.max_by("state", F.struct("updated_at", "event_id")).alias("state"),
        F.min("updated_at").alias("requested_at"), F.max("updated_at").alias("updated_at"),
        F.min(F.when(st == "running", F.col("updated_at"))).alias("started_at"),
        F.max(F.when(st.isin("succeeded", "failed"), F.col("updated_at"))).alias("finished_at"),
        (F.count(F.when(st == "succeeded", 1)) > 0).alias("has_result"),
        (F.count(F.when(st == "failed", 1)) > 0).alias("has_error"),
        (F.count(F.when(st == "succeeded", 1)) - F.count(F.when(st == "failed", 1))).alias("records"))
    s = F.col("state")
    v = V.violations([
        ("updated_before_requested", F.col("updated_at") < F.col("requested_at")),
        ("succeeded_without_result", (s == "succeeded") & ~F.col("has_result")),
        ("failed_without_error", (s == "failed") & ~F.col("has_error")),
        ("error_on_non_failed", (s != "failed") & F.col("has_error")),
        ("result_on_non_terminal", ~s.isin(*LG.TERMINAL_STATES) & F.col("has_result")),
        ("finished_before_started", F.col("finished_at") < F.col("started_at")),
        ("negative_records", F.col("records") < 0),
    ])
    return j.select("job_id", "state", F.array_join(v, ",").alias("violations"))
