"""Alert queries (B20–B22) over samples, the access log and the job log."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.operators import alerts as A
from hourcast.operators.metrics import hour_bucket
from hourcast.sources.tables import access_log, samples, with_views

FAM = "alerts"
HOUR_SQL = "CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT)"

# Scaled rule parameters.  The rules hold ``up == 0`` for 30 s and count
# ``changes(up[5m]) > 3`` for 1 m at a 5 s scrape; the samples here arrive
# minutes apart per instance, so the same rules run with minutes/hours.
HOLD_MINUTES = 30
CHANGES_RANGE_HOURS = 3
CHANGES_THRESHOLD = 3
# Repeat interval per severity (critical 15 s, warning 1 h,
# anything else 5 m).
REPEAT_SECONDS = {"critical": 15, "warning": 3600, None: 300}


@query("held_alert", with_views("samples") + f""",
s AS (SELECT instance, ts, event_id, up = 0 AS cond,
        row_number() OVER (PARTITION BY instance ORDER BY ts, event_id) AS n_all,
        sum(CASE WHEN up = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instance ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_true FROM samples)
SELECT instance, CAST(n_all - n_true AS BIGINT) AS island, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_samples,
       epoch_us(max(ts)) - epoch_us(min(ts)) >= {HOLD_MINUTES * 60_000_000} AS fired
FROM s WHERE cond GROUP BY instance, n_all - n_true""", FAM)
def held_alert(spark, sf_dir):
    """``up == 0`` held for the hold time, per instance over all jobs."""
    s = samples(spark, sf_dir, with_counter=False).withColumn("bucket", hour_bucket())
    return A.held(s, ["instance"], ["ts", "event_id"], "bucket", F.col("up") == 0,
                  HOLD_MINUTES * 60_000_000)


@query("changes_alert", with_views("samples") + f""",
s AS (SELECT instance, ts, event_id, up, {HOUR_SQL} AS bucket,
        lag(up) OVER (PARTITION BY instance ORDER BY ts, event_id) AS prev FROM samples),
b AS (SELECT instance, bucket, CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> up THEN 1 ELSE 0 END) AS BIGINT) AS n,
        arg_min(CASE WHEN prev IS NOT NULL AND prev <> up THEN 1 ELSE 0 END, (ts, event_id)) AS first_flag
      FROM s GROUP BY 1, 2),
c AS (SELECT instance, bucket, CAST(sum(n) OVER w - first_value(first_flag) OVER w AS BIGINT) AS changes
      FROM b WINDOW w AS (PARTITION BY instance ORDER BY bucket RANGE BETWEEN {CHANGES_RANGE_HOURS - 1} PRECEDING AND CURRENT ROW)),
d AS (SELECT *, changes > {CHANGES_THRESHOLD} AS condition,
        lag(changes > {CHANGES_THRESHOLD}) OVER (PARTITION BY instance ORDER BY bucket) AS pc,
        lag(bucket) OVER (PARTITION BY instance ORDER BY bucket) AS pb FROM c)
SELECT instance, bucket, changes, condition, condition AND coalesce(pc, false) AND pb = bucket - 1 AS fired FROM d""", FAM)
def changes_alert(spark, sf_dir):
    """``changes(up[range]) > 3`` held for one evaluation step."""
    s = samples(spark, sf_dir, with_counter=False).withColumn("bucket", hour_bucket())
    ch = A.changes(s, ["instance"], ["ts", "event_id"], "bucket", "up", CHANGES_RANGE_HOURS)
    out = A.held_steps(ch, ["instance"], "bucket", F.col("changes") > CHANGES_THRESHOLD)
    return out.select("instance", "bucket", "changes", "condition", "fired")


def alert_events(spark, sf_dir):
    """Firing events: instance down (critical), auth failures (warning) and
    slow requests (no severity).  ``alert_id`` is unique across sources."""
    s = samples(spark, sf_dir, with_counter=False).filter(F.col("up") == 0).select(
        F.lit("InstanceDown").alias("alertname"), F.lit("critical").alias("severity"), "ts",
        (F.col("event_id") * 4).alias("alert_id"))
    a = access_log(spark, sf_dir)
    auth = a.filter(F.col("status") == 403).select(
        F.lit("AuthFailures").alias("alertname"), F.lit("warning").alias("severity"), "ts",
        (F.col("event_id") * 4 + 1).alias("alert_id"))
    slow = a.filter(F.col("seconds") > 3.0).select(
        F.lit("HighLatency").alias("alertname"), F.lit(None).cast("string").alias("severity"), "ts",
        (F.col("event_id") * 4 + 2).alias("alert_id"))
    return s.unionByName(auth).unionByName(slow)


ALERT_EVENTS_SQL = with_views("samples", "access_log") + """,
ev AS (
  SELECT 'InstanceDown' AS alertname, ts, event_id * 4 AS alert_id, 15000000 AS repeat_us FROM samples WHERE up = 0
  UNION ALL SELECT 'AuthFailures', ts, event_id * 4 + 1, 3600000000 FROM access_log WHERE status = 403
  UNION ALL SELECT 'HighLatency', ts, event_id * 4 + 2, 300000000 FROM access_log WHERE seconds > 3.0),
u AS (SELECT alertname, ts AS t, 1 AS kind, alert_id AS eid, NULL::BIGINT AS src FROM ev
      UNION ALL SELECT alertname, ts + to_microseconds(repeat_us), 0, NULL, alert_id FROM ev),
nx AS (SELECT alertname, src AS alert_id, nxt FROM (
         SELECT *, first_value(eid IGNORE NULLS) OVER (PARTITION BY alertname ORDER BY t, kind, eid
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM u) WHERE kind = 0),
chain AS (
  SELECT alertname, arg_min(alert_id, (ts, alert_id)) AS alert_id FROM ev GROUP BY alertname
  UNION ALL
  SELECT n.alertname, n.nxt FROM chain c JOIN nx n ON n.alert_id = c.alert_id WHERE n.nxt IS NOT NULL)
"""


@query("alert_throttle", "WITH RECURSIVE" + ALERT_EVENTS_SQL[len("WITH"):] + """
SELECT e.alertname, e.ts, e.alert_id FROM ev e JOIN chain c ON e.alert_id = c.alert_id""", FAM)
def alert_throttle(spark, sf_dir):
    """Grouped notifications with a per-severity repeat interval."""
    ev = alert_events(spark, sf_dir)
    rep = F.lit(REPEAT_SECONDS[None] * 1_000_000)
    for severity in ("critical", "warning"):
        rep = F.when(F.col("severity") == severity, F.lit(REPEAT_SECONDS[severity] * 1_000_000)).otherwise(rep)
    sent = A.throttle(spark, ev, ["alertname"], "ts", "alert_id", rep)
    return sent.select("alertname", "ts", F.col("eid").alias("alert_id"))
