"""Streaming queries (S1–S5): each stream runs to completion over the files
(``availableNow``) into a Parquet table and is checked against SQL that
reproduces its windowed / watermarked semantics on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.alerting import HOLD_MINUTES
from hourcast.catalog.registry import query
from hourcast.functions.numeric import round_scaled
from hourcast.functions.timecols import instant_to_utc_ntz
from hourcast.session import ensure_checkpoint_dir
from hourcast.sources.tables import with_views
from hourcast.streaming import streams as ST

FAM = "streaming"
LOOKBACK_HOURS = 2


@query("stream_hourly_counts", f"""
WITH e AS (SELECT concat(event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END) AS counter_id,
             date_trunc('hour', ts) AS window_start, ts FROM events),
wm AS (SELECT max(ts) - INTERVAL {LOOKBACK_HOURS} HOUR AS watermark FROM events)
SELECT counter_id, window_start, count(*) AS hourly_count
FROM e, wm WHERE window_start + INTERVAL 1 HOUR <= wm.watermark GROUP BY 1, 2""", FAM)
def stream_hourly_counts(spark, sf_dir):
    """Tumbling hourly counts per counter in append mode; a window is
    emitted once the watermark (max event time - 2 h) has passed its end."""
    ensure_checkpoint_dir(spark)
    s = ST.hourly_counts(ST.events_stream(spark, sf_dir), f"{LOOKBACK_HOURS} hours")
    out = ST.run_to_table(s, "s1_hourly_counts")
    return out.select("counter_id", instant_to_utc_ntz("window_start").alias("window_start"),
                      "hourly_count")


@query("stream_sliding_means", f"""
WITH e AS (SELECT event_type AS job, ts, value, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS up,
             time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events),
w AS (SELECT job, b - to_minutes(5 * k) AS window_start, value, up FROM e, range(0, 12) t(k)),
wm AS (SELECT max(ts) - INTERVAL {LOOKBACK_HOURS} HOUR AS watermark FROM events)
SELECT job, window_start, round(avg(value), 6) AS mean_value, round(avg(up) * 100, 6) AS availability_pct,
       count(*) AS n_samples
FROM w, wm WHERE window_start + INTERVAL 1 HOUR <= wm.watermark GROUP BY 1, 2""", FAM)
def stream_sliding_means(spark, sf_dir):
    """1 h windows sliding every 5 min – mean value and availability per job."""
    ensure_checkpoint_dir(spark)
    s = ST.sliding_means(ST.events_stream(spark, sf_dir), f"{LOOKBACK_HOURS} hours")
    out = ST.run_to_table(s, "s2_sliding_means")
    return out.select("job", instant_to_utc_ntz("window_start").alias("window_start"),
                      round_scaled(F.col("mean_value"), 6).alias("mean_value"),
                      round_scaled(F.col("availability_pct"), 6).alias("availability_pct"), "n_samples")


@query("stream_submit_keys", """
WITH k AS (SELECT concat_ws('|', event_type, strftime(ts, '%Y%m%d'), CAST(user_id % 20 AS VARCHAR)) AS idem_key, event_id, ts FROM events),
wm AS (SELECT max(ts) - INTERVAL 2 HOUR AS watermark FROM events)
SELECT idem_key, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts, count(*) AS n_submissions
FROM k, wm GROUP BY idem_key, watermark HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= watermark""", FAM)
def stream_submit_keys(spark, sf_dir):
    """S3: idempotent submit – the first record of each day-scoped key, emitted
    once the watermark has passed its day."""
    ensure_checkpoint_dir(spark)
    out = ST.run_to_table(ST.idempotent_submits(ST.events_stream(spark, sf_dir)), "s3_submits")
    return out.select("idem_key", "event_id", "ts", "n_submissions")


@query("stream_held_alerts", f"""
WITH s AS (SELECT CAST(user_id % 5 AS INTEGER) AS instance, ts, event_id, event_type = 'error' AS cond,
             row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n_all,
             sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_true FROM events
           WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)),
i AS (SELECT instance, n_all - n_true AS island, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_samples,
        epoch_us(max(ts)) - epoch_us(min(ts)) >= {HOLD_MINUTES * 60_000_000} AS fired FROM s WHERE cond GROUP BY 1, 2),
closed AS (SELECT i.* FROM i WHERE EXISTS (SELECT 1 FROM s WHERE s.instance = i.instance AND NOT s.cond AND s.ts > i.end_ts))
SELECT instance, start_ts, end_ts, n_samples, fired FROM closed""", FAM)
def stream_held_alerts(spark, sf_dir):
    """A state machine per instance and six hours (``applyInPandasWithState``)
    emits the ``up == 0`` runs; a second step joins them across buckets into the
    closed islands, with the held-for decision."""
    ensure_checkpoint_dir(spark)
    runs = ST.run_to_table(ST.bucket_runs(ST.events_stream(spark, sf_dir)), "s4_bucket_runs")
    return ST.join_runs(runs, HOLD_MINUTES * 60_000_000)


@query("stream_corrections", with_views("snapshots") + """
SELECT counter_id, ts_utc, snapshot_no, hourly_count FROM snapshots""", FAM)
def stream_corrections(spark, sf_dir):
    """Late corrections appended to the revision ledger by a
    ``foreachBatch`` sink, one partition per batch (idempotent replays)."""
    ensure_checkpoint_dir(spark)
    return ST.run_corrections(spark, sf_dir)


@query("stream_job_states", with_views("job_log") + """
SELECT job_id, event_id, lag(state) OVER w AS previous_state, state,
  max(updated_at) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS updated_at,
  row_number() OVER w AS seq_no
FROM job_log WINDOW w AS (PARTITION BY job_id ORDER BY updated_at, event_id)""", FAM)
def stream_job_states(spark, sf_dir):
    """Job status transitions through a ``transformWithStateInPandas``
    state machine; ``updated_at`` is monotone per job."""
    ensure_checkpoint_dir(spark)
    return ST.run_to_table(ST.job_states(ST.events_stream(spark, sf_dir)), "s4_job_states")
