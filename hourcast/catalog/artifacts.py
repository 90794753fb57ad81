"""Manifest building, payload verification, step samples and the response
tally (A60, A71, A80, A82)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.history import _merge_sql
from hourcast.catalog.registry import ORACLE, query
from hourcast.functions import labels as L
from hourcast.functions.timecols import epoch_micros
from hourcast.operators import canonical as C
from hourcast.operators.evaluate import (STEP_DURATION_METRIC, STEP_RECORDS_METRIC, response_tally as tally,
                                         round_doubles)
from hourcast.sources.tables import access_log, counts, job_log, materialize, snapshots, with_views

FAM = "artifacts"

# 32-bit row digests summed per counter, then hashed to a 64-hex checksum:
# order-independent, and identical in Spark and DuckDB.
DIGEST_SQL = "CAST(('0x' || substr(md5(concat_ws('|', {cols})), 1, 8)) AS BIGINT)"


def _digest_sql(*cols):
    return DIGEST_SQL.format(cols=", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols))


def dataset_checksum(df, key, *cols):
    """Per key: row count and SHA-256 of the summed row digests."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sha2(F.sum(C.row_digest(*cols)).cast("string"), 256).alias("checksum_sha256"))


@query("manifest_build", with_views("counts") + f""",
interim AS (SELECT counter_id, count(*) AS n_rows, sha256(CAST(sum({_digest_sql('counter_id', 'ts_utc', 'hourly_count')}) AS VARCHAR)) AS checksum_sha256,
              max(ts_utc) AS last_ts FROM counts GROUP BY 1),
feat AS (SELECT counter_id, count(*) AS n_rows,
           sha256(CAST(sum({_digest_sql('counter_id', 'ts_utc', 'hourly_count', 'hour(ts_utc)')}) AS VARCHAR)) AS checksum_sha256,
           max(ts_utc) AS last_ts FROM counts GROUP BY 1),
runs AS (SELECT 'interim_dataset' AS artifact_type, 'ingest' AS service, * FROM interim
         UNION ALL SELECT 'feature_dataset', 'features', * FROM feat)
SELECT '1.0' AS schema_version, artifact_type, 'validated' AS status,
  coalesce(nullif(trim(CASE WHEN artifact_type = 'interim_dataset' THEN 'run-' || strftime(last_ts, '%Y%m%d') END), ''),
           strftime(last_ts, '%Y%m%dT%H%M%SZ')) AS run_id, counter_id,
  strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, service AS producer_service,
  'events.parquet' AS source_raw_file_name, 'local' AS storage_primary_backend,
  'data/' || artifact_type || '/' || counter_id || '/' ||
    coalesce(nullif(trim(CASE WHEN artifact_type = 'interim_dataset' THEN 'run-' || strftime(last_ts, '%Y%m%d') END), ''),
             strftime(last_ts, '%Y%m%dT%H%M%SZ')) || '.parquet' AS storage_local_path,
  checksum_sha256, n_rows
FROM runs""", FAM)
def manifest_build(spark, sf_dir):
    """One manifest per (artifact type, counter, run) built from the run
    outputs: status validated, lineage, local path and payload checksum."""
    c = materialize(counts(spark, sf_dir))  # read by the interim, feature and run branches
    meta = c.groupBy("counter_id").agg(F.max("ts_utc").alias("last_ts"))
    interim = dataset_checksum(c, "counter_id", "counter_id", "ts_utc", "hourly_count") \
        .withColumns({"artifact_type": F.lit("interim_dataset"), "service": F.lit("ingest")})
    feat = dataset_checksum(c.withColumn("_h", F.hour("ts_utc")), "counter_id",
                            "counter_id", "ts_utc", "hourly_count", "_h") \
        .withColumns({"artifact_type": F.lit("feature_dataset"), "service": F.lit("features")})
    runs = interim.unionByName(feat).join(meta, "counter_id")
    # The given run id (interim runs carry one), else the run's UTC time text
    given = F.when(F.col("artifact_type") == "interim_dataset",
                   F.concat(F.lit("run-"), F.date_format("last_ts", "yyyyMMdd")))
    run_id = L.first_present(given, F.date_format("last_ts", "yyyyMMdd'T'HHmmss'Z'"), default="")
    return runs.select(
        F.lit("1.0").alias("schema_version"), "artifact_type", F.lit("validated").alias("status"),
        run_id.alias("run_id"), "counter_id",
        F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.col("service").alias("producer_service"), F.lit("events.parquet").alias("source_raw_file_name"),
        F.lit("local").alias("storage_primary_backend"),
        F.concat_ws("/", F.lit("data"), "artifact_type", "counter_id", F.concat(run_id, F.lit(".parquet")))
        .alias("storage_local_path"),
        "checksum_sha256", "n_rows")


@query("payload_verification", with_views("snapshots") + """,
s2 AS (SELECT * FROM snapshots WHERE snapshot_no <= 2)""" + _merge_sql("s2", "a") + _merge_sql("snapshots", "b") + f""",
declared AS (SELECT counter_id, sha256(CAST(sum({_digest_sql('counter_id', 'ts_utc', 'hourly_count')}) AS VARCHAR)) AS declared_checksum
             FROM a GROUP BY 1),
actual AS (SELECT counter_id, sha256(CAST(sum({_digest_sql('counter_id', 'ts_utc', 'hourly_count')}) AS VARCHAR)) AS actual_checksum
           FROM b GROUP BY 1)
SELECT d.counter_id, d.declared_checksum, a.actual_checksum,
  CASE WHEN ends_with(d.counter_id, 'S-N') THEN 'skipped'
       WHEN a.actual_checksum IS NULL THEN 'missing_payload'
       WHEN a.actual_checksum <> d.declared_checksum THEN 'checksum_mismatch' ELSE 'ok' END AS outcome
FROM declared d LEFT JOIN actual a ON d.counter_id = a.counter_id""", FAM)
def payload_verification(spark, sf_dir):
    """Each manifest's declared checksum (payload as of snapshot 2)
    against the payload found now (after all corrections): no local path -> skipped, no payload -> missing, different -> mismatch."""
    s = materialize(snapshots(spark, sf_dir))  # read for both states
    rank = C.precedence_default(F.col("snapshot_no"))
    declared = dataset_checksum(C.merge(C.as_of(s, 2), rank), "counter_id",
                                "counter_id", "ts_utc", "hourly_count") \
        .select("counter_id", F.col("checksum_sha256").alias("declared_checksum"))
    actual = dataset_checksum(C.merge(s, rank), "counter_id", "counter_id", "ts_utc", "hourly_count") \
        .select("counter_id", F.col("checksum_sha256").alias("actual_checksum"))
    j = declared.join(actual, "counter_id", "left")
    outcome = (F.when(F.col("counter_id").endswith("S-N"), "skipped")
               .when(F.col("actual_checksum").isNull(), "missing_payload")
               .when(F.col("actual_checksum") != F.col("declared_checksum"), "checksum_mismatch")
               .otherwise("ok"))
    return j.select("counter_id", "declared_checksum", "actual_checksum", outcome.alias("outcome"))


@query("step_samples", with_views("job_log") + """,
j AS (SELECT job_id, arg_max(state, (updated_at, event_id)) AS last_state,
        (epoch_us(max(updated_at)) - epoch_us(min(updated_at))) / 1e6 AS duration_s,
        count(*) FILTER (WHERE state = 'succeeded') - count(*) FILTER (WHERE state = 'failed') AS records
      FROM job_log GROUP BY 1),
l AS (SELECT job_id, CASE WHEN last_state = 'succeeded' THEN 'success' ELSE 'failed' END AS status,
        'site' || CAST(CAST(substr(job_id, 5) AS BIGINT) % 5 AS VARCHAR) AS site,
        CASE WHEN CAST(substr(job_id, 5) AS BIGINT) % 2 = 0 THEN 'N-S' ELSE 'S-N' END AS orientation,
        CASE CAST(substr(job_id, 5) AS BIGINT) % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'features' ELSE 'models' END AS task,
        duration_s, greatest(records, 0) AS records FROM j)
SELECT job_id, 'bike_task_duration_seconds' AS metric, task, status, site, orientation, round(duration_s, 6) AS value FROM l
UNION ALL
SELECT job_id, 'bike_records_total', task, NULL, site, orientation, CAST(records AS DOUBLE) FROM l""", FAM)
def step_samples(spark, sf_dir):
    """Per run, duration by task/status/site/orientation and records
    ``max(n, 0)`` as long metric samples; status normalised to success/failed."""
    jl = job_log(spark, sf_dir)
    st = F.col("state")
    j = jl.groupBy("job_id").agg(
        F.max_by("state", F.struct("updated_at", "event_id")).alias("last_state"),
        ((epoch_micros(F.max("updated_at")) - epoch_micros(F.min("updated_at"))) / 1e6).alias("duration_s"),
        (F.count(F.when(st == "succeeded", 1)) - F.count(F.when(st == "failed", 1))).alias("records"))
    uid = F.substring("job_id", 5, 20).cast("bigint")
    lab = j.select("job_id", F.when(F.col("last_state") == "succeeded", "success").otherwise("failed").alias("status"),
                   F.concat(F.lit("site"), (uid % 5).cast("string")).alias("site"),
                   F.when(uid % 2 == 0, "N-S").otherwise("S-N").alias("orientation"),
                   F.when(uid % 3 == 0, "ingest").when(uid % 3 == 1, "features").otherwise("models").alias("task"),
                   "duration_s", F.greatest(F.col("records"), F.lit(0)).alias("records"))
    dur = lab.select("job_id", F.lit(STEP_DURATION_METRIC).alias("metric"), "task", "status", "site", "orientation",
                     F.col("duration_s").alias("value"))
    rec = lab.select("job_id", F.lit(STEP_RECORDS_METRIC).alias("metric"), "task", F.lit(None).cast("string").alias("status"),
                     "site", "orientation", F.col("records").cast("double").alias("value"))
    return round_doubles(dur.unionByName(rec))


@query("response_tally", with_views("access_log") + """
SELECT handler, count(*) AS n_requests,
  count(*) FILTER (WHERE status = 200) AS n_200,
  count(*) FILTER (WHERE status >= 200 AND status < 300) AS n_2xx,
  count(*) FILTER (WHERE status >= 400 AND status < 500) AS n_4xx,
  count(*) FILTER (WHERE status >= 500) AS n_5xx,
  count(*) FILTER (WHERE status < 200 OR (status >= 300 AND status < 400)) AS n_other,
  round(avg(CASE WHEN status = 200 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_200,
  round(avg(CASE WHEN status >= 500 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_5xx,
  round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS requests_per_second
FROM access_log GROUP BY handler""", FAM)
def response_tally(spark, sf_dir):
    """Response classes, shares and request rate per handler."""
    return round_doubles(tally(access_log(spark, sf_dir), ["handler"]))


@query("artifact_metadata", """
SELECT counter_id, run_id, artifact_type, status, created_at, producer_service,
  'hourcast/' || producer_service AS producer_image, schema_version AS producer_version,
  to_json({'raw_file_name': source_raw_file_name, 'dataset_version': run_id,
           'model_version': CASE WHEN artifact_type = 'feature_dataset' THEN 'm-' || run_id ELSE '' END}) AS source,
  storage_primary_backend AS primary_backend, storage_local_path AS local_path, 's3://artifacts/' || storage_local_path AS object_uri,
  checksum_sha256
FROM (""" + ORACLE["manifest_build"] + ")", FAM)
def artifact_metadata(spark, sf_dir):
    """The served projection of each manifest: identity, producer,
    lineage (``source``, as JSON text) and storage references; other manifest
    fields stay out."""
    from hourcast.operators import ledger as LG
    built = manifest_build(spark, sf_dir).withColumns({
        "producer_image": F.concat(F.lit("hourcast/"), "producer_service"),
        "producer_version": F.col("schema_version"), "source_dataset_version": F.col("run_id"),
        "source_model_version": F.when(F.col("artifact_type") == "feature_dataset",
                                       F.concat(F.lit("m-"), "run_id")).otherwise(""),
        "storage_object_uri": F.concat(F.lit("s3://artifacts/"), "storage_local_path")})
    m = LG.manifest_metadata(built)
    return m.withColumn("source", F.to_json("source"))
