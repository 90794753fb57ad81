"""Ledger, manifest, job and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.functions import labels as L
from hourcast.functions.timecols import day_floor
from hourcast.operators import ledger as LG
from hourcast.sources.tables import access_log, counts, job_log, ledger, ledger_columns, table, with_views

FAM = "ledger"


@query("current_artifact", with_views("ledger") + """
SELECT artifact_type, counter_id, run_id, promoted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY artifact_type, counter_id
                               ORDER BY promoted_at DESC, CAST(run_id AS BIGINT) DESC) AS rn
  FROM ledger WHERE status = 'promoted') WHERE rn = 1""", FAM)
def current_artifact(spark, sf_dir):
    """Current pointer = last promoted run per (artifact_type, counter)."""
    return LG.current(ledger(spark, sf_dir)).select("artifact_type", "counter_id", "run_id",
                                                    "promoted_at")


@query("promotion_history", with_views("ledger") + """
SELECT artifact_type, counter_id, count(*) AS n_runs,
  count(*) FILTER (WHERE status = 'promoted') AS n_promoted,
  count(*) FILTER (WHERE status IN ('produced', 'validated', 'promoted')) AS n_promotable,
  arg_max(run_id, CAST(run_id AS BIGINT)) AS latest_version,
  min(promoted_at) AS first_at, max(promoted_at) AS last_at
FROM ledger GROUP BY 1, 2""", FAM)
def promotion_history(spark, sf_dir):
    """A28 + A59 + A70: run history per artifact; latest version by integer value."""
    lg = ledger(spark, sf_dir)
    return lg.groupBy("artifact_type", "counter_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count(F.when(F.col("status") == "promoted", 1)).alias("n_promoted"),
        F.count(F.when(LG.is_promotable("status"), 1)).alias("n_promotable"),
        F.max_by("run_id", F.col("run_id").cast("bigint")).alias("latest_version"),
        F.min("promoted_at").alias("first_at"), F.max("promoted_at").alias("last_at"))


def _manifest_base(spark, sf_dir):
    """Manifest records derived from orders (one per run) and their customer."""
    # one scan of orders gives the ledger columns and the order attributes
    lg = table(spark, sf_dir, "orders").select(*ledger_columns(), "o_orderpriority", "o_orderstatus",
                                               "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    prio, seg = F.col("o_orderpriority"), F.col("c_mktsegment")
    m = (lg.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
         .select("run_id", "counter_id", "status", "promoted_at", "o_orderstatus", "o_orderpriority",
                 "c_mktsegment",
                 F.when(seg == "MACHINERY", F.lit("model_bundle"))
                 .otherwise(F.col("artifact_type")).alias("artifact_type"),
                 F.when(prio != "4-NOT SPECIFIED", "1.0").when(F.col("o_orderstatus") != "P", "0.9").alias("schema_version"),
                 F.col("c_name").alias("producer_service"),
                 F.concat(F.date_format("promoted_at", "yyyy-MM-dd'T'HH:mm:ss"),
                          F.when(prio == "3-MEDIUM", "").otherwise("+00:00")).alias("created_at"),
                 F.when(seg == "BUILDING", F.md5("run_id"))
                 .otherwise(F.upper(F.sha2("run_id", 256))).alias("checksum_sha256"),
                 F.when(prio == "1-URGENT", "object_storage").otherwise("local").alias("primary_backend"),
                 F.when(F.col("o_orderstatus") == "P", F.lit(None))
                 .otherwise(F.concat(F.col("c_name"), F.lit(".csv"))).alias("raw_file_name")))
    local_path = (F.when(F.col("primary_backend") != "local", F.lit(None))
                  .when(prio == "2-HIGH", F.concat(F.lit("/abs/"), F.col("run_id")))
                  .when(prio == "5-LOW", F.lit(None))
                  .when((prio == "3-MEDIUM") & (F.col("o_orderstatus") == "P"),
                        F.concat(F.lit("data/../"), F.col("run_id")))
                  .otherwise(F.concat_ws("/", F.lit("data"), F.col("artifact_type"),
                                         F.col("counter_id"), F.concat(F.col("run_id"), F.lit(".csv")))))
    uri = (F.when(F.col("primary_backend") != "object_storage", F.lit(None))
           .when(seg == "AUTOMOBILE", F.concat(F.lit("s3://key:secret@bucket/"), F.col("run_id")))
           .when(seg == "FURNITURE", F.concat(F.lit("https://bucket/"), F.col("run_id")))
           .otherwise(F.concat(F.lit("s3://bucket/runs/"), F.col("run_id"))))
    return m.withColumns({"local_path": local_path, "object_uri": uri}).drop("c_mktsegment")


MANIFEST_SQL = with_views("ledger") + """,
m0 AS (
  SELECT l.run_id, l.counter_id, l.status, l.promoted_at, o.o_orderstatus, o.o_orderpriority,
    CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'model_bundle' ELSE l.artifact_type END AS artifact_type,
    CASE WHEN o.o_orderpriority <> '4-NOT SPECIFIED' THEN '1.0' WHEN o.o_orderstatus <> 'P' THEN '0.9' END AS schema_version,
    c.c_name AS producer_service,
    strftime(l.promoted_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN '' ELSE '+00:00' END AS created_at,
    CASE WHEN c.c_mktsegment = 'BUILDING' THEN md5(l.run_id) ELSE upper(sha256(l.run_id)) END AS checksum_sha256,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'object_storage' ELSE 'local' END AS primary_backend,
    CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE c.c_name || '.csv' END AS raw_file_name,
    c.c_mktsegment AS seg
  FROM ledger l JOIN orders o ON l.run_id = CAST(o.o_orderkey AS VARCHAR)
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
m AS (
  SELECT *,
    CASE WHEN primary_backend <> 'local' THEN NULL
         WHEN o_orderpriority = '2-HIGH' THEN '/abs/' || run_id
         WHEN o_orderpriority = '5-LOW' THEN NULL
         WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'data/../' || run_id
         ELSE concat_ws('/', 'data', artifact_type, counter_id, run_id || '.csv') END AS local_path,
    CASE WHEN primary_backend <> 'object_storage' THEN NULL
         WHEN seg = 'AUTOMOBILE' THEN 's3://key:secret@bucket/' || run_id
         WHEN seg = 'FURNITURE' THEN 'https://bucket/' || run_id
         ELSE 's3://bucket/runs/' || run_id END AS object_uri
  FROM m0)
"""


@query("serving_eligibility", MANIFEST_SQL + """
SELECT artifact_type,
  CASE WHEN artifact_type <> 'predictions' THEN 'not_predictions'
       WHEN primary_backend <> 'local' THEN 'backend_not_local'
       WHEN local_path IS NULL OR trim(local_path) = '' THEN 'missing_local_path' END AS reject_reason,
  status IN ('produced', 'validated', 'promoted') AS promotable,
  count(*) AS n_manifests
FROM m GROUP BY 1, 2, 3""", FAM)
def serving_eligibility(spark, sf_dir):
    """A21 + A22 + A59: ordered serving rejection reason and promotability."""
    m = _manifest_base(spark, sf_dir)
    return (m.select("artifact_type",
                     LG.reject_reason(F.col("artifact_type"), F.col("primary_backend"),
                                      F.col("local_path")).alias("reject_reason"),
                     LG.is_promotable("status").alias("promotable"))
            .groupBy("artifact_type", "reject_reason", "promotable")
            .agg(F.count(F.lit(1)).alias("n_manifests")))


def manifest_violations(m):
    """A56 (+ A51, A52): every failed rule of a manifest row, in rule order."""
    zoned = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"

    def known(column, values):
        return F.coalesce(F.col(column).isin(*values), F.lit(False))

    path_err = L.local_path_error(F.col("local_path"))
    uri_err = L.object_uri_error(F.col("object_uri"))
    rules = [
        F.when(~F.col("schema_version").eqNullSafe("1.0"), F.lit("schema_version")),
        F.when(~known("artifact_type", LG.ARTIFACT_TYPES), F.lit("artifact_type")),
        F.when(~known("status", LG.ARTIFACT_STATUSES), F.lit("status")),
        F.when(F.coalesce(F.trim("run_id"), F.lit("")) == "", F.lit("run_id")),
        F.when(F.coalesce(F.trim("counter_id"), F.lit("")) == "", F.lit("counter_id")),
        F.when(F.coalesce(F.trim("producer_service"), F.lit("")) == "", F.lit("producer")),
        F.when(~F.coalesce(F.col("created_at"), F.lit("")).rlike(zoned), F.lit("created_at")),
        F.when(F.col("raw_file_name").isNull(), F.lit("lineage")),
        F.when(~F.coalesce(F.col("checksum_sha256"), F.lit("")).rlike("^[a-fA-F0-9]{64}$"),
               F.lit("checksum")),
        F.when(path_err.isNotNull(), F.concat(F.lit("local_path:"), path_err)),
        F.when(uri_err.isNotNull(), F.concat(F.lit("object_uri:"), uri_err)),
        F.when(~known("primary_backend", ("local", "object_storage"))
               | (F.col("primary_backend").eqNullSafe("local") & F.col("local_path").isNull())
               | (F.col("primary_backend").eqNullSafe("object_storage") & F.col("object_uri").isNull())
               | (F.col("local_path").isNull() & F.col("object_uri").isNull()),
               F.lit("backend_reference")),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


@query("manifest_rules", MANIFEST_SQL + """,
v AS (SELECT run_id, counter_id, checksum_sha256, concat_ws(',',
    CASE WHEN schema_version IS DISTINCT FROM '1.0' THEN 'schema_version' END,
    CASE WHEN artifact_type IS NULL OR artifact_type NOT IN ('predictions', 'model', 'dataset', 'interim_dataset', 'feature_dataset', 'metrics') THEN 'artifact_type' END,
    CASE WHEN status IS NULL OR status NOT IN ('produced', 'validated', 'promoted', 'served', 'archived') THEN 'status' END,
    CASE WHEN coalesce(trim(run_id), '') = '' THEN 'run_id' END,
    CASE WHEN coalesce(trim(counter_id), '') = '' THEN 'counter_id' END,
    CASE WHEN coalesce(trim(producer_service), '') = '' THEN 'producer' END,
    CASE WHEN NOT regexp_matches(coalesce(created_at, ''), '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN 'created_at' END,
    CASE WHEN raw_file_name IS NULL THEN 'lineage' END,
    CASE WHEN NOT regexp_matches(coalesce(checksum_sha256, ''), '^[a-fA-F0-9]{64}$') THEN 'checksum' END,
    CASE WHEN local_path IS NULL THEN NULL
         WHEN local_path = '' THEN 'local_path:empty_path'
         WHEN regexp_matches(local_path, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN 'local_path:scheme_not_allowed'
         WHEN starts_with(local_path, '/') THEN 'local_path:absolute_path'
         WHEN list_contains(string_split(local_path, '/'), '..') THEN 'local_path:parent_traversal' END,
    CASE WHEN object_uri IS NULL THEN NULL
         WHEN object_uri = '' THEN 'object_uri:empty_uri'
         WHEN lower(regexp_extract(object_uri, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) <> 's3' THEN 'object_uri:scheme_not_s3'
         WHEN regexp_extract(object_uri, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) = '' THEN 'object_uri:missing_bucket'
         WHEN regexp_extract(object_uri, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN 'object_uri:missing_key'
         WHEN contains(regexp_extract(object_uri, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '@') THEN 'object_uri:credentials_in_uri' END,
    CASE WHEN primary_backend IS NULL OR primary_backend NOT IN ('local', 'object_storage') OR (primary_backend = 'local' AND local_path IS NULL)
           OR (primary_backend = 'object_storage' AND object_uri IS NULL)
           OR (local_path IS NULL AND object_uri IS NULL) THEN 'backend_reference' END) AS violations
  FROM m)
SELECT run_id, counter_id,
  CASE WHEN violations = '' THEN lower(checksum_sha256) END AS checksum_sha256,
  CAST(CASE WHEN violations = '' THEN 0 ELSE len(string_split(violations, ',')) END AS INTEGER) AS n_violations,
  violations, violations = '' AS is_valid
FROM v""", FAM)
def manifest_rules(spark, sf_dir):
    """Rule outcomes as one array column; valid rows get the lowercased checksum."""
    m = _manifest_base(spark, sf_dir)
    m = m.withColumn("_v", manifest_violations(m))
    valid = F.size("_v") == 0
    return m.select("run_id", "counter_id",
                    F.when(valid, F.lower("checksum_sha256")).alias("checksum_sha256"),
                    F.size("_v").alias("n_violations"),
                    F.array_join("_v", ",").alias("violations"),
                    valid.alias("is_valid"))


def _requests(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    jt = (F.when(F.col("event_type") == "click", "ingest").when(F.col("event_type") == "view", "features")
          .when(F.col("event_type") == "purchase", "models").otherwise("ingest"))
    return ev.select(
        "event_id", F.col("ts").alias("requested_at"), jt.alias("job_type"),
        F.date_format("ts", "yyyyMMdd").alias("run_id"),
        F.concat(F.lit("Counter "), (F.col("user_id") % 20).cast("string")).alias("counter_id"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("manual-"), F.col("user_id").cast("string")))
        .alias("job_id_given"),
        F.lit("counter_daily").alias("dag_id"), jt.alias("task_id"),
        (F.col("event_id") % 3 + 1).cast("int").alias("try_number"))


REQUESTS_SQL = """
WITH r AS (SELECT event_id, ts AS requested_at,
    CASE event_type WHEN 'click' THEN 'ingest' WHEN 'view' THEN 'features' WHEN 'purchase' THEN 'models' ELSE 'ingest' END AS job_type,
    strftime(ts, '%Y%m%d') AS run_id, 'Counter ' || CAST(user_id % 20 AS VARCHAR) AS counter_id,
    CASE WHEN event_type = 'error' THEN 'manual-' || CAST(user_id AS VARCHAR) END AS job_id_given,
    'counter_daily' AS dag_id, CAST(event_id % 3 + 1 AS INTEGER) AS try_number FROM events),
k AS (SELECT *, CASE WHEN nullif(trim(job_id_given), '') IS NOT NULL THEN 'job_id=' || trim(job_id_given)
        ELSE concat_ws('|', 'job_type=' || job_type, 'run_id=' || run_id, 'counter_id=' || counter_id,
          'dag_id=' || dag_id, 'task_id=' || job_type, 'try_number=' || CAST(try_number AS VARCHAR)) END AS idem_key
      FROM r)
"""


def _slug_id_sql(x):
    s = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '[^a-zA-Z0-9_.\\-]+', '-', 'g')"
    s = f"regexp_replace({s}, '^[-._]+|[-._]+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN 'unknown' ELSE substr({s}, 1, 48) END"


@query("idempotent_submit", REQUESTS_SQL + f"""
SELECT idem_key,
  coalesce(nullif(trim(arg_min(job_id_given, (requested_at, event_id))), ''),
    concat_ws('-', 'job', {_slug_id_sql('arg_min(job_type, (requested_at, event_id))')},
      {_slug_id_sql('arg_min(counter_id, (requested_at, event_id))')}, substr(sha256(idem_key), 1, 12))) AS job_id,
  arg_min(event_id, (requested_at, event_id)) AS first_event_id,
  min(requested_at) AS requested_at, count(*) AS n_submissions
FROM k GROUP BY idem_key""", FAM)
def idempotent_submit(spark, sf_dir):
    """A54 + A72: submissions with the same key return the first record."""
    r = _requests(spark, sf_dir)
    r = r.withColumn("idem_key", L.idempotency_key("job_id_given", "job_type", "run_id", "counter_id",
                                                   "dag_id", "task_id", "try_number"))
    first = F.struct("requested_at", "event_id")
    g = r.groupBy("idem_key").agg(
        F.min_by("job_id_given", first).alias("job_id_given"),
        F.min_by("job_type", first).alias("job_type"),
        F.min_by("counter_id", first).alias("counter_id"),
        F.min_by("event_id", first).alias("first_event_id"),
        F.min("requested_at").alias("requested_at"),
        F.count(F.lit(1)).alias("n_submissions"))
    return g.select("idem_key", L.job_id("job_id_given", "job_type", "counter_id",
                                         F.col("idem_key")).alias("job_id"),
                    "first_event_id", "requested_at", "n_submissions")


@query("latest_status", with_views("job_log") + """
SELECT job_id, state, updated_at, requested_at, n_transitions,
  state IN ('succeeded', 'failed', 'canceled', 'expired') AS is_terminal FROM (
  SELECT job_id, state, event_id,
    max(updated_at) OVER (PARTITION BY job_id) AS updated_at,
    min(updated_at) OVER (PARTITION BY job_id) AS requested_at,
    count(*) OVER (PARTITION BY job_id) AS n_transitions,
    row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) AS rn
  FROM job_log) WHERE rn = 1""", FAM)
def latest_status(spark, sf_dir):
    """Latest transition per job with monotone time."""
    s = LG.latest_status(job_log(spark, sf_dir))
    return s.withColumn("is_terminal", F.col("state").isin(*LG.TERMINAL_STATES))


@query("outcome_codes", with_views("access_log") + """,
x AS (SELECT status, seconds > 3.0 AS timed_out,
  CASE handler WHEN '/predictions' THEN 'models' WHEN '/counters' THEN 'ingest' ELSE 'metrics' END AS job_type FROM access_log)
SELECT job_type,
  CASE WHEN job_type NOT IN ('ingest', 'features', 'models') THEN 'UNSUPPORTED_JOB_TYPE'
       WHEN timed_out THEN 'ML_SERVICE_UNAVAILABLE' WHEN status >= 400 THEN 'ML_SERVICE_HTTP_ERROR'
       WHEN status BETWEEN 200 AND 299 THEN NULL ELSE 'ML_SERVICE_INVALID_RESPONSE' END AS code,
  CASE WHEN job_type NOT IN ('ingest', 'features', 'models') THEN 'false'
       WHEN timed_out THEN 'true' WHEN status >= 500 THEN 'true' WHEN status >= 400 THEN 'false'
       WHEN status BETWEEN 200 AND 299 THEN NULL ELSE 'true' END AS retryable,
  count(*) AS n_outcomes
FROM x GROUP BY 1, 2, 3""", FAM)
def outcome_codes(spark, sf_dir):
    """Step outcomes mapped to (code, retryable), counted."""
    a = access_log(spark, sf_dir)
    jt = (F.when(F.col("handler") == "/predictions", "models")
          .when(F.col("handler") == "/counters", "ingest").otherwise("metrics"))
    x = a.select("status", (F.col("seconds") > 3.0).alias("timed_out"), jt.alias("job_type"))
    code, _msg, retry = LG.outcome(F.col("status"), F.col("timed_out"), F.col("job_type"))
    # null for a success: published as text so every engine represents it alike
    return (x.select("job_type", code.alias("code"), retry.cast("string").alias("retryable"))
            .groupBy("job_type", "code", "retryable").agg(F.count(F.lit(1)).alias("n_outcomes")))


REFRESH_BEFORE = "1998-01-01 00:00:00"


@query("refresh_report", MANIFEST_SQL + f""",
p AS (SELECT counter_id, promoted_at, artifact_type, status,
        (schema_version IS DISTINCT FROM '1.0' OR artifact_type IS NULL OR artifact_type NOT IN ('predictions', 'model', 'dataset', 'interim_dataset',
           'feature_dataset', 'metrics') OR NOT regexp_matches(coalesce(checksum_sha256, ''), '^[a-fA-F0-9]{{64}}$')) AS bad
      FROM m WHERE status = 'promoted'),
b AS (SELECT max(promoted_at) AS t_after, TIMESTAMP '{REFRESH_BEFORE}' AS t_before FROM ledger),
r AS (SELECT count(DISTINCT CASE WHEN artifact_type = 'predictions' AND promoted_at <= t_before THEN counter_id END) AS loaded_before,
        count(DISTINCT CASE WHEN artifact_type = 'predictions' AND promoted_at <= t_after THEN counter_id END) AS candidate_after,
        count(*) FILTER (WHERE promoted_at > t_before AND promoted_at <= t_after AND bad) AS n_invalid_new
      FROM p CROSS JOIN b)
SELECT loaded_before, candidate_after, n_invalid_new, n_invalid_new = 0 AS refresh_applied,
  CASE WHEN n_invalid_new = 0 THEN candidate_after ELSE loaded_before END AS loaded_after,
  CASE WHEN n_invalid_new = 0 THEN candidate_after - loaded_before ELSE 0 END AS added
FROM r""", FAM)
def refresh_report(spark, sf_dir):
    """Counters served before / after a refresh (two as-of cut-offs),
    all-or-nothing: one invalid manifest among the new promotions aborts the
    refresh and the previous store stays served."""
    m = _manifest_base(spark, sf_dir).filter(F.col("status") == "promoted")
    t_after = ledger(spark, sf_dir).agg(F.max("promoted_at")).scalar()
    t_before = F.lit(REFRESH_BEFORE).cast("timestamp_ntz")
    bad = (~F.col("schema_version").eqNullSafe("1.0")
           | ~F.coalesce(F.col("artifact_type").isin(*LG.ARTIFACT_TYPES), F.lit(False))
           | ~F.coalesce(F.col("checksum_sha256"), F.lit("")).rlike("^[a-fA-F0-9]{64}$"))
    preds = F.col("artifact_type") == "predictions"
    r = m.agg(
        F.count_distinct(F.when(preds & (F.col("promoted_at") <= t_before), F.col("counter_id"))).alias("loaded_before"),
        F.count_distinct(F.when(preds & (F.col("promoted_at") <= t_after), F.col("counter_id"))).alias("candidate_after"),
        F.count(F.when((F.col("promoted_at") > t_before) & (F.col("promoted_at") <= t_after) & bad, 1))
        .alias("n_invalid_new"))
    ok = F.col("n_invalid_new") == 0
    return r.select("loaded_before", "candidate_after", "n_invalid_new", ok.alias("refresh_applied"),
                    F.when(ok, F.col("candidate_after")).otherwise(F.col("loaded_before")).alias("loaded_after"),
                    F.when(ok, F.col("candidate_after") - F.col("loaded_before")).otherwise(F.lit(0)).alias("added"))


@query("path_resolution", with_views("ledger") + """,
cur AS (SELECT artifact_type, counter_id, run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY artifact_type, counter_id
         ORDER BY promoted_at DESC, CAST(run_id AS BIGINT) DESC) AS rn
  FROM ledger WHERE status = 'promoted') WHERE rn = 1),
plan AS (SELECT CAST(c_custkey AS VARCHAR) AS counter_id, t.artifact_type
         FROM customer CROSS JOIN (VALUES ('interim_dataset'), ('feature_dataset'), ('predictions')) t(artifact_type))
SELECT plan.counter_id, plan.artifact_type,
  coalesce('artifacts/' || plan.artifact_type || '/' || plan.counter_id || '/' || cur.run_id,
           'planned/' || plan.artifact_type || '/' || plan.counter_id) AS resolved_path,
  cur.run_id IS NOT NULL AS from_manifest
FROM plan LEFT JOIN cur ON plan.counter_id = cur.counter_id AND plan.artifact_type = cur.artifact_type""", FAM)
def path_resolution(spark, sf_dir):
    """Upstream path from the current manifest, else the planned path."""
    cur = LG.current(ledger(spark, sf_dir))
    steps = F.array(*[F.lit(s) for s in ("interim_dataset", "feature_dataset", "predictions")])
    plan = (table(spark, sf_dir, "customer")
            .select(F.col("c_custkey").cast("string").alias("counter_id"),
                    F.explode(steps).alias("artifact_type")))  # three fixed steps per counter
    j = plan.join(cur, ["counter_id", "artifact_type"], "left")
    published = F.concat_ws("/", F.lit("artifacts"), "artifact_type", "counter_id", "run_id")
    return j.select("counter_id", "artifact_type",
                    F.when(F.col("run_id").isNotNull(), published)
                    .otherwise(F.concat_ws("/", F.lit("planned"), "artifact_type", "counter_id"))
                    .alias("resolved_path"),
                    F.col("run_id").isNotNull().alias("from_manifest"))


@query("init_gate", with_views("ledger") + """
SELECT CAST(c_custkey AS VARCHAR) AS counter_id FROM customer
WHERE CAST(c_custkey AS VARCHAR) NOT IN (
  SELECT counter_id FROM ledger WHERE artifact_type = 'interim_dataset' AND status = 'promoted')""", FAM)
def init_gate(spark, sf_dir):
    """Counters still waiting for their one-off initialisation."""
    done = (ledger(spark, sf_dir)
            .filter((F.col("artifact_type") == "interim_dataset") & (F.col("status") == "promoted"))
            .select("counter_id"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("counter_id"))
    return cust.join(done, "counter_id", "left_anti")


@query("serve_page", with_views("counts") + """,
runs AS (SELECT counter_id, max(date_trunc('day', ts_utc)) AS run_day FROM counts GROUP BY 1),
p AS (SELECT c.counter_id, c.ts_utc, c.hourly_count,
        row_number() OVER (PARTITION BY c.counter_id ORDER BY c.ts_utc) - 1 AS pos,
        count(*) OVER (PARTITION BY c.counter_id) AS total
      FROM counts c JOIN runs r ON c.counter_id = r.counter_id AND date_trunc('day', c.ts_utc) = r.run_day)
SELECT counter_id, ts_utc, hourly_count, total FROM p WHERE pos >= 1 AND pos < 11""", FAM)
def serve_page(spark, sf_dir):
    """A65 + A26 + A27: the current run (latest day) of every counter is served,
    page offset 1 / limit 10, with the total row count of the run."""
    c = counts(spark, sf_dir).withColumn("run_day", day_floor("ts_utc"))
    runs = c.groupBy("counter_id").agg(F.max("run_day").alias("run_day"))
    cur = c.join(runs, ["counter_id", "run_day"])
    return LG.paginate(cur, "counter_id", ["ts_utc"], offset=1, limit=10).select(
        "counter_id", "ts_utc", "hourly_count", "total")


@query("serve_page_global", with_views("counts") + """
SELECT counter_id, ts_utc, hourly_count FROM counts
ORDER BY ts_utc DESC, counter_id LIMIT 10 OFFSET 1""", FAM)
def serve_page_global(spark, sf_dir):
    """A26 (whole table): page 2 of size 10 of the newest hours over all
    counters – ``orderBy().offset().limit()``, planned as a top-k
    (``TakeOrderedAndProject``), not a full sort."""
    c = counts(spark, sf_dir)
    return (c.orderBy(F.col("ts_utc").desc(), "counter_id").offset(1).limit(10)
            .select("counter_id", "ts_utc", "hourly_count"))
