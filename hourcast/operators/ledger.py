"""Artifact and job ledgers as tables (A21, A22, A26–A28, A59, A65, A66,
A68–A75).

State that the reference keeps in files and in-memory dicts is an append-only
table here; "current", "latest" and "first" are aggregates over it.  Latest-
row selection uses ``max_by``/``min_by`` aggregates rather than a
``row_number`` window: the aggregate combines map-side, so a counter with a
third of all runs is pre-reduced in every task instead of being sorted in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Artifact enums of the manifest contract.
ARTIFACT_TYPES = ["predictions", "model", "dataset", "interim_dataset",
                  "feature_dataset", "metrics"]
ARTIFACT_STATUSES = ["produced", "validated", "promoted", "served", "archived"]
PROMOTABLE = ["produced", "validated", "promoted"]
BACKENDS = ["local", "object_storage"]
# Job types and states of the job contracts.
JOB_TYPES = ["ingest", "features", "models"]
JOB_STATES = ["pending", "queued", "running", "succeeded", "failed", "canceled", "expired"]
TERMINAL_STATES = ["succeeded", "failed", "canceled", "expired"]


def latest_by(df: DataFrame, keys: list[str], order: list[Column], cols: list[str],
              prefix: str = "") -> DataFrame:
    """Per key, the values of ``cols`` on the row with the greatest ``order``."""
    ordering = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), ordering).alias(prefix + c) for c in cols])


def earliest_by(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    ordering = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), ordering).alias(c) for c in cols])


def current(ledger: DataFrame, asof: Column | None = None) -> DataFrame:
    """Last promoted run per (artifact_type, counter_id); ties on the
    promotion time are broken by the integer run id."""
    promoted = ledger.filter(F.col("status") == "promoted")
    if asof is not None:
        promoted = promoted.filter(F.col("promoted_at") <= asof)
    order = [F.col("promoted_at"), F.col("run_id").cast("bigint")]
    return latest_by(promoted, ["artifact_type", "counter_id"], order, ["run_id", "promoted_at"])


def is_promotable(status: str | Column) -> Column:
    """A59."""
    s = F.col(status) if isinstance(status, str) else status
    return s.isin(*PROMOTABLE)


def reject_reason(artifact_type: Column, backend: Column, local_path: Column) -> Column:
    """Ordered eligibility checks for serving; null means eligible."""
    return (F.when(artifact_type != "predictions", F.lit("not_predictions"))
            .when(backend != "local", F.lit("backend_not_local"))
            .when(local_path.isNull() | (F.trim(local_path) == ""), F.lit("missing_local_path")))


def paginate(df: DataFrame, key: str, order: list[str], offset: int, limit: int) -> DataFrame:
    """Positional page per key plus the total row count of the key."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be in [1, 100] and offset >= 0")
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.withColumns({
        "_pos": F.row_number().over(w) - 1,
        "total": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding,
                                                       Window.unboundedFollowing))})
    return (numbered.filter((F.col("_pos") >= offset) & (F.col("_pos") < offset + limit))
            .drop("_pos"))


RUN_KEY = ("artifact_type", "counter_id", "run_id")


def append_runs(runs: DataFrame, path: str, write_no: int) -> None:
    """Append run manifests; ``write_no`` orders the writes of a key."""
    runs.withColumn("write_no", F.lit(write_no).cast("bigint")).write.mode("append").partitionBy("artifact_type").parquet(path)


def current_runs(appended: DataFrame) -> DataFrame:
    """One row per (type, counter, run), the last one written."""
    rest = [c for c in appended.columns if c not in (*RUN_KEY, "write_no")]
    return appended.groupBy(*RUN_KEY).agg(F.max_by(F.struct(*rest), "write_no").alias("_r")).select(*RUN_KEY, "_r.*")


def latest_status(events: DataFrame, key: str = "job_id", ts: str = "updated_at",
                  tie: str = "event_id") -> DataFrame:
    """Last transition per job; ``updated_at`` never goes backwards, so the
    reported time is the running maximum, i.e. the max over the job."""
    order = [F.col(ts), F.col(tie)]
    return events.groupBy(key).agg(
        F.max_by("state", F.struct(*order)).alias("state"),
        F.max(ts).alias("updated_at"),
        F.min(ts).alias("requested_at"),
        F.count(F.lit(1)).alias("n_transitions"))


# Error codes of a step call.
UNSUPPORTED_JOB_TYPE = "UNSUPPORTED_JOB_TYPE"
ML_SERVICE_JOB_FAILED = "ML_SERVICE_JOB_FAILED"
ML_SERVICE_HTTP_ERROR = "ML_SERVICE_HTTP_ERROR"
ML_SERVICE_UNAVAILABLE = "ML_SERVICE_UNAVAILABLE"
ML_SERVICE_INVALID_RESPONSE = "ML_SERVICE_INVALID_RESPONSE"


def reported_outcome(state: Column, error_code: Column, retryable: Column) -> tuple[Column, Column]:
    """(code, retryable) of a job status that came back: the status's own
    error, or a generic retryable failure when it names none."""
    failed = F.coalesce(state != "succeeded", F.lit(True))
    return (F.when(failed, F.coalesce(error_code, F.lit(ML_SERVICE_JOB_FAILED))),
            F.when(failed, F.when(error_code.isNull(), F.lit(True)).otherwise(retryable)))


def outcome(status_code: Column, timed_out: Column, job_type: Column) -> tuple[Column, Column, Column]:
    """(code, message, retryable) for a step outcome.

    ``status_code`` is the service's HTTP status (null: the call never came
    back), ``timed_out`` says so explicitly; a reply outside 2xx-5xx holds no
    valid job status.
    """
    unsupported = F.coalesce(~job_type.isin(*JOB_TYPES), F.lit(True))
    away = timed_out | status_code.isNull()
    code = (F.when(unsupported, F.lit(UNSUPPORTED_JOB_TYPE))
            .when(away, F.lit(ML_SERVICE_UNAVAILABLE))
            .when(status_code >= 400, F.lit(ML_SERVICE_HTTP_ERROR))
            .when((status_code >= 200) & (status_code < 300), F.lit(None))
            .otherwise(F.lit(ML_SERVICE_INVALID_RESPONSE)))
    retry = (F.when(unsupported, F.lit(False)).when(away, F.lit(True))
             .when(status_code >= 400, status_code >= 500)
             .when((status_code >= 200) & (status_code < 300), F.lit(None)).otherwise(F.lit(True)))
    msg = F.when(code.isNotNull(), F.concat_ws(" ", code, F.lit("status"),
                                               status_code.cast("string")))
    return code, msg, retry


def manifest_metadata(m: DataFrame) -> DataFrame:
    """The served projection of a manifest – identity, producer, lineage
    as one ``source`` struct, and the storage references."""
    return m.select("counter_id", "run_id", "artifact_type", "status", "created_at",
                    "producer_service", "producer_image", "producer_version",
                    F.struct(F.col("source_raw_file_name").alias("raw_file_name"),
                             F.col("source_dataset_version").alias("dataset_version"),
                             F.col("source_model_version").alias("model_version")).alias("source"),
                    F.col("storage_primary_backend").alias("primary_backend"),
                    F.col("storage_local_path").alias("local_path"),
                    F.col("storage_object_uri").alias("object_uri"), "checksum_sha256")
