"""Driver tables and the base views derived from them.

The driver supplies TPC-H-like tables plus an ``events`` stream.  The engine
works on hourly count series, metric samples, an access log, a job log, an
artifact ledger, competing snapshots and reference metadata; each of those is
a plain projection / aggregate over the driver tables (see FIXTURES.md §2), so
every query's work grows with the inputs.

All readers return lazy DataFrames: Catalyst prunes columns and pushes filters
into the Parquet scan of whatever the caller finally selects.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.functions.timecols import epoch_hours, hour_floor
from hourcast.operators.bucketed import running_count

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def orientation_of(user_id: str = "user_id"):
    return F.when(F.col(user_id) % 2 == 0, F.lit("N-S")).otherwise(F.lit("S-N"))


def events_in(spark: SparkSession, sf_dir: str, ts_range: tuple[str, str] | None = None,
              counters: list[str] | None = None) -> DataFrame:
    """``events``, optionally restricted to ``[start, end)`` on the raw ``ts``.

    Bounds are hour-aligned, so ``hour_floor(ts)`` in range <=> ``ts`` in
    range: the predicate is on the stored column and reaches the Parquet scan
    (row-group statistics / partition pruning) instead of being applied after
    the hourly aggregate.
    """
    ev = table(spark, sf_dir, "events")
    if ts_range is not None:
        lo, hi = (F.lit(v).cast("timestamp_ntz") for v in ts_range)
        ev = ev.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    if counters:
        # a counter id is "<site>_<orientation>" and the site is the stored
        # event_type: the site set is a necessary condition that the scan can use
        sites = sorted({c.split("_", 1)[0] for c in counters})
        ev = ev.filter(F.col("event_type").isin(*sites))
    return ev


def counts(spark: SparkSession, sf_dir: str, ts_range: tuple[str, str] | None = None) -> DataFrame:
    """Hourly count series: one row per (counter, UTC hour) that saw events.

    Partial aggregation happens map-side (HashAggregate before the Exchange),
    so the shuffle carries at most one row per counter-hour per input split.
    """
    ev = events_in(spark, sf_dir, ts_range)
    return (ev.select(F.col("event_type").alias("site"),
                      orientation_of().alias("orientation"),
                      hour_floor("ts").alias("ts_utc"))
            .groupBy("site", "orientation", "ts_utc")
            .agg(F.count(F.lit(1)).alias("hourly_count"))
            .select("site", "orientation",
                    F.concat_ws("_", "site", "orientation").alias("counter_id"),
                    "ts_utc", "hourly_count"))


def samples(spark: SparkSession, sf_dir: str, with_counter: bool = True) -> DataFrame:
    """Metric samples; ``counter_value`` is a running count that wraps at 50.

    The running count needs its own pass (per-bucket totals joined back), and
    an inner join is never pruned even when the column is unused, so queries
    that do not read ``counter_value`` ask for the plain projection.
    """
    ev = table(spark, sf_dir, "events")
    base = ev.select("event_id", "ts", F.col("event_type").alias("job"),
                     (F.col("user_id") % 5).cast("int").alias("instance"),
                     F.when(F.col("event_type") == "error", 0).otherwise(1).alias("up"),
                     "value", epoch_hours("ts").alias("_bucket"))
    if not with_counter:
        return base.drop("_bucket")
    numbered = running_count(base, ["job", "instance"], ["ts", "event_id"],
                             "_bucket", "_rc")
    return numbered.select("event_id", "ts", "job", "instance", "up", "value",
                           (F.col("_rc") % 50).cast("bigint").alias("counter_value"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    handler = (F.when(F.col("user_id") % 3 == 0, "predictions")
               .when(F.col("user_id") % 3 == 1, "counters").otherwise("metrics"))
    status = (F.when(F.col("event_type") == "error", 500)
              .when(F.col("event_type") == "signup", 403).otherwise(200))
    return ev.select("event_id", "ts", F.concat(F.lit("/"), handler).alias("handler"),
                     status.alias("status"), (F.col("value") / 100).alias("seconds"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    state = (F.when(F.col("event_type") == "signup", "queued")
             .when(F.col("event_type") == "view", "running")
             .when(F.col("event_type") == "purchase", "succeeded")
             .when(F.col("event_type") == "error", "failed").otherwise("pending"))
    return ev.select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
                     "event_id", state.alias("state"), F.col("ts").alias("updated_at"))


def ledger_columns() -> list:
    """The ledger projection of an ``orders`` row (one run per order)."""
    status = (F.when(F.col("o_orderstatus") == "F", "promoted")
              .when(F.col("o_orderstatus") == "O", "validated").otherwise("archived"))
    atype = (F.when(F.col("o_orderkey") % 3 == 0, "predictions")
             .when(F.col("o_orderkey") % 3 == 1, "feature_dataset")
             .otherwise("interim_dataset"))
    return [F.col("o_custkey").cast("string").alias("counter_id"),
            F.col("o_orderkey").cast("string").alias("run_id"),
            status.alias("status"), atype.alias("artifact_type"),
            F.col("o_orderdate").alias("promoted_at")]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*ledger_columns())


def snapshots(spark: SparkSession, sf_dir: str, ts_range: tuple[str, str] | None = None,
              counters: list[str] | None = None) -> DataFrame:
    ev = events_in(spark, sf_dir, ts_range, counters)
    return (ev.select(F.concat_ws("_", "event_type", orientation_of()).alias("counter_id"),
                      hour_floor("ts").alias("ts_utc"),
                      (F.col("user_id") % 3 + 1).cast("int").alias("snapshot_no"))
            .groupBy("counter_id", "ts_utc", "snapshot_no")
            .agg(F.count(F.lit(1)).alias("hourly_count")))


def reference_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .select(F.col("s_name").alias("counter_name"),
                    F.col("s_suppkey").cast("string").alias("counter_id"),
                    F.col("n_name").alias("site"), F.col("r_name").alias("area"),
                    F.col("s_acctbal").alias("metric")))


# DuckDB text of the same views, used by the oracle SQL of every query.
ORACLE_VIEWS = {
    "counts": """
SELECT event_type AS site, CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END AS orientation,
       concat(event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END) AS counter_id,
       date_trunc('hour', ts) AS ts_utc, CAST(count(*) AS BIGINT) AS hourly_count
FROM events GROUP BY 1, 2, 3, 4""",
    "samples": """
SELECT event_id, ts, event_type AS job, CAST(user_id % 5 AS INT) AS instance,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS up, value,
       CAST(count(*) OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) % 50 AS BIGINT) AS counter_value
FROM events""",
    "access_log": """
SELECT event_id, ts, concat('/', CASE WHEN user_id % 3 = 0 THEN 'predictions' WHEN user_id % 3 = 1 THEN 'counters' ELSE 'metrics' END) AS handler,
       CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 403 ELSE 200 END AS status, value / 100 AS seconds
FROM events""",
    "job_log": """
SELECT concat('job-', CAST(user_id AS VARCHAR)) AS job_id, event_id,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state,
       ts AS updated_at FROM events""",
    "ledger": """
SELECT CAST(o_custkey AS VARCHAR) AS counter_id, CAST(o_orderkey AS VARCHAR) AS run_id,
       CASE o_orderstatus WHEN 'F' THEN 'promoted' WHEN 'O' THEN 'validated' ELSE 'archived' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'predictions' WHEN o_orderkey % 3 = 1 THEN 'feature_dataset' ELSE 'interim_dataset' END AS artifact_type,
       o_orderdate AS promoted_at FROM orders""",
    "snapshots": """
SELECT concat(event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END) AS counter_id,
       date_trunc('hour', ts) AS ts_utc, CAST(user_id % 3 + 1 AS INT) AS snapshot_no, CAST(count(*) AS BIGINT) AS hourly_count
FROM events GROUP BY 1, 2, 3""",
    "reference_counters": """
SELECT s_name AS counter_name, CAST(s_suppkey AS VARCHAR) AS counter_id, n_name AS site, r_name AS area, s_acctbal AS metric
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` prefix defining the named base views (and extra CTEs) in order."""
    parts = [f"{n} AS ({ORACLE_VIEWS[n]}\n)" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def materialize(df: DataFrame) -> DataFrame:
    """Write a derived table once to the session's shared checkpoint folder.

    A DataFrame used by several branches of one plan is otherwise recomputed
    per branch (Spark does not share subplans that differ in projection), which
    for an aggregate of ``events`` means one pass over the raw data per branch.
    Hourly counts and numbered series are far smaller than the raw events;
    samples have one row per event with fewer columns.
    """
    from hourcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
