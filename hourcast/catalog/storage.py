"""Sources and sinks end to end (A2–A8, A10, A13, A27, A62, A64, A65, A70, A92–A94, A96, B19, C3):
each query writes what it derives from the given tables to the shared folder
and reads it back through the package's own readers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourcast.catalog.registry import ORACLE, query
from hourcast.operators import ledger as LG
from hourcast.operators import metrics as M
from hourcast.operators import sequence as seq
from hourcast.operators import validate as V
from hourcast.session import ensure_checkpoint_dir
from hourcast.sources import files as FS
from hourcast.sources import sinks as SK
from hourcast.sources.tables import counts, ledger, orientation_of, reference_counters, table, with_views

FAM = "storage"


def _folder(spark, name: str) -> str:
    """A folder of the run's own under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "storage", f"{name}-{uuid.uuid4().hex}")


KEPT = ("click_N-S", "view_S-N")


@query("dataset_roundtrip", with_views("counts") + f""",
x AS (SELECT counter_id, count(*) AS n_rows, CAST(sum(hourly_count) AS BIGINT) AS total, min(ts_utc) AS first_ts
      FROM counts WHERE counter_id IN {KEPT} GROUP BY 1)
SELECT f AS layout, counter_id, n_rows, CASE WHEN counter_id = 'click_N-S' THEN 2 * total ELSE total END AS total, first_ts
FROM x, (VALUES ('csv'), ('parquet')) t(f)""", FAM)
def dataset_roundtrip(spark, sf_dir):
    """A2 + A3 + A92 + A93: the dataset written by counter as Parquet and as
    CSV; a second write of one counter replaces that counter alone; the reader
    opens the listed counters' folders only."""
    c = counts(spark, sf_dir).select("counter_id", "ts_utc", "hourly_count")
    again = c.filter(F.col("counter_id") == KEPT[0]).withColumn("hourly_count", F.col("hourly_count") * 2)
    parts = []
    for layout in ("parquet", "csv"):
        path = _folder(spark, layout)
        SK.write_dataset(c, path, layout)
        SK.write_dataset(again, path, layout)
        back = (FS.read_dataset(spark, path, list(KEPT)) if layout == "parquet"
                else spark.read.option("header", True).schema("ts_utc timestamp_ntz, hourly_count bigint, counter_id string")
                .csv(path).filter(F.col("counter_id").isin(*KEPT)))
        parts.append(back.groupBy("counter_id").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("hourly_count").cast("bigint").alias("total"),
            F.min("ts_utc").alias("first_ts")).withColumn("layout", F.lit(layout)))
    return parts[0].unionByName(parts[1]).select("layout", "counter_id", "n_rows", "total", "first_ts")


@query("prediction_scan", with_views("counts") + """,
p AS (SELECT counter_id, hourly_count AS y_true, lag(hourly_count) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS y_pred,
        row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) % 4 = 0 AS forecast_mode FROM counts)
SELECT counter_id, forecast_mode, count(*) AS n_rows, count(y_pred) AS n_pred,
  round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse
FROM p GROUP BY 1, 2""", FAM)
def prediction_scan(spark, sf_dir):
    """A4 + A94: evaluation output written by counter as CSV with the published
    column names, read back with the fixed schema and its gates."""
    w = Window.partitionBy("counter_id").orderBy("ts_utc")
    out = counts(spark, sf_dir).select(
        "counter_id", F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("date_et_heure_de_comptage_local"),
        F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_et_heure_de_comptage_utc"),
        F.col("hourly_count").cast("double").alias("y_true"), F.lag("hourly_count").over(w).cast("double").alias("y_pred"),
        (F.row_number().over(w) % 4 == 0).alias("forecast_mode"))
    path = _folder(spark, "predictions")
    SK.write_dataset(out, path, "csv")
    back = FS.read_predictions(spark, path)
    e = F.col("y_true") - F.col("y_pred")
    from hourcast.functions.numeric import round_scaled
    return back.groupBy("counter_id", "forecast_mode").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("y_pred").alias("n_pred"),
        round_scaled(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


def _manifest_documents(spark, sf_dir):
    """(counter, variant, JSON text) of current prediction manifests, some of them broken."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("service"))
    good = F.struct(
        F.lit("1.0").alias("schema_version"), F.lit("predictions").alias("artifact_type"), F.lit("promoted").alias("status"),
        F.concat(F.lit("run-"), "k").alias("run_id"), F.col("k").cast("string").alias("counter_id"),
        F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.struct("service").alias("producer"),
        F.struct(F.lit("a.csv").alias("raw_file_name")).alias("source"),
        F.struct(F.lit("local").alias("primary_backend"), F.lit("data/a.csv").alias("local_path")).alias("storage"))
    text = F.to_json(good)
    variant = F.pmod("k", F.lit(8))
    return c.select(F.col("k").cast("string").alias("counter_id"), variant.alias("variant"),
                    F.when(variant == 0, F.substring(text, F.lit(1), F.length(text) - 1))
                    .when(variant == 1, F.concat(F.lit("["), text, F.lit("]")))
                    .when(variant == 2, F.replace(text, F.lit('"source"'), F.lit('"sauce"')))
                    .when(variant == 3, F.replace(text, F.lit('"local_path"'), F.lit('"lokal_path"')))
                    .when(variant == 4, F.replace(text, F.lit('"promoted"'), F.lit("null")))
                    .when(variant == 5, F.lit(None)).otherwise(text).alias("text"))


@query("manifest_scan", """
SELECT CASE c_custkey % 8 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'invalid_manifest'
         WHEN 3 THEN 'invalid_manifest' WHEN 4 THEN 'invalid_manifest' WHEN 5 THEN 'missing_file' END AS error,
  count(*) AS n_manifests, count(CASE WHEN c_custkey % 8 >= 6 THEN 1 END) AS n_current
FROM customer GROUP BY 1""", FAM)
def manifest_scan(spark, sf_dir):
    """A5 + A6: the four error classes of manifest documents (missing file, bad
    JSON, no object, invalid manifest: unknown field at any level or null enum)
    and the counters that have a valid current one."""
    docs = _manifest_documents(spark, sf_dir)
    path = _folder(spark, "manifests")
    docs.filter("text IS NOT NULL").select("counter_id", "text").write.parquet(path)
    found = FS.classify_manifests(spark.read.parquet(path), "text").select(F.col("counter_id").alias("have"), "error")
    expected = docs.select("counter_id")
    j = expected.join(found, expected["counter_id"] == found["have"], "left")
    error = F.when(F.col("have").isNull(), F.lit("missing_file")).otherwise(F.col("error"))
    return j.groupBy(error.alias("error")).agg(
        F.count(F.lit(1)).alias("n_manifests"), F.count(F.when(F.col("have").isNotNull() & F.col("error").isNull(), 1)).alias("n_current"))


@query("counter_settings", with_views("reference_counters") + """
SELECT site, CASE WHEN CAST(counter_id AS BIGINT) % 3 = 0 THEN 3 ELSE 7 END AS ar, 24 AS roll, count(*) AS n_counters,
  round(CAST(0.25 AS DOUBLE), 6) AS test_ratio
FROM reference_counters GROUP BY 1, 2""", FAM)
def counter_settings(spark, sf_dir):
    """Counter settings documents (one per counter) with defaults filled in."""
    r = reference_counters(spark, sf_dir)
    body = F.struct("site", F.when(F.col("counter_id").cast("bigint") % 3 == 0, F.struct(F.lit(3).alias("ar"))).alias("modeling"))
    docs = r.select(F.to_json(F.struct(F.create_map("counter_id", body).alias("counters"))).alias("value"))
    path = _folder(spark, "settings")
    docs.write.text(path)
    cfg = FS.counter_config(spark.read.text(path))
    return cfg.groupBy("site", "ar", "roll", "test_ratio").agg(F.count(F.lit(1)).alias("n_counters")).select(
        "site", "ar", "roll", "n_counters", "test_ratio")


@query("counter_rows", """
SELECT coalesce(site, '(none)') AS site, orientation, count(*) AS n_rows FROM (
  SELECT CASE WHEN event_type <> 'error' THEN event_type END AS site, CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END AS orientation FROM events)
WHERE site IS NULL AND orientation = 'N-S' GROUP BY 1, 2""", FAM)
def counter_rows(spark, sf_dir):
    """A10: rows of one counter by its exact two-column key; a null site is a value."""
    ev = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("nom_du_site_de_comptage"),
        orientation_of().alias("orientation_compteur"))
    own = FS.select_counter(ev, None, "N-S")
    return own.groupBy(F.coalesce("nom_du_site_de_comptage", F.lit("(none)")).alias("site"),
                       F.col("orientation_compteur").alias("orientation")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("percent_gate", """
WITH x AS (SELECT CAST(user_id % 112 - 4 AS DOUBLE) AS a, CAST(event_id % 108 AS DOUBLE) AS b,
             (user_id % 20) / 20.0 AS ratio, user_id % 4 - 1 AS grid FROM events)
SELECT concat_ws(',', CASE WHEN a < 0 OR a > 100 OR b < 0 OR b > 100 THEN 'percent_bounds' END, CASE WHEN a > b THEN 'start_after_end' END,
    CASE WHEN ratio <= 0 OR ratio >= 0.95 THEN 'test_ratio' END, CASE WHEN grid < 0 THEN 'grid' END) AS failed, count(*) AS n_rows
FROM x GROUP BY 1""", FAM)
def percent_gate(spark, sf_dir):
    """Parameter gates of a slice, with start equal to end allowed."""
    x = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 112 - 4).cast("double").alias("a"), (F.col("event_id") % 108).cast("double").alias("b"),
        ((F.col("user_id") % 20) / 20.0).alias("ratio"), (F.col("user_id") % 4 - 1).alias("grid"))
    failed = V.parameter_gate(F.col("a"), F.col("b"), F.col("ratio"), F.col("grid"))
    return x.groupBy(F.array_join(failed, ",").alias("failed")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("union_and_align", with_views("counts") + """,
n AS (SELECT *, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn, count(*) OVER (PARTITION BY counter_id) AS n,
        lag(hourly_count) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS lag_1 FROM counts),
u AS (SELECT counter_id, rn, hourly_count, CASE WHEN rn <= n - n // 4 THEN lag_1 END AS lag_1 FROM n)
SELECT counter_id, count(*) AS n_rows, count(lag_1) AS n_lag, count(CASE WHEN lag_1 IS NOT NULL THEN 1 END) AS n_aligned,
  CAST(coalesce(sum(CASE WHEN lag_1 IS NOT NULL THEN hourly_count END), 0) AS BIGINT) AS aligned_total
FROM u GROUP BY 1""", FAM)
def union_and_align(spark, sf_dir):
    """A62 + A64: train rows (with a lag) and test rows (without) united with
    the missing column filled by null; the target aligned to the complete rows."""
    w = Window.partitionBy("counter_id").orderBy("ts_utc")
    rows = counts(spark, sf_dir).select(
        "counter_id", "hourly_count", F.row_number().over(w).alias("rn"), F.lag("hourly_count").over(w).alias("lag_1"),
        F.count(F.lit(1)).over(Window.partitionBy("counter_id")).alias("n"))
    is_test = F.col("rn") > F.col("n") - F.floor(F.col("n") / 4)
    both = seq.union_missing(rows.filter(~is_test).drop("n"), rows.filter(is_test).drop("n", "lag_1"))
    kept = seq.align(both, both.filter("lag_1 IS NOT NULL"), ["counter_id", "rn"])
    totals = kept.groupBy("counter_id").agg(F.count(F.lit(1)).alias("n_aligned"), F.sum("hourly_count").alias("t"))
    return (both.groupBy("counter_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("lag_1").alias("n_lag"))
            .join(totals, "counter_id", "left").select(
                "counter_id", "n_rows", "n_lag", F.coalesce("n_aligned", F.lit(0)).alias("n_aligned"),
                F.coalesce("t", F.lit(0)).cast("bigint").alias("aligned_total")))


@query("served_counters", with_views("ledger") + """,
cur AS (SELECT counter_id, arg_max(run_id, (promoted_at, CAST(run_id AS BIGINT))) AS run_id FROM ledger
        WHERE status = 'promoted' AND artifact_type = 'predictions' GROUP BY 1)
SELECT cur.counter_id, cur.run_id, count(l_linenumber) AS n_rows, round(coalesce(sum(l_quantity), 0), 6) AS total
FROM cur LEFT JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = cur.run_id GROUP BY 1, 2""", FAM)
def served_counters(spark, sf_dir):
    """A65 + A27: each counter's current prediction artifact, looked up in the
    ledger and joined with its payload rows, listed in counter order."""
    own = ledger(spark, sf_dir).filter((F.col("status") == "promoted") & (F.col("artifact_type") == "predictions"))
    cur = own.groupBy("counter_id").agg(F.max_by("run_id", F.struct("promoted_at", F.col("run_id").cast("bigint"))).alias("run_id"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("_run"), "l_linenumber", "l_quantity")
    from hourcast.functions.numeric import round_scaled
    return (cur.join(rows, cur["run_id"] == rows["_run"], "left").groupBy("counter_id", "run_id").agg(
        F.count("l_linenumber").alias("n_rows"), round_scaled(F.coalesce(F.sum("l_quantity"), F.lit(0)).cast("double"), 6).alias("total"))
        .orderBy("counter_id"))


@query("run_rewrite", with_views("ledger") + """
SELECT artifact_type, CASE WHEN artifact_type = 'predictions' THEN 'archived' ELSE status END AS status, count(*) AS n_runs
FROM ledger GROUP BY 1, 2""", FAM)
def run_rewrite(spark, sf_dir):
    """Run manifests appended under (type, counter, run); the last write of
    a key replaces the earlier ones at read time."""
    lg = ledger(spark, sf_dir)
    path = _folder(spark, "runs")
    LG.append_runs(lg, path, 1)
    LG.append_runs(lg.filter(F.col("artifact_type") == "predictions").withColumn("status", F.lit("archived")), path, 2)
    return (LG.current_runs(spark.read.parquet(path)).groupBy("artifact_type", "status")
            .agg(F.count(F.lit(1)).alias("n_runs")))


@query("metric_sink", ORACLE["kpi_samples"], FAM)
def metric_sink(spark, sf_dir):
    """Metric samples appended to the long metric table and read back."""
    from hourcast.catalog.series import kpi_samples
    path = _folder(spark, "samples")
    SK.append_samples(kpi_samples(spark, sf_dir), path)
    return spark.read.parquet(path).select("counter_id", "metric", "kind", "value")


@query("scrape_windows", """
SELECT DISTINCT CAST(user_id % 40 AS BIGINT) AS window_s, CAST(greatest(user_id % 40 + 5, 20) AS BIGINT) AS rate_window_s FROM events""", FAM)
def scrape_windows(spark, sf_dir):
    """``clamp_min(window + scrape, 4 * scrape)`` of every panel window."""
    w = (F.col("user_id") % 40).alias("window_s")
    ev = table(spark, sf_dir, "events").select(w).distinct()
    return ev.select("window_s", M.rate_window_col(F.col("window_s")).alias("rate_window_s"))


@query("outcome_routing", """
WITH x AS (SELECT event_type, value, user_id % 50 AS n, user_id % 13 = 0 AS no_key, user_id % 17 = 0 AS retired FROM events)
SELECT CASE WHEN no_key THEN 'schema_failure' WHEN event_type = 'error' THEN 'quarantined' WHEN retired THEN 'excluded'
         WHEN value IS NULL OR value < 5 THEN 'fallback' WHEN n > 40 THEN 'warned' ELSE 'accepted' END AS route,
  concat_ws(',', CASE WHEN no_key THEN 'counter_missing' END, CASE WHEN event_type = 'error' THEN 'count_not_numeric' END,
    CASE WHEN retired THEN 'counter_retired' END, CASE WHEN value IS NULL OR value < 5 THEN 'weather_missing' END,
    CASE WHEN n > 40 THEN 'count_high' END) AS reasons, count(*) AS n_rows
FROM x GROUP BY 1, 2""", FAM)
def outcome_routing(spark, sf_dir):
    """The five outcome levels in order of severity, every reason kept."""
    ev = table(spark, sf_dir, "events")
    routed = V.route_levels(ev, {
        "schema_failure": [("counter_missing", F.col("user_id") % 13 == 0)],
        "quarantined": [("count_not_numeric", F.col("event_type") == "error")],
        "excluded": [("counter_retired", F.col("user_id") % 17 == 0)],
        "fallback": [("weather_missing", F.coalesce(F.col("value") < 5, F.lit(True)))],
        "warned": [("count_high", F.col("user_id") % 50 > 40)]})
    return routed.groupBy("route", F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n_rows"))
