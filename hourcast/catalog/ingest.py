"""Raw-file ingest query (A1, A10, A12, A15, A16, A43): the raw counter CSV
is produced from ``events``, written to the shared checkpoint folder, and read
back through the file sources exactly as the reference's raw file would be."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.catalog.text import _slug_sql
from hourcast.session import ensure_checkpoint_dir
from hourcast.sources import files as FS
from hourcast.sources.tables import orientation_of, table

FAM = "ingest"
# A site label with accents, to exercise the ASCII slug of the counter id.
ACCENTED_SITE = "Totem 73 boulevard de Sébastopol"


def raw_counts_csv(spark, sf_dir) -> str:
    """Write the events as a raw counter CSV (leading index column, ISO text
    time with a +01:00 offset, text counts with junk) and return its path."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "raw_counts", uuid.uuid4().hex)
    ev = table(spark, sf_dir, "events")
    site = F.when(F.col("event_type") == "view", F.lit(ACCENTED_SITE)).otherwise(F.col("event_type"))
    count_text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(
        (F.col("user_id") % 50).cast("string"))
    raw = ev.select(F.col("event_id").alias("idx"), site.alias("nom_du_site_de_comptage"),
                    orientation_of().alias("orientation_compteur"),
                    F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))
                    .alias("date_et_heure_de_comptage"),
                    count_text.alias("comptage_horaire"))
    raw.write.option("header", True).csv(path)
    return path


@query("raw_ingest", f"""
WITH r AS (SELECT CASE WHEN event_type = 'view' THEN '{ACCENTED_SITE}' ELSE event_type END AS site,
             CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END AS orientation,
             date_trunc('second', ts) - INTERVAL 1 HOUR AS ts_utc,
             CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 50 END AS cnt FROM events)
SELECT {_slug_sql('site', 'A-Za-z0-9\\-_', '_', True, 64, 'counter')} || '_' || orientation AS counter_id,
  count(*) AS n_rows, count(*) - count(cnt) AS n_bad_counts, CAST(sum(cnt) AS DOUBLE) AS total,
  min(ts_utc) AS first_ts, max(ts_utc) AS last_ts
FROM r GROUP BY 1""", FAM)
def raw_ingest(spark, sf_dir):
    """A1 + A15 + A43: raw CSV scan (index column dropped), ISO offset times
    to UTC, ASCII-slug counter ids, non-numeric counts kept as null."""
    df = FS.read_raw_counts(spark, raw_counts_csv(spark, sf_dir))
    n = FS.normalize_raw(df)
    return n.groupBy("counter_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count("hourly_count")).alias("n_bad_counts"),
        F.sum("hourly_count").cast("double").alias("total"),  # null when no count parses
        F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))


# An operator-supplied allow-list as it arrives in configuration text.
ALLOW_LIST_TEXT = " click_N-S, ,view_S-N,Totem_73_N-S ,signup_S-N,unknown_X,"


@query("allow_list_check", """
WITH counts AS (SELECT DISTINCT concat(event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END) AS counter_id
                FROM events),
req AS (SELECT DISTINCT trim(x) AS counter_id
        FROM (SELECT unnest(string_split('""" + ALLOW_LIST_TEXT + """', ',')) AS x) WHERE trim(x) <> '')
SELECT r.counter_id, CASE WHEN c.counter_id IS NULL THEN 'unknown' ELSE 'present' END AS status
FROM req r LEFT JOIN counts c ON r.counter_id = c.counter_id""", FAM)
def allow_list_check(spark, sf_dir):
    """A7 + A12: a comma-separated allow-list (trimmed, blanks dropped) checked
    against the counters present in the data; missing keys are reported."""
    from hourcast.sources.tables import counts
    present = counts(spark, sf_dir).select("counter_id").distinct()
    req = (spark.range(1).select(F.explode(FS.allow_list(F.lit(ALLOW_LIST_TEXT))).alias("counter_id"))
           .distinct())
    unknown = FS.unknown_keys(req, present, ["counter_id"]).select("counter_id", F.lit("unknown").alias("status"))
    known = req.join(present, "counter_id", "left_semi").select("counter_id", F.lit("present").alias("status"))
    return known.unionByName(unknown)
