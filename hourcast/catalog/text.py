"""Text, label, path and hash queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.catalog.series import TEST_RATIO, _features
from hourcast.functions import labels as L
from hourcast.operators import sequence as seq
from hourcast.operators import textscan as TS
from hourcast.operators.evaluate import metric_aggs, round_doubles
from hourcast.sources.filehash import file_hashes
from hourcast.sources.tables import reference_counters, table, with_views

FAM = "text"

def _sanitize_sql(c):
    for t in TS.ALLOWED_TERMS:
        c = f"replace({c}, '{t}', '')"
    return c


SCAN_SQL = f"""
WITH parts AS (SELECT doc_id, lang, regexp_split_to_array(text, '{TS.LINE_BREAK}') AS p FROM documents),
l AS (SELECT doc_id, lang, unnest(p) AS line, CAST(unnest(range(1, len(p) + 1)) AS BIGINT) AS line_no FROM parts),
s AS (SELECT *, regexp_matches({_sanitize_sql('line')}, '{TS.flag_pattern(java=False)}') AS flagged FROM l)
"""


@query("line_scan", SCAN_SQL + f"""
SELECT doc_id, line_no,
  concat_ws(': ', concat_ws(':', CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR)),
            regexp_replace(line, '^{TS.SPACE}+|{TS.SPACE}+$', '', 'g')) AS finding
FROM s WHERE flagged""", FAM)
def line_scan(spark, sf_dir):
    """Flagged lines of every document as ``doc:line: text`` findings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return TS.scan(docs).filter("flagged").select("doc_id", "line_no", "finding")


# A second word list, of license lines.
LICENSE_WORDS = [r"licen[sc]ed?", r"copyright", r"permissions?"]


@query("line_scan_license", SCAN_SQL.replace(TS.flag_pattern(java=False), TS.flag_pattern(LICENSE_WORDS, java=False)) + f"""
SELECT doc_id, line_no,
  concat_ws(': ', concat_ws(':', CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR)),
            regexp_replace(line, '^{TS.SPACE}+|{TS.SPACE}+$', '', 'g')) AS finding
FROM s WHERE flagged""", FAM)
def line_scan_license(spark, sf_dir):
    """A97 with another word list: the license lines of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return TS.scan(docs, words=LICENSE_WORDS).filter("flagged").select("doc_id", "line_no", "finding")


@query("line_scan_summary", SCAN_SQL + """
SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines,
  count(*) FILTER (WHERE flagged) AS n_flagged_lines,
  count(DISTINCT CASE WHEN flagged THEN doc_id END) AS n_flagged_docs
FROM s GROUP BY lang""", FAM)
def line_scan_summary(spark, sf_dir):
    """A97 totals per language (all lines of all documents)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    s = TS.scan(docs)
    return s.groupBy("lang").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("flagged"), 1)).alias("n_flagged_lines"),
        F.count_distinct(F.when(F.col("flagged"), F.col("doc_id"))).alias("n_flagged_docs"))


def _slug_sql(x, keep, sep, collapse, cut, default):
    s = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    s = f"regexp_replace({s}, '[^{keep}]+', '{sep}', 'g')"
    if collapse:
        s = f"regexp_replace({s}, '_+', '_', 'g')"
    s = f"regexp_replace({s}, '^_+|_+$', '', 'g')"
    if cut:
        s = f"substr({s}, 1, {cut})"
    if default is not None:
        s = f"coalesce(nullif({s}, ''), '{default}')"
    return s


@query("page_slugs", f"""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, title,
  {_slug_sql('title', 'A-Za-z0-9\\-_', '_', True, 64, 'counter')} AS slug_ascii,
  {_slug_sql('title', 'A-Za-z0-9', '_', False, None, None)} AS slug_label,
  CASE WHEN regexp_replace(regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '[^a-zA-Z0-9_.\\-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') = '' THEN 'unknown'
       ELSE substr(regexp_replace(regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '[^a-zA-Z0-9_.\\-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 48) END AS slug_id
FROM t""", FAM)
def page_slugs(spark, sf_dir):
    """A43 + A44 + A45 on page titles (accented multi-language labels)."""
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return p.select("page_id", "title", L.slug_ascii("title").alias("slug_ascii"),
                    L.slug_label("title").alias("slug_label"), L.slug_id("title").alias("slug_id"))


@query("label_chain", with_views("reference_counters") + """,
x AS (SELECT *, CASE WHEN metric < 0 THEN NULL ELSE counter_name END AS short_name,
        CASE WHEN metric < 1000 THEN '  ' ELSE site END AS raw_label, CASE WHEN metric < -500 THEN area END AS env_site,
        '/data/raw/' || area || ' ' || site || '.csv' AS site_path FROM reference_counters)
SELECT counter_id,
  coalesce(nullif(trim(short_name), ''), nullif(trim(raw_label), ''), nullif(trim(env_site), ''),
           nullif(regexp_replace(regexp_replace(regexp_replace(strip_accents(site_path), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'NA') AS canonical_site,
  split_part(replace(counter_name, '#', '_'), '_', 1) AS site_part,
  coalesce(nullif(split_part(replace(counter_name, '#', '_'), '_', 2), ''), 'NA') AS orientation_part,
  nullif(trim(raw_label), '') AS raw_label_clean
FROM x""", FAM)
def label_chain(spark, sf_dir):
    """A46 + A47 + A48: canonical site by priority chain, id split, blank -> null."""
    r = reference_counters(spark, sf_dir)
    x = r.select("counter_id", "counter_name",
                 F.when(F.col("metric") < 0, F.lit(None)).otherwise(F.col("counter_name")).alias("short_name"),
                 F.when(F.col("metric") < 1000, F.lit("  ")).otherwise(F.col("site")).alias("raw_label"),
                 F.when(F.col("metric") < -500, F.col("area")).alias("env_site"),
                 F.concat(F.lit("/data/raw/"), F.col("area"), F.lit(" "), F.col("site"), F.lit(".csv"))
                 .alias("site_path"))
    site_part, orientation_part = L.split_site_orientation(F.replace(F.col("counter_name"), F.lit("#"), F.lit("_")), True)
    return x.select(
        "counter_id",
        F.coalesce(L.blank_to_null("short_name"), L.blank_to_null("raw_label"), L.blank_to_null("env_site"),
                   F.nullif(L.slug_label("site_path"), F.lit("")), F.lit("NA")).alias("canonical_site"),
        site_part.alias("site_part"), orientation_part.alias("orientation_part"),
        L.blank_to_null("raw_label").alias("raw_label_clean"))


@query("url_checks", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id,
  CASE WHEN url IS NULL THEN NULL WHEN url = '' THEN 'empty_uri'
       WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) <> 's3' THEN 'scheme_not_s3'
       WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) = '' THEN 'missing_bucket'
       WHEN path IN ('', '/') THEN 'missing_key'
       WHEN contains(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '@') THEN 'credentials_in_uri' END AS uri_error,
  CASE WHEN path IS NULL THEN NULL WHEN path = '' THEN 'empty_path'
       WHEN regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN 'scheme_not_allowed'
       WHEN starts_with(path, '/') THEN 'absolute_path'
       WHEN list_contains(string_split(path, '/'), '..') THEN 'parent_traversal' END AS path_error,
  CASE WHEN NOT starts_with(path, '/') THEN path WHEN starts_with(path, '/fr/') THEN substr(path, 5) END AS relative_path,
  CASE WHEN starts_with(path, '/') AND NOT starts_with(path, '/fr/') THEN 'outside_root' END AS relative_error
FROM u""", FAM)
def url_checks(spark, sf_dir):
    """A50 + A51 + A52 over page URLs: object-URI rule, local-path rule and
    the path relative to the ``/fr`` root."""
    u = table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"))
    rel, rel_err = L.relative_to(F.col("path"), "/fr")
    return u.select("page_id", L.object_uri_error("url").alias("uri_error"),
                    L.local_path_error("path").alias("path_error"),
                    rel.alias("relative_path"), rel_err.alias("relative_error"))


@query("run_metrics_flat", with_views("counts") + """,
f AS (SELECT counter_id, hourly_count AS y,
        CAST(lag(hourly_count, 24) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS DOUBLE) AS p,
        row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts),
m AS (SELECT counter_id, CASE WHEN rn > n - n // 4 THEN 'test' ELSE 'train' END AS split,
        sqrt(sum((y - p) * (y - p)) / count(y - p)) AS rmse, avg(abs(y - p)) AS mae, count(y - p) AS n_obs
      FROM f GROUP BY 1, 2)
SELECT counter_id, split || '.' || metric AS key, round(value, 6) AS value FROM (
  SELECT counter_id, split, 'rmse' AS metric, rmse AS value FROM m UNION ALL
  SELECT counter_id, split, 'mae', mae FROM m UNION ALL
  SELECT counter_id, split, 'n_obs', CAST(n_obs AS DOUBLE) FROM m)""", FAM)
def run_metrics_flat(spark, sf_dir):
    """Nested ``{split: {metric: value}}`` per counter flattened to
    dotted keys (the run-tracking parameter layout)."""
    f = _features(spark, sf_dir)
    split = F.when(F.col("rn") > F.col("n") - seq.n_test(F.col("n"), TEST_RATIO), "test").otherwise("train")
    m = (f.withColumn("split", split).groupBy("counter_id", "split")
         .agg(*metric_aggs("hourly_count", "seasonal_pred")))
    inner = F.create_map(F.lit("rmse"), F.col("rmse"), F.lit("mae"), F.col("mae"),
                         F.lit("n_obs"), F.col("n_obs").cast("double"))
    # one row per counter holding the nested document: two splits, bounded size
    nested = m.groupBy("counter_id").agg(
        F.map_from_entries(F.collect_list(F.struct("split", inner))).alias("metrics"))
    outer = nested.select("counter_id", F.explode("metrics").alias("split", "inner"))
    flat = outer.select("counter_id", "split", F.explode("inner").alias("metric", "value"))
    return round_doubles(flat.select("counter_id", F.concat_ws(".", "split", "metric").alias("key"),
                                     "value"))


@query("file_checksums", None, FAM)
def file_checksums(spark, sf_dir):
    """SHA-256 of every input file, lowercase hex, streamed in 1 MiB blocks."""
    # a table can be a folder of part files: the name starts at the table
    return file_hashes(spark, sf_dir, ".parquet").select(
        F.regexp_extract("path", r"([^/]+\.parquet(/[^/]+)?)$", 1).alias("file_name"),
        F.col("length").alias("n_bytes"), "sha256")
