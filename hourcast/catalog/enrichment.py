"""Enrichment and contract-validation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.functions.calendar import parse_utc, to_local
from hourcast.functions.timecols import hour_floor
from hourcast.operators import enrich as EN
from hourcast.operators import validate as V
from hourcast.operators.asof import asof_join
from hourcast.operators.bucketed import bucketed_lag
from hourcast.sources.tables import counts, orientation_of, reference_counters, table, with_views

FAM = "enrich"
PARIS_SQL = "timezone('Europe/Paris', timezone('UTC', {c}))"


def _values_sql(rows):
    def lit(v):
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


@query("holiday_join", with_views("counts") + f""",
h AS (SELECT CAST(d AS DATE) AS day, label FROM (VALUES {_values_sql(EN.PUBLIC_HOLIDAYS_2024.items())}) t(d, label))
SELECT counter_id, h.label IS NOT NULL AS is_public_holiday, h.label AS holiday_label,
       count(*) AS n_hours, CAST(sum(hourly_count) AS BIGINT) AS total
FROM counts LEFT JOIN h ON CAST({PARIS_SQL.format(c='ts_utc')} AS DATE) = h.day
GROUP BY 1, 2, 3""", FAM)
def holiday_join(spark, sf_dir):
    """C12 + C13: public-holiday map (JSON) flagged on the Paris civil date."""
    c = counts(spark, sf_dir)
    flagged = EN.flag_public_holidays(c, "ts_utc", EN.public_holidays(spark))
    return flagged.groupBy("counter_id", "is_public_holiday", "holiday_label").agg(
        F.count(F.lit(1)).alias("n_hours"), F.sum("hourly_count").cast("bigint").alias("total"))


@query("school_holiday_join", with_views("counts") + f""",
sh AS (SELECT * FROM (VALUES {_values_sql(EN.SCHOOL_HOLIDAYS)}) t(label, zone, location, s, e)),
kept AS (SELECT label, CAST(s AS DATE) AS s, CAST(e AS DATE) AS e FROM sh
         WHERE zone = 'Zone C' AND location = 'Paris' AND CAST(s AS DATE) < CAST(e AS DATE)),
days AS (SELECT CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day, label FROM kept),
dl AS (SELECT day, string_agg(label, '+' ORDER BY label) AS labels FROM days GROUP BY day)
SELECT counter_id, coalesce(dl.labels, 'none') AS school_holiday, count(*) AS n_hours
FROM counts LEFT JOIN dl ON CAST({PARIS_SQL.format(c='ts_utc')} AS DATE) = dl.day
GROUP BY 1, 2""", FAM)
def school_holiday_join(spark, sf_dir):
    """C14 + C15: Paris / zone C school periods ``[start, end)`` exploded to
    days, then an equi join on the Paris civil date.  Overlapping periods on
    one day are reported together (C16 flags them)."""
    days = EN.school_days(spark)
    per_day = days.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("label")), "+").alias("labels"))
    c = counts(spark, sf_dir).withColumn("day", F.to_date(to_local("ts_utc")))
    j = c.join(per_day, "day", "left")
    return j.groupBy("counter_id", F.coalesce("labels", F.lit("none")).alias("school_holiday")).agg(
        F.count(F.lit(1)).alias("n_hours"))


LABELS = ["F", "O", "P"]  # of the SQL twin; the operator takes any labels


def _overlap_sql():
    maxes = ",\n  ".join(
        f"max(CASE WHEN o_orderstatus = '{lab}' THEN e END) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m_{lab}" for lab in LABELS)
    conflict = " OR ".join(f"(o_orderstatus <> '{lab}' AND m_{lab} > s)" for lab in LABELS)
    return f"""
WITH iv AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS s,
              o_orderdate + to_days(CAST(left(o_orderpriority, 1) AS INTEGER) * 7) AS e FROM orders),
x AS (SELECT *, {maxes} FROM iv)
SELECT o_orderstatus, coalesce({conflict}, false) AS overlap_warning, count(*) AS n_intervals
FROM x GROUP BY 1, 2"""


@query("overlap_check", _overlap_sql(), FAM)
def overlap_check(spark, sf_dir):
    """Intervals overlapping an earlier interval with a different label
    (per customer: [order date, + priority weeks), labelled by status)."""
    o = table(spark, sf_dir, "orders")
    iv = o.select("o_custkey", F.col("o_orderkey").alias("_tie"), "o_orderstatus",
                  F.col("o_orderdate").alias("s"),
                  F.timestamp_add("DAY", (F.substring("o_orderpriority", 1, 1).cast("int") * 7),
                                  F.col("o_orderdate")).alias("e"),
                  (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("_bucket"))  # month buckets
    flagged = EN.overlap_flags(iv, "o_custkey", "s", "e", "o_orderstatus", "_bucket")
    return flagged.groupBy("o_orderstatus", "overlap_warning").agg(F.count(F.lit(1)).alias("n_intervals"))


@query("overlap_check_clerks", """
WITH iv AS (SELECT o_custkey, o_orderkey, o_clerk, o_orderdate AS s,
              o_orderdate + to_days(CAST(left(o_orderpriority, 1) AS INTEGER) * 7) AS e FROM (
                SELECT *, CAST(o_orderkey % 97 AS VARCHAR) AS o_clerk FROM orders))
SELECT count(*) AS n_intervals, count(*) FILTER (WHERE EXISTS (
    SELECT 1 FROM iv r WHERE r.o_custkey = iv.o_custkey AND r.o_clerk <> iv.o_clerk AND r.e > iv.s
      AND (r.s < iv.s OR (r.s = iv.s AND r.o_orderkey < iv.o_orderkey)))) AS n_warned
FROM iv""", FAM)
def overlap_check_clerks(spark, sf_dir):
    """C16 with many labels (a hundred order groups)."""
    o = table(spark, sf_dir, "orders")
    iv = o.select("o_custkey", F.col("o_orderkey").alias("_tie"), (F.col("o_orderkey") % 97).cast("string").alias("clerk"),
                  F.col("o_orderdate").alias("s"),
                  F.timestamp_add("DAY", (F.substring("o_orderpriority", 1, 1).cast("int") * 7),
                                  F.col("o_orderdate")).alias("e"),
                  (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("_bucket"))
    flagged = EN.overlap_flags(iv, "o_custkey", "s", "e", "clerk", "_bucket")
    return flagged.agg(F.count(F.lit(1)).alias("n_intervals"), F.count(F.when(F.col("overlap_warning"), 1)).alias("n_warned"))


@query("holiday_contract", """
SELECT strftime(day, '%Y-%m-%d') AS day, n_labels, label, CASE WHEN year(day) <> 1995 THEN 'out_of_year' WHEN n_labels > 1 THEN 'duplicate_date' ELSE 'ok' END AS outcome
FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT label) AS n_labels, min(label) AS label
      FROM (SELECT o_orderdate, CASE WHEN o_custkey % 29 = 0 THEN o_orderpriority ELSE 'day ' || CAST(day(o_orderdate) AS VARCHAR) END AS label FROM orders)
      GROUP BY 1)""", FAM)
def holiday_contract(spark, sf_dir):
    """Dates with their labels: unique, ambiguous, or outside the year.

    Every order names its date after the day of the month, some customers after
    the order's priority: dates with such an order are ambiguous."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", F.when(F.col("o_custkey") % 29 == 0, F.col("o_orderpriority")).otherwise(
        F.concat(F.lit("day "), F.dayofmonth("o_orderdate").cast("string"))).alias("label"))
    return EN.dated_labels(o, "o_orderdate", "label", 1995).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n_labels", "label", "outcome")


@query("period_contract", """
SELECT CASE WHEN NOT coalesce(s < e, false) THEN 'quarantine:invalid_interval' WHEN zone <> 'Zone C' THEN 'excluded:zone'
         WHEN location IS NULL OR location <> 'Paris' THEN 'excluded:location' ELSE 'kept' END AS outcome, count(*) AS n_periods
FROM (SELECT o_orderdate AS s, o_orderdate + to_days(CAST(o_custkey % 9 - 2 AS INTEGER)) AS e,
        CASE o_custkey % 3 WHEN 0 THEN 'Zone A' WHEN 1 THEN 'Zone B' ELSE 'Zone C' END AS zone,
        CASE WHEN o_orderkey % 4 = 0 THEN 'Lyon' WHEN o_orderkey % 7 <> 0 THEN 'Paris' END AS location FROM orders) GROUP BY 1""", FAM)
def period_contract(spark, sf_dir):
    """C14: kept, excluded and quarantined periods, counted by reason."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("s"), F.timestamp_add("DAY", (F.col("o_custkey") % 9 - 2).cast("int"), F.col("o_orderdate")).alias("e"),
        F.when(F.col("o_custkey") % 3 == 0, "Zone A").when(F.col("o_custkey") % 3 == 1, "Zone B").otherwise("Zone C").alias("zone"),
        F.when(F.col("o_orderkey") % 4 == 0, "Lyon").when(F.col("o_orderkey") % 7 != 0, "Paris").alias("location"))
    return (EN.period_outcomes(o, "zone", "location", "Zone C", "Paris", "s", "e").groupBy("outcome")
            .agg(F.count(F.lit(1)).alias("n_periods")))


def _forecasts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    f = ev.filter(F.col("event_type") == "view").select(
        F.timestamp_add("HOUR", (F.col("user_id") % 3 + 1).cast("int"), hour_floor("ts")).alias("valid_hour"),
        F.col("ts").alias("issued_at"), F.col("event_id").alias("forecast_id"),
        F.col("value").alias("forecast_value"))
    p = ev.filter(F.col("event_type") == "purchase").select(
        "event_id", F.col("ts").alias("cutoff"),
        F.timestamp_add("HOUR", F.lit(1), hour_floor("ts")).alias("valid_hour"))
    return f, p


@query("asof_forecast", """
WITH f AS (SELECT date_trunc('hour', ts) + to_hours(user_id % 3 + 1) AS valid_hour, ts AS issued_at,
             event_id AS forecast_id, value AS forecast_value FROM events WHERE event_type = 'view'),
p AS (SELECT event_id, ts AS cutoff, date_trunc('hour', ts) + INTERVAL 1 HOUR AS valid_hour FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.cutoff, p.valid_hour, CAST(f.forecast_id AS DOUBLE) AS forecast_id, f.forecast_value, f.issued_at
FROM p ASOF LEFT JOIN f ON p.valid_hour = f.valid_hour AND p.cutoff >= f.issued_at""", FAM)
def asof_forecast(spark, sf_dir):
    """For each cut-off, the latest forecast for the next hour issued at
    or before the cut-off (point-in-time, no look-ahead)."""
    f, p = _forecasts(spark, sf_dir)
    j = asof_join(p, f, ["valid_hour"], "cutoff", "issued_at", ["forecast_id", "forecast_value"],
                  bucket_us=3_600_000_000, right_tie=["forecast_id"])
    # no forecast -> null id: published as double (see history._merged_out)
    return j.select("event_id", "cutoff", "valid_hour", F.col("forecast_id").cast("double").alias("forecast_id"),
                    "forecast_value", "issued_at")


@query("scd2_versions", """
SELECT o_custkey AS custkey, o_orderkey AS version_id, o_orderpriority AS segment, o_orderdate AS valid_from,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to
FROM orders""", FAM)
def scd2_versions(spark, sf_dir):
    """Versioned reference metadata – every change is a new version whose
    validity ends where the next one starts (bucketed lead, no hot task)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("version_id"),
        F.col("o_orderpriority").alias("segment"), F.col("o_orderdate").alias("valid_from"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("_bucket"))  # month buckets
    v = bucketed_lag(o, ["custkey"], ["valid_from", "version_id"], "_bucket", "valid_from", "valid_to",
                     reverse=True)
    return v.drop("_bucket")


@query("scd2_join", """
WITH li AS (SELECT l.l_orderkey, l.l_linenumber, o.o_custkey AS custkey, l.l_shipdate AS t
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
u AS (SELECT custkey, t, 1 AS kind, l_orderkey, l_linenumber, NULL::BIGINT AS vkey, NULL::VARCHAR AS vseg FROM li
      UNION ALL SELECT o_custkey, o_orderdate, 0, NULL, NULL, o_orderkey, o_orderpriority FROM orders),
x AS (SELECT *, last_value(CASE WHEN kind = 0 THEN {'k': vkey, 's': vseg} END IGNORE NULLS)
        OVER (PARTITION BY custkey ORDER BY t, kind, vkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM u)
SELECT l_orderkey, l_linenumber, CAST(v.k AS DOUBLE) AS version_id, v.s AS segment FROM x WHERE kind = 1""", FAM)
def scd2_join(spark, sf_dir):
    """The customer version in force at each line's ship date (range
    join on the SCD-2 validity, computed as a bucketed as-of join)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders")
    left = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey")),
                   "l_orderkey")
    right = o.select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("valid_from"),
                     F.col("o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("segment"))
    j = asof_join(left, right, ["custkey"], "l_shipdate", "valid_from", ["version_id", "segment"],
                  bucket_us=7 * 86_400_000_000, right_tie=["version_id"])  # one-week buckets
    return j.select("l_orderkey", "l_linenumber", F.col("version_id").cast("double").alias("version_id"), "segment")


def _wmo_sql(c):
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in EN.WMO_4677) + " END"


@query("wmo_categories", f"""
SELECT {_wmo_sql('user_id % 100')} AS weather_category, count(*) AS n_rows,
       count(DISTINCT user_id % 100) AS n_codes FROM events GROUP BY 1""", FAM)
def wmo_categories(spark, sf_dir):
    """C20: WMO 4677 code ranges to category labels."""
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("code"))
    return ev.groupBy(EN.wmo_category("code").alias("weather_category")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("code").alias("n_codes"))


def _polygons_sql():
    rows = []
    for label, ring in EN.POLYGONS:
        pts = ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in ring)
        rows.append(f"('{label}', [{pts}])")
    return ", ".join(rows)


@query("point_in_polygon", f"""
WITH pts AS (SELECT event_id, (value % 250) / 100.0 AS x, (user_id % 120) / 100.0 AS y FROM events),
poly AS (SELECT * FROM (VALUES {_polygons_sql()}) t(label, ring)),
edges AS (SELECT label, len(ring) AS n, ring, unnest(range(len(ring))) AS i FROM poly),
e2 AS (SELECT label, n, ring[i + 1] AS a, ring[(i + 1) % n + 1] AS b,
         list_min(list_transform(ring, lambda v: v.x)) AS x0, list_max(list_transform(ring, lambda v: v.x)) AS x1,
         list_min(list_transform(ring, lambda v: v.y)) AS y0, list_max(list_transform(ring, lambda v: v.y)) AS y1
       FROM edges),
c AS (SELECT p.event_id, e2.label,
        bool_and(e2.n >= 3) AS valid,
        bool_and(p.x >= x0 AND p.x <= x1 AND p.y >= y0 AND p.y <= y1) AS in_box,
        sum(CASE WHEN ((a.y > p.y) <> (b.y > p.y)) AND p.x < (b.x - a.x) * (p.y - a.y) / (b.y - a.y) + a.x THEN 1 ELSE 0 END) AS crossings
      FROM pts p, e2 GROUP BY 1, 2),
hit AS (SELECT event_id, count(*) FILTER (WHERE valid AND in_box AND crossings % 2 = 1) AS n_hits,
          max(CASE WHEN valid AND in_box AND crossings % 2 = 1 THEN label END) AS label FROM c GROUP BY 1)
SELECT CASE WHEN n_hits = 0 THEN 'none' WHEN n_hits > 1 THEN 'multiple' ELSE label END AS polygon,
       count(*) AS n_points FROM hit GROUP BY 1""", FAM)
def point_in_polygon(spark, sf_dir):
    """Label every point with the polygon containing it (ray casting);
    the invalid ring is quarantined and never matches."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", ((F.col("value") % 250) / 100.0).alias("x"), ((F.col("user_id") % 120) / 100.0).alias("y"))
    p = EN.point_in_polygon(ev, "x", "y")
    assigned = (F.when(F.col("n_hits") == 0, "none").when(F.col("n_hits") > 1, "multiple")
                .otherwise(F.element_at("polygons", 1)))
    return p.groupBy(assigned.alias("polygon")).agg(F.count(F.lit(1)).alias("n_points"))


def _raw_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    count_text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(
        F.get_json_object("props", "$.k"))
    ts_text = F.when((F.col("event_type") == "signup") & (F.col("value") > 300), F.lit("not a time")).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))
    return ev.select("event_id", F.concat_ws("_", "event_type", orientation_of()).alias("counter_id"),
                     count_text.alias("count_text"), ts_text.alias("ts_text"))


@query("value_rules", """
WITH r AS (SELECT concat(event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END) AS counter_id,
    CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS count_text,
    CASE WHEN event_type = 'signup' AND value > 300 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' END AS ts_text
  FROM events),
v AS (SELECT *, TRY_CAST(count_text AS BIGINT) * 40 AS cnt,
        try_strptime(ts_text, '%Y-%m-%d %H:%M:%S%z') IS NULL AS bad_ts FROM r),
x AS (SELECT counter_id, cnt,
  concat_ws(',', CASE WHEN cnt IS NULL THEN 'count_not_numeric' END,
                 CASE WHEN cnt < 0 THEN 'count_negative' END,
                 CASE WHEN bad_ts THEN 'timestamp_unparsable' END) AS q,
  concat_ws(',', CASE WHEN cnt > 3000 THEN 'count_above_3000' END) AS w FROM v)
SELECT counter_id, CASE WHEN q <> '' THEN 'quarantined' WHEN w <> '' THEN 'warned' ELSE 'accepted' END AS route,
  q AS quarantine_reasons, w AS warning_reasons, count(*) AS n_rows,
  CAST(sum(CASE WHEN q = '' THEN least(cnt, 3000) END) AS DOUBLE) AS capped_total
FROM x GROUP BY 1, 2, 3, 4""", FAM)
def value_rules(spark, sf_dir):
    """C3 + C4 + C5: numeric non-negative count and parseable time, else
    quarantine; counts above 3000 are warned and kept raw, with the capped
    value alongside (rule version v1)."""
    r = _raw_counts(spark, sf_dir)
    r = r.withColumns({"cnt": V.parse_count(F.col("count_text")) * 40,
                       "bad_ts": parse_utc("ts_text").isNull()})
    routed = V.route(r, [("count_not_numeric", F.col("cnt").isNull()),
                         ("count_negative", F.col("cnt") < 0),
                         ("timestamp_unparsable", F.col("bad_ts"))],
                     [("count_above_3000", F.col("cnt") > 3000)])
    ok = F.size("quarantine_reasons") == 0
    return routed.groupBy(
        "counter_id", "route", F.array_join("quarantine_reasons", ",").alias("quarantine_reasons"),
        F.array_join("warning_reasons", ",").alias("warning_reasons")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(ok, F.least(F.col("cnt"), F.lit(3000)))).cast("double").alias("capped_total"))


@query("reconcile", with_views("reference_counters") + """,
obs AS (SELECT CAST(user_id AS VARCHAR) AS counter_id, count(*) AS n_rows FROM events GROUP BY 1)
SELECT o.counter_id, o.n_rows, r.counter_id IS NOT NULL AS resolved, r.area,
       CASE WHEN r.counter_id IS NULL THEN 'quarantine' ELSE 'accepted' END AS outcome
FROM obs o LEFT JOIN reference_counters r ON o.counter_id = r.counter_id""", FAM)
def reconcile(spark, sf_dir):
    """Observation identities reconciled with the reference; unresolved
    ones are quarantined with their row count as evidence."""
    ev = table(spark, sf_dir, "events")
    obs = ev.groupBy(F.col("user_id").cast("string").alias("counter_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    ref = reference_counters(spark, sf_dir).select(F.col("counter_id").alias("_rid"), "area")
    j = obs.join(ref, obs.counter_id == ref._rid, "left")
    return j.select("counter_id", "n_rows", F.col("_rid").isNotNull().alias("resolved"), "area",
                    F.when(F.col("_rid").isNull(), "quarantine").otherwise("accepted").alias("outcome"))


@query("weather_usage", """
WITH w AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'observation'
                       WHEN event_type IN ('purchase', 'signup') THEN 'forecast' END AS mode,
             CASE WHEN event_type IN ('purchase', 'signup') AND value > 300 THEN NULL ELSE ts END AS issued_at,
             CASE WHEN value < 1 THEN NULL ELSE value END AS temperature FROM events)
SELECT mode, CASE mode WHEN 'observation' THEN 'training' WHEN 'forecast' THEN 'serving' END AS use,
  CASE WHEN mode IS NULL THEN 'block:unknown_mode' WHEN mode = 'forecast' AND issued_at IS NULL THEN 'block:missing_issue_time'
       WHEN temperature IS NULL THEN 'warning:missing_field' ELSE 'ok' END AS outcome,
  count(*) AS n_rows
FROM w GROUP BY 1, 2, 3""", FAM)
def weather_usage(spark, sf_dir):
    """C17 + C19: observations feed training only and forecasts serving only;
    a forecast without issue time blocks, a missing field is a warning."""
    ev = table(spark, sf_dir, "events")
    mode = (F.when(F.col("event_type").isin("click", "view"), "observation")
            .when(F.col("event_type").isin("purchase", "signup"), "forecast"))
    w = ev.select(mode.alias("mode"),
                  F.when(F.col("event_type").isin("purchase", "signup") & (F.col("value") > 300), F.lit(None))
                  .otherwise(F.col("ts")).alias("issued_at"),
                  F.when(F.col("value") < 1, F.lit(None)).otherwise(F.col("value")).alias("temperature"))
    use = F.when(F.col("mode") == "observation", "training").when(F.col("mode") == "forecast", "serving")
    outcome = (F.when(F.col("mode").isNull(), "block:unknown_mode")
               .when((F.col("mode") == "forecast") & F.col("issued_at").isNull(), "block:missing_issue_time")
               .when(F.col("temperature").isNull(), "warning:missing_field").otherwise("ok"))
    return w.groupBy("mode", use.alias("use"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("metadata_fill", with_views("counts") + """,
x AS (SELECT counter_id, ts_utc, CASE WHEN hourly_count >= 8 THEN upper(trim(site)) || ' ' || regexp_extract(counter_id, '_(.*)$', 1) END AS label FROM counts),
y AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM x)
SELECT counter_id, count(*) AS n_rows, count(label) AS n_known, count(filled) - count(label) AS n_propagated,
       count(*) - count(filled) AS n_unknown, max(filled) AS site_label
FROM y GROUP BY 1""", FAM)
def metadata_fill(spark, sf_dir):
    """C11: metadata known on some rows (normalised site name + orientation
    extracted from the id) propagated forward in time per counter."""
    c = counts(spark, sf_dir)
    label = F.when(F.col("hourly_count") >= 8, F.concat(F.upper(F.trim("site")), F.lit(" "),
                                                       F.regexp_extract("counter_id", "_(.*)$", 1)))
    x = c.select("counter_id", "ts_utc", label.alias("label"))
    w = Window.partitionBy("counter_id").orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    y = x.withColumn("filled", F.last("label", ignorenulls=True).over(w))
    return y.groupBy("counter_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("label").alias("n_known"),
        (F.count("filled") - F.count("label")).alias("n_propagated"),
        (F.count(F.lit(1)) - F.count("filled")).alias("n_unknown"), F.max("filled").alias("site_label"))
