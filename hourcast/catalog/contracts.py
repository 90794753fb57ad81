"""Contracts checked on stored files and whole columns."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.functions.calendar import parse_utc_whole
from hourcast.operators import boundaries as BD
from hourcast.operators import validate as V
from hourcast.session import ensure_checkpoint_dir
from hourcast.sources import filehash as FH
from hourcast.sources import footers as FT
from hourcast.sources import sinks as SK
from hourcast.sources.tables import counts, materialize, orientation_of, table, with_views

FAM = "contract"
COUNTER_SQL = "concat(event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END)"


def _folder(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


# The contract of the hourly counts, two versions.
COUNTS_CONTRACT = [
    (1, "counter_id", "string", True, None),
    (1, "hourly_count", "int", True, None),
    (2, "counter_id", "string", True, "stable counter identity"),
    (2, "hourly_count", "bigint", True, "events of one hour"),
    (2, "site", "string", False, None),
    (2, "ts_utc", "timestamp_ntz", True, "start of the hour, UTC"),
]


def _commented(df, **comments):
    return df.select(*[F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns])


SHAPES = 6
AUDIT_CASES = [(0, "hourly_count", "block:missing"), (1, "hourly_count", "block:type"), (2, "direction", "warning:extra"),
               (3, "hourly_count", "block:meaning"), (4, "site", "ok:absent"), (5, "site", "warning:type")]


@query("schema_audit", with_views("counts") + f""",
c AS (SELECT counter_id, count(*) AS n_rows, CAST(sum(hourly_count) % {SHAPES} AS INT) AS shape FROM counts GROUP BY 1),
fields(field) AS (VALUES ('counter_id'), ('hourly_count'), ('site'), ('ts_utc'), ('direction')),
cases(shape, field, outcome) AS (VALUES {", ".join(f"({s}, '{f}', '{o}')" for s, f, o in AUDIT_CASES)})
SELECT counter_id, n_rows, field, coalesce(outcome, 'ok') AS outcome,
  CASE shape WHEN 2 THEN 'warn' WHEN 4 THEN 'accept' WHEN 5 THEN 'warn' ELSE 'block' END AS decision
FROM c CROSS JOIN fields LEFT JOIN cases USING (shape, field) WHERE field <> 'direction' OR outcome IS NOT NULL""", FAM)
def schema_audit(spark, sf_dir):
    """The footers of one part file per counter against version 2 of the
    contract; a counter's total decides how its file departs from it (field
    missing, of another type, extra, of another meaning; optional field absent or
    of another type)."""
    c = counts(spark, sf_dir).select("counter_id", "ts_utc", "hourly_count", "site")
    shape = c.groupBy("counter_id").agg((F.sum("hourly_count") % SHAPES).alias("shape"))
    c = materialize(c.join(shape, "counter_id"))
    path = _folder(spark, "parts")
    told = {"counter_id": "stable counter identity", "hourly_count": "events of one hour", "ts_utc": "start of the hour, UTC"}
    for s in range(SHAPES):
        own = c.filter(F.col("shape") == s).drop("shape")
        comments = told
        if s == 0:
            own = own.drop("hourly_count")
        elif s == 1:
            own = own.withColumn("hourly_count", F.col("hourly_count").cast("string"))
        elif s == 2:
            own = own.withColumn("direction", F.lit("both"))
        elif s == 3:
            comments = told | {"hourly_count": "events since midnight"}
        elif s == 4:
            own = own.drop("site")
        else:
            own = own.withColumn("site", F.length("site"))
        own = own.withColumn("counter", F.col("counter_id")).repartition("counter")
        _commented(own, **{k: v for k, v in comments.items() if k in own.columns}).write.partitionBy("counter").parquet(f"{path}/shape={s}")
    agreed = f"{path}-contract"
    spark.createDataFrame(COUNTS_CONTRACT, FT.CONTRACT).write.parquet(agreed)
    audited = materialize(FT.audit(FT.read_footers(FT.part_files(spark, path)), spark.read.parquet(agreed), 2))
    return audited.join(FT.decisions(audited).select("path", "decision"), "path").select(
        F.regexp_extract("path", "counter=([^/]+)/", 1).alias("counter_id"), "n_rows", "field", "outcome", "decision")


LINE_SQL = "counter_id || ',' || strftime(ts_utc, '%Y-%m-%dT%H:%M:%S') || ',' || CAST(hourly_count AS VARCHAR)"


@query("payload_hashes", with_views("counts") + f""",
f AS (SELECT counter_id, CAST(sum(hourly_count) % 5 AS INT) AS kind, sha256(string_agg({LINE_SQL} || chr(10), '' ORDER BY ts_utc)) AS sha256,
        CAST(sum(length({LINE_SQL}) + 1) AS BIGINT) AS n_bytes FROM counts GROUP BY 1)
SELECT counter_id, CASE WHEN kind NOT IN (1, 2) THEN sha256 END AS sha256, CASE WHEN kind NOT IN (1, 2) THEN CAST(n_bytes AS DOUBLE) END AS n_bytes,
  CASE kind WHEN 1 THEN 'skipped' WHEN 2 THEN 'missing_payload' WHEN 3 THEN 'checksum_mismatch' ELSE 'ok' END AS outcome FROM f""", FAM)
def payload_hashes(spark, sf_dir):
    """A53 + A60: a text payload per counter, hashed as stored and compared with
    its manifest: no local path, no file, another checksum, equal, none declared."""
    c = counts(spark, sf_dir).withColumn("line", F.concat_ws(
        ",", "counter_id", F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss"), F.col("hourly_count").cast("string")))
    c = materialize(c)
    path = _folder(spark, "payloads")
    kind = (F.sum("hourly_count") % 5).alias("kind")
    kinds = materialize(c.groupBy("counter_id").agg(kind))
    (c.join(kinds.filter("kind <> 2"), "counter_id").withColumn("counter", F.col("counter_id")).repartition("counter")
     .sortWithinPartitions("counter", "ts_utc").select("counter", "line").write.partitionBy("counter").text(path))
    found = materialize(FH.file_hashes(spark, path, ".txt").withColumn("local_path", F.regexp_extract("path", "(counter=[^/]+)/", 1)))
    declared = F.when(F.col("kind") == 3, F.sha2(F.lit("another payload"), 256)).when(F.col("kind") == 0, F.col("known"))
    manifests = kinds.join(found.select(F.substring("local_path", 9, 1000).alias("counter_id"), F.col("sha256").alias("known")), "counter_id", "left").select(
        "counter_id", F.when(F.col("kind") != 1, F.concat(F.lit("counter="), F.col("counter_id"))).alias("local_path"), declared.alias("declared"))
    return manifests.join(found, "local_path", "left").select(
        "counter_id", "sha256", F.col("length").cast("double").alias("n_bytes"),
        FH.verification(F.col("local_path"), F.col("declared"), F.col("sha256")).alias("outcome"))


@query("column_times", f"""
WITH e AS (SELECT {COUNTER_SQL} AS counter_id, date_trunc('second', ts) AS ts,
             user_id % 2 = 0 AND event_type IN ('view', 'click') AND value > 90 AND event_id % 7 = 0 AS spaced,
             event_type = 'click' AND user_id % 2 = 0 AND value > 90 AND event_id % 21 = 0 AS junk FROM events)
SELECT counter_id, bool_or(spaced OR junk) AS lenient, count(*) AS n_rows, count(*) FILTER (NOT junk) AS n_parsed,
  min(CASE WHEN NOT junk THEN ts END) AS first_ts, max(CASE WHEN NOT junk THEN ts END) AS last_ts FROM e GROUP BY 1""", FAM)
def column_times(spark, sf_dir):
    """Texts of times decided per counter's column: strict if all are, else
    the whole column leniently (some counters have texts with a space instead of
    the T, one has texts that no rule reads)."""
    ev = table(spark, sf_dir, "events")
    odd = (F.col("user_id") % 2 == 0) & (F.col("value") > 90)
    spaced = odd & F.col("event_type").isin("view", "click") & (F.col("event_id") % 7 == 0)
    junk = odd & (F.col("event_type") == "click") & (F.col("event_id") % 21 == 0)
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    text = (F.when(junk, "soon").when(spaced, F.concat(day, F.lit(" "), clock, F.lit("+00:00")))
            .otherwise(F.concat(day, F.lit("T"), clock, F.lit("+0000"))))
    texts = ev.select(F.concat_ws("_", "event_type", orientation_of()).alias("counter_id"), text.alias("text"))
    got = parse_utc_whole(texts, "text", ["counter_id"], "ts_utc", "lenient")
    return got.groupBy("counter_id").agg(F.bool_or("lenient").alias("lenient"), F.count(F.lit(1)).alias("n_rows"), F.count("ts_utc").alias("n_parsed"),
                                         F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))


@query("routed_tables", """
WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 'count_not_numeric' WHEN value < 5 THEN 'value_low' ELSE '' END AS bad,
             CASE WHEN user_id % 50 > 40 THEN 'count_high' ELSE '' END AS odd FROM events),
r AS (SELECT *, CASE WHEN bad <> '' THEN 'quarantined' WHEN odd <> '' THEN 'warned' ELSE 'accepted' END AS route FROM e)
SELECT batch, route, bad AS quarantine_reasons, odd AS warning_reasons, count(*) AS n_rows,
  any_value(CASE route WHEN 'accepted' THEN (SELECT count(*) FROM r WHERE route = 'accepted') WHEN 'warned' THEN (SELECT count(*) FROM r WHERE route = 'warned')
    ELSE (SELECT count(*) FROM r WHERE route = 'quarantined') END) AS n_evidence
FROM r, (VALUES ('first'), ('second')) AS b(batch) GROUP BY 1, 2, 3, 4""", FAM)
def routed_tables(spark, sf_dir):
    """C3 + C22: accepted, warned and quarantined rows written to their tables by
    one job with their evidence; two batches, the second one written twice; read
    back beside the counts that were observed while writing."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type", (F.col("user_id") % 50).alias("count"))
    routed = V.route(ev, [("count_not_numeric", F.col("event_type") == "error"), ("value_low", (F.col("event_type") != "error") & (F.col("value") < 5))],
                     [("count_high", F.col("count") > 40)])
    path = _folder(spark, "routed")
    for batch in ("first", "second", "second"):
        SK.write_routed(routed, path, batch)
    rows, evidence = SK.read_routed(spark, path)
    seen = evidence.unpivot("batch", list(SK.ROUTES), "route", "n_evidence")
    got = rows.groupBy("batch", "route", F.array_join("quarantine_reasons", ",").alias("quarantine_reasons"),
                       F.array_join("warning_reasons", ",").alias("warning_reasons")).agg(F.count(F.lit(1)).alias("n_rows"))
    return got.join(seen, ["batch", "route"])


def boundary_texts(spark, sf_dir):
    """A boundary per supplier as published text: pentagons of several sizes, some closed, some faulty."""
    k = F.col("s_suppkey")
    cx, cy, r = k * 37 % 250, k * 53 % 120, k % 23 + 5

    def at(x, y):
        return F.concat(x.cast("string"), F.lit(" "), y.cast("string"))

    points = [at(cx - r, cy), at(cx, cy - r), at(cx + r, cy), at(cx + F.floor(r / 2), cy + r), at(cx - F.floor(r / 3), cy + F.floor(r / 2))]
    ring = F.when(k % 2 == 1, F.concat_ws(", ", *points, points[0])).otherwise(F.concat_ws(", ", *points))
    ring = (F.when(k % 11 == 0, F.concat_ws(", ", *points[:2])).when(k % 13 == 0, F.concat_ws(", ", *points[:3], F.lit("x 1")))
            .when(k % 17 == 0, F.concat_ws(", ", at(cx, cy), at(cx + 1, cy), at(cx + 2, cy))).otherwise(ring))
    text = F.when(k % 19 == 0, F.concat(F.lit("POINT("), points[0], F.lit(")"))).otherwise(F.concat(F.lit("POLYGON(("), ring, F.lit("))")))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("area-"), k.cast("string")).alias("label"), text.alias("geometry"))


BOUNDARY_SQL = """
WITH s AS (SELECT 'area-' || CAST(s_suppkey AS VARCHAR) AS label, s_suppkey AS k, s_suppkey * 37 % 250 AS cx, s_suppkey * 53 % 120 AS cy,
             s_suppkey % 23 + 5 AS r FROM supplier),
faulty AS (SELECT label, CASE WHEN k % 19 = 0 THEN 'empty' WHEN k % 11 = 0 THEN 'too_few_points' WHEN k % 13 = 0 THEN 'missing_coordinate'
             WHEN k % 17 = 0 THEN 'no_area' END AS fault FROM s),
rings AS (SELECT label, [CAST(cx - r AS DOUBLE), cx, cx + r, cx + r // 2, cx - r // 3] AS xs, [CAST(cy AS DOUBLE), cy - r, cy, cy + r, cy + r // 2] AS ys
          FROM s JOIN faulty USING (label) WHERE fault IS NULL),
edges AS (SELECT label, xs[i] AS ax, ys[i] AS ay, xs[i % 5 + 1] AS bx, ys[i % 5 + 1] AS b_y FROM (SELECT *, unnest(range(1, 6)) AS i FROM rings))"""


@query("boundary_hits", BOUNDARY_SQL + """,
pts AS (SELECT event_id, floor(value) % 250 + 0.5::DOUBLE AS x, user_id % 120 + 0.5::DOUBLE AS y FROM events),
spots AS (SELECT DISTINCT x, y FROM pts),
crossed AS (
  SELECT x, y, label FROM spots JOIN edges ON (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
hits AS (SELECT x, y, count(*) AS n_hits, min(label) AS hit FROM crossed GROUP BY 1, 2)
SELECT event_id, coalesce(n_hits, 0) AS n_hits, hit, CASE WHEN n_hits > 1 THEN 'several_boundaries' END AS warning
FROM pts LEFT JOIN hits USING (x, y)""", FAM)
def boundary_hits(spark, sf_dir):
    """Every point with the boundaries that hold it, by the grid index over
    boundaries read from their published text; several hits warn."""
    path = _folder(spark, "boundaries")
    boundary_texts(spark, sf_dir).write.option("header", True).csv(path)
    read = spark.read.option("header", True).schema("label string, geometry string").csv(path)
    read = read.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a ring costs far more than its text
    points = table(spark, sf_dir, "events").select("event_id", (F.floor("value") % 250 + 0.5).cast("double").alias("x"),
                                                   (F.col("user_id") % 120 + 0.5).cast("double").alias("y"))
    found, _ = BD.join_boundaries(points, "event_id", "x", "y", read.withColumn("ring", BD.parse_ring(F.col("geometry"))))
    return found.select("event_id", "n_hits", "hit", "warning")


@query("boundary_quarantine", BOUNDARY_SQL + "\nSELECT label, fault FROM faulty WHERE fault IS NOT NULL", FAM)
def boundary_quarantine(spark, sf_dir):
    """Boundaries that are no valid ring, with the reason."""
    rings = boundary_texts(spark, sf_dir).withColumn("ring", BD.parse_ring(F.col("geometry")))
    return BD.checked(rings, "label", "ring").filter("fault IS NOT NULL").select("label", "fault")


GATED = ["counter_id", "ts_utc", "hourly_count"]


@query("dataset_gates", with_views("counts") + """,
k AS (SELECT counter_id, count(*) AS n, CAST(sum(hourly_count) % 4 AS INT) AS kind FROM counts GROUP BY 1),
n AS (SELECT t.kind, count(counter_id) AS n_counters, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows
      FROM (VALUES (0), (1), (2), (3)) AS t(kind) LEFT JOIN k USING (kind) GROUP BY 1)
SELECT kind, CASE kind WHEN 0 THEN 0 ELSE n_counters END AS n_counters, CASE kind WHEN 0 THEN 0 ELSE n_rows END AS n_rows,
  CASE kind WHEN 1 THEN 'missing required columns: [''hourly_count'']' WHEN 2 THEN 'missing required columns: [''hourly_count'', ''ts_utc'']'
    ELSE CASE WHEN kind = 0 OR n_rows = 0 THEN 'dataset is empty' ELSE 'ok' END END AS outcome FROM n""", FAM)
def dataset_gates(spark, sf_dir):
    """A11 + A14: the gates in front of four stored datasets: an empty one, two
    short of columns, a whole one; counters are dealt to them by their total."""
    c = counts(spark, sf_dir).select(*GATED)
    kind = c.groupBy("counter_id").agg((F.sum("hourly_count") % 4).alias("kind"))
    c = materialize(c.join(kind, "counter_id"))
    path, out = _folder(spark, "gated"), None
    for i, short in enumerate(([], ["hourly_count"], ["hourly_count", "ts_utc"], [])):
        own = c.filter(F.col("kind") == i).drop("kind", *short)
        (own.limit(0) if i == 0 else own).write.parquet(f"{path}/{i}")
        got = spark.read.parquet(f"{path}/{i}")
        outcome = "ok"
        try:
            V.require_columns(got, GATED)
            V.require_rows(got)
        except ValueError as failed:
            outcome = str(failed)
        row = got.agg(F.count_distinct("counter_id").alias("n_counters"), F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(i).alias("kind"), "n_counters", "n_rows", F.lit(outcome).alias("outcome"))
        out = row if out is None else out.unionByName(row)
    return out


@query("model_columns", """
SELECT counter_id, kind, string_agg(name, ',' ORDER BY name) AS names, CAST(sum(n) AS BIGINT) AS n_values FROM (
  SELECT concat(event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END) AS counter_id, u.kind, u.name,
         count(CASE u.name WHEN 'site' THEN event_type WHEN 'hourly_count' THEN CAST(user_id AS VARCHAR) WHEN 'temperature' THEN CAST(value AS VARCHAR) ELSE 'x' END) AS n
  FROM events, (VALUES ('numeric', 'hourly_count'), ('numeric', 'temperature'), ('numeric', 'ts_hour'), ('text', 'site'), ('neither', 'is_open'), ('neither', 'ts_local'))
    AS u(kind, name) GROUP BY 1, 2, 3) GROUP BY 1, 2""", FAM)
def model_columns(spark, sf_dir):
    """A16 + A17 + A18: listed columns and the source timestamp dropped, the rest
    split into numeric, text and neither (booleans and times, which no model
    sees); values counted per counter."""
    from hourcast.functions.calendar import to_local
    from hourcast.operators.model import typed_columns
    from hourcast.sources.files import drop_listed
    ev = table(spark, sf_dir, "events")
    raw = ev.select(F.concat_ws("_", "event_type", orientation_of()).alias("counter_id"), F.col("event_type").alias("site"),
                    F.col("user_id").alias("hourly_count"), F.col("value").alias("temperature"), F.lit(48.8).alias("latitude"),
                    F.lit(2.3).alias("longitude"), F.lit("x").alias("note"), F.lit(True).alias("is_open"), F.col("ts").alias("ts_utc"))
    built = raw.withColumns({"ts_local": to_local("ts_utc"), "ts_hour": F.hour("ts_utc")}).drop("ts_utc")  # A17
    kept = drop_listed(built, ["note", "absent"])
    numeric, text = typed_columns(kept, ["counter_id"])
    kinds = {**dict.fromkeys(numeric, "numeric"), **dict.fromkeys(text, "text")}
    names = [c for c in kept.columns if c != "counter_id"]
    counted = kept.groupBy("counter_id").agg(*[F.count(c).alias(c) for c in names]).unpivot("counter_id", names, "name", "n")
    kind = F.element_at(F.create_map(*[F.lit(x) for c in names for x in (c, kinds.get(c, "neither"))]), F.col("name"))
    return counted.groupBy("counter_id", kind.alias("kind")).agg(
        F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.sum("n").alias("n_values"))


@query("identity_chains", f"""
WITH e AS (SELECT DISTINCT user_id % 40 AS u, {COUNTER_SQL} AS folder, date_trunc('hour', ts) AS ts FROM events),
c AS (SELECT *, CASE WHEN u % 4 = 0 THEN 'run-' || CAST(u AS VARCHAR) WHEN u % 4 = 1 THEN '  ' END AS run_given,
        CASE WHEN u % 3 = 0 THEN 'env-run' END AS run_env, CASE WHEN u % 5 = 0 THEN 'flow-' || CAST(u AS VARCHAR) END AS flow_env,
        CASE WHEN u % 6 = 0 THEN 'given_N-S' WHEN u % 6 = 1 THEN '' END AS counter_given, CASE WHEN u % 7 = 0 THEN 'env_S-N' END AS counter_env,
        CASE WHEN u % 8 = 0 THEN 'models' END AS producer_given, CASE WHEN u % 9 = 0 THEN 'features' END AS producer_env FROM e)
SELECT run_id, counter_id, producer, count(*) AS n_rows FROM (
  SELECT coalesce(nullif(trim(run_given), ''), run_env, flow_env, strftime(ts, '%Y%m%dT%H%M%SZ')) AS run_id,
         coalesce(nullif(trim(counter_given), ''), counter_env, folder) AS counter_id, coalesce(producer_given, producer_env, 'unknown') AS producer FROM c)
GROUP BY 1, 2, 3""", FAM)
def identity_chains(spark, sf_dir):
    """Run id (given, two settings, UTC time text), counter id (given,
    setting, folder) and producer (given, setting, default); blank is absent."""
    from hourcast.functions.labels import first_present
    u = F.col("u")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("u"), F.concat_ws("_", "event_type", orientation_of()).alias("folder"),
                                              F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    text = u.cast("string")
    c = e.select("folder", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("time_text"),
                 F.when(u % 4 == 0, F.concat(F.lit("run-"), text)).when(u % 4 == 1, "  ").alias("run_given"), F.when(u % 3 == 0, "env-run").alias("run_env"),
                 F.when(u % 5 == 0, F.concat(F.lit("flow-"), text)).alias("flow_env"), F.when(u % 6 == 0, "given_N-S").when(u % 6 == 1, "").alias("counter_given"),
                 F.when(u % 7 == 0, "env_S-N").alias("counter_env"), F.when(u % 8 == 0, "models").alias("producer_given"),
                 F.when(u % 9 == 0, "features").alias("producer_env"))
    return c.groupBy(first_present("run_given", "run_env", "flow_env", "time_text").alias("run_id"),
                     first_present("counter_given", "counter_env", "folder").alias("counter_id"),
                     first_present("producer_given", "producer_env", default="unknown").alias("producer")).agg(F.count(F.lit(1)).alias("n_rows"))
