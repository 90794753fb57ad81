"""Canonical history and coverage queries (contract layer C1, C22–C38)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.functions.numeric import round_scaled
from hourcast.functions.calendar import to_local
from hourcast.functions.timecols import day_floor
from hourcast.operators import canonical as C
from hourcast.operators import coverage as CV
from hourcast.sources.tables import counts, materialize, snapshots, table, with_views

FAM = "history"

PREC_SQL = "CASE WHEN snapshot_no >= 3 THEN 2 ELSE 1 END"


def _merge_sql(src, name="m"):
    return f""",
{name}_r AS (SELECT *, {PREC_SQL} AS p, max({PREC_SQL}) OVER (PARTITION BY counter_id, ts_utc) AS top FROM {src}),
{name} AS (SELECT counter_id, ts_utc,
    CASE WHEN count(*) = 1 THEN arg_max(hourly_count, snapshot_no) END AS hourly_count,
    CASE WHEN count(*) = 1 THEN max(snapshot_no) END AS snapshot_no, count(*) > 1 AS tie
  FROM {name}_r WHERE p = top GROUP BY counter_id, ts_utc)"""


def _merged(spark, sf_dir, max_snapshot=None, ts_range=None, counters=None):
    s = snapshots(spark, sf_dir, ts_range, counters)
    if max_snapshot is not None:
        s = C.as_of(s, max_snapshot)
    return C.merge(s, C.precedence_default(F.col("snapshot_no")))


MERGED_OUT_SQL = """SELECT counter_id, ts_utc, CAST(hourly_count AS DOUBLE) AS hourly_count,
  CAST(snapshot_no AS DOUBLE) AS snapshot_no, tie FROM m"""


def _merged_out(df):
    """Merged rows as output: value and lineage are withheld (null) on ties, so
    they are published as doubles (a nullable integer column is represented
    differently by different engines' dataframe libraries)."""
    return df.select("counter_id", "ts_utc", F.col("hourly_count").cast("double").alias("hourly_count"),
                     F.col("snapshot_no").cast("double").alias("snapshot_no"), "tie")


@query("canonical_merge", with_views("snapshots") + _merge_sql("snapshots") + "\n" + MERGED_OUT_SQL, FAM)
def canonical_merge(spark, sf_dir):
    """Current revision per (counter, hour) by precedence; ties block."""
    return _merged_out(_merged(spark, sf_dir))


@query("time_travel", with_views("snapshots") + """,
s2 AS (SELECT * FROM snapshots WHERE snapshot_no <= 2)""" + _merge_sql("s2") + "\n" + MERGED_OUT_SQL, FAM)
def time_travel(spark, sf_dir):
    """The canonical view as of snapshot 2 (superseded rows stay readable)."""
    return _merged_out(_merged(spark, sf_dir, max_snapshot=2))


@query("revision_ledger", with_views("snapshots") + """
SELECT counter_id, ts_utc, snapshot_no,
  CAST(dense_rank() OVER (PARTITION BY counter_id, ts_utc ORDER BY snapshot_no) AS INTEGER) AS revision_no
FROM snapshots""", FAM)
def revision_ledger(spark, sf_dir):
    """Append-only revision numbering per key."""
    w = Window.partitionBy("counter_id", "ts_utc").orderBy("snapshot_no")
    return (snapshots(spark, sf_dir)
            .select("counter_id", "ts_utc", "snapshot_no", F.dense_rank().over(w).alias("revision_no")))


REPLAY_A, REPLAY_B = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


@query("correction_replay", with_views("snapshots") + f""",
s2 AS (SELECT * FROM snapshots WHERE snapshot_no <= 2 AND ts_utc >= TIMESTAMP '{REPLAY_A}' AND ts_utc < TIMESTAMP '{REPLAY_B}'),
s3 AS (SELECT * FROM snapshots WHERE ts_utc >= TIMESTAMP '{REPLAY_A}' AND ts_utc < TIMESTAMP '{REPLAY_B}')""" + _merge_sql("s2", "a") + _merge_sql("s3", "b") + """
SELECT change, count(*) AS n_keys FROM (
  SELECT CASE WHEN a.hourly_count IS NULL AND b.hourly_count IS NOT NULL THEN 'added'
              WHEN b.hourly_count IS NULL AND a.hourly_count IS NOT NULL THEN 'removed'
              WHEN a.hourly_count IS NULL AND b.hourly_count IS NULL THEN 'unchanged'
              WHEN a.hourly_count <> b.hourly_count THEN 'changed' ELSE 'unchanged' END AS change
  FROM a FULL OUTER JOIN b ON a.counter_id = b.counter_id AND a.ts_utc = b.ts_utc)
GROUP BY 1""", FAM)
def correction_replay(spark, sf_dir):
    """Recompute the selection for an interval after snapshot 3 and
    report the change set against the selection as of snapshot 2."""
    # the hour-aligned interval is pushed to the events scan
    s = snapshots(spark, sf_dir, (REPLAY_A, REPLAY_B))
    prec = C.precedence_default(F.col("snapshot_no"))
    before = C.merge(C.as_of(s, 2), prec)
    after = C.merge(s, prec)
    return C.change_set(before, after).groupBy("change").agg(F.count(F.lit(1)).alias("n_keys"))


EXTRACT_A, EXTRACT_B = "2024-01-05 00:00:00", "2024-01-12 00:00:00"
EXTRACT_COUNTERS = ["click_N-S", "view_S-N", "error_N-S"]
DIGEST_SQL = ("CAST(('0x' || substr(md5(concat_ws('|', coalesce(counter_id, '\\N'), coalesce(CAST(ts_utc AS VARCHAR), '\\N'), "
              "coalesce(CAST(hourly_count AS VARCHAR), '\\N'))), 1, 8)) AS BIGINT)")


@query("range_extract", with_views("snapshots") + _merge_sql("snapshots") + f"""
SELECT counter_id, ts_utc, CAST(hourly_count AS DOUBLE) AS hourly_count, CAST(snapshot_no AS DOUBLE) AS snapshot_no, tie
FROM m WHERE ts_utc >= TIMESTAMP '{EXTRACT_A}' AND ts_utc < TIMESTAMP '{EXTRACT_B}'
  AND counter_id IN ({", ".join(f"'{c}'" for c in EXTRACT_COUNTERS)})""", FAM)
def range_extract(spark, sf_dir):
    """Half-open time range for a counter list, with row lineage."""
    lo = F.lit(EXTRACT_A).cast("timestamp_ntz")
    hi = F.lit(EXTRACT_B).cast("timestamp_ntz")
    m = _merged(spark, sf_dir, ts_range=(EXTRACT_A, EXTRACT_B), counters=EXTRACT_COUNTERS)  # pushed to the scan
    return _merged_out(C.extract(m, lo, hi, EXTRACT_COUNTERS)).orderBy("counter_id", "ts_utc")


@query("extraction_manifest", with_views("snapshots") + _merge_sql("snapshots") + f"""
SELECT 'range=[{EXTRACT_A},{EXTRACT_B});counters=' || '{",".join(EXTRACT_COUNTERS)}' AS selector,
  count(*) AS n_rows, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts, CAST(sum({DIGEST_SQL}) AS VARCHAR) AS checksum
FROM m WHERE ts_utc >= TIMESTAMP '{EXTRACT_A}' AND ts_utc < TIMESTAMP '{EXTRACT_B}'
  AND counter_id IN ({", ".join(f"'{c}'" for c in EXTRACT_COUNTERS)})""", FAM)
def extraction_manifest(spark, sf_dir):
    """Selector, row count, coverage and order-independent checksum."""
    lo = F.lit(EXTRACT_A).cast("timestamp_ntz")
    hi = F.lit(EXTRACT_B).cast("timestamp_ntz")
    x = C.extract(_merged(spark, sf_dir, ts_range=(EXTRACT_A, EXTRACT_B), counters=EXTRACT_COUNTERS),
                  lo, hi, EXTRACT_COUNTERS)
    sel = f"range=[{EXTRACT_A},{EXTRACT_B});counters={','.join(EXTRACT_COUNTERS)}"
    ev = C.evidence(x.withColumn("selector", F.lit(sel)), ["selector"], "ts_utc",
                    C.row_digest("counter_id", "ts_utc", "hourly_count"))
    return ev


@query("snapshot_evidence", with_views("snapshots") + f"""
SELECT snapshot_no, count(*) AS n_rows, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts,
  CAST(sum({DIGEST_SQL}) AS VARCHAR) AS checksum,
  sha256('counter_id:string,ts_utc:timestamp_ntz,snapshot_no:int,hourly_count:bigint') AS schema_fingerprint
FROM snapshots GROUP BY snapshot_no""", FAM)
def snapshot_evidence(spark, sf_dir):
    """Per snapshot row count, observed coverage, payload checksum and schema fingerprint."""
    s = snapshots(spark, sf_dir)
    found = C.evidence(s, ["snapshot_no"], "ts_utc", C.row_digest("counter_id", "ts_utc", "hourly_count"))
    return found.withColumn("schema_fingerprint", F.lit(C.schema_fingerprint(s)))


@query("idempotent_append", with_views("snapshots") + """,
existing AS (SELECT DISTINCT counter_id, snapshot_no FROM snapshots WHERE snapshot_no IN (1, 2)),
incoming AS (SELECT counter_id, snapshot_no, count(*) AS n_rows, sum(hourly_count) AS total
             FROM snapshots WHERE snapshot_no IN (2, 3) GROUP BY 1, 2)
SELECT i.counter_id, i.snapshot_no, i.n_rows, CAST(i.total AS BIGINT) AS total FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.counter_id = i.counter_id AND e.snapshot_no = i.snapshot_no)""", FAM)
def idempotent_append(spark, sf_dir):
    """C22 + C23: a retried batch (snapshots 2 and 3) appends only the
    (source, snapshot) keys the ledger does not hold yet."""
    s = snapshots(spark, sf_dir)
    existing = s.filter(F.col("snapshot_no").isin(1, 2)).select("counter_id", "snapshot_no").distinct()
    incoming = (s.filter(F.col("snapshot_no").isin(2, 3)).groupBy("counter_id", "snapshot_no")
                .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("hourly_count").cast("bigint").alias("total")))
    return incoming.join(existing, ["counter_id", "snapshot_no"], "left_anti")


SNAPSHOT_ID = ["counter_id", "snapshot_no", "version", "first_ts", "last_ts"]


@query("snapshot_ledger", with_views("snapshots") + f""",
v AS (SELECT counter_id, ts_utc, snapshot_no, hourly_count, 'v1' AS version FROM snapshots),
old AS (SELECT counter_id, snapshot_no, version, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts, count(*) AS n_rows, CAST(sum({DIGEST_SQL}) AS VARCHAR) AS checksum
        FROM v WHERE snapshot_no <= 2 GROUP BY 1, 2, 3),
sent AS (SELECT counter_id, ts_utc, snapshot_no, version,
           hourly_count + CASE WHEN snapshot_no = 2 AND ends_with(counter_id, 'S-N') THEN 1 ELSE 0 END AS hourly_count FROM v WHERE snapshot_no >= 2),
new AS (SELECT counter_id, snapshot_no, version, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts, count(*) AS n_rows, CAST(sum({DIGEST_SQL}) AS VARCHAR) AS checksum
        FROM sent GROUP BY 1, 2, 3)
SELECT n.counter_id, n.snapshot_no, n.version, n.first_ts, n.last_ts, n.n_rows, n.checksum,
  CASE WHEN o.checksum IS NULL THEN 'appended' WHEN o.checksum = n.checksum THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM new n LEFT JOIN old o USING (counter_id, snapshot_no, version, first_ts, last_ts)""", FAM)
def snapshot_ledger(spark, sf_dir):
    """C22 + C23: ledger rows of snapshots sent again: retries add nothing, a
    changed payload under the same identity conflicts, new ones are appended."""
    s = snapshots(spark, sf_dir).withColumn("version", F.lit("v1"))
    keys = ["counter_id", "snapshot_no", "version"]
    digest = C.row_digest("counter_id", "ts_utc", "hourly_count")
    old = C.evidence(s.filter("snapshot_no <= 2"), keys, "ts_utc", digest)
    bump = F.when((F.col("snapshot_no") == 2) & F.col("counter_id").endswith("S-N"), 1).otherwise(0)
    new = C.evidence(s.filter("snapshot_no >= 2").withColumn("hourly_count", F.col("hourly_count") + bump), keys, "ts_utc", digest)
    return C.append_outcomes(old, new, SNAPSHOT_ID, "checksum").select(*SNAPSHOT_ID, "n_rows", "checksum", "outcome")


PARIS_SQL = "timezone('Europe/Paris', timezone('UTC', {c}))"
UTC_OF_LOCAL_SQL = "timezone('UTC', timezone('Europe/Paris', {c}))"


def _slots_sql():
    return with_views("counts") + f""",
act AS (SELECT counter_id, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts FROM counts GROUP BY 1),
b AS (SELECT counter_id,
        {UTC_OF_LOCAL_SQL.format(c="date_trunc('day', " + PARIS_SQL.format(c='first_ts') + ")")} AS start_utc,
        {UTC_OF_LOCAL_SQL.format(c="date_trunc('day', " + PARIS_SQL.format(c='last_ts') + ") + INTERVAL 1 DAY")} - INTERVAL 1 HOUR AS stop_utc
      FROM act),
slots AS (SELECT counter_id, unnest(generate_series(start_utc, stop_utc, INTERVAL 1 HOUR)) AS slot_utc FROM b)
"""


def _slots(spark, sf_dir):
    c = counts(spark, sf_dir)
    act = c.groupBy("counter_id").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))
    return CV.expected_slots(act, "first_ts", "last_ts").select("counter_id", "slot_utc")


@query("expected_slots", _slots_sql() + f"""
SELECT counter_id, CAST(date_trunc('day', {PARIS_SQL.format(c='slot_utc')}) AS TIMESTAMP) AS local_day, count(*) AS n_slots
FROM slots GROUP BY 1, 2""", FAM)
def expected_slots(spark, sf_dir):
    """Expected hourly slots per active counter and Paris civil day."""
    s = _slots(spark, sf_dir)
    return (s.groupBy("counter_id", day_floor(to_local("slot_utc")).alias("local_day"))
            .agg(F.count(F.lit(1)).alias("n_slots")))


@query("dst_day_slots", f"""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS local_day FROM orders),
s AS (SELECT local_day, CAST((epoch({UTC_OF_LOCAL_SQL.format(c="CAST(local_day AS TIMESTAMP) + INTERVAL 1 DAY")})
        - epoch({UTC_OF_LOCAL_SQL.format(c="CAST(local_day AS TIMESTAMP)")})) / 3600 AS INTEGER) AS n_slots FROM d)
SELECT n_slots, count(*) AS n_days, CAST(min(local_day) AS TIMESTAMP) AS first_day,
       CAST(max(local_day) AS TIMESTAMP) AS last_day FROM s GROUP BY 1""", FAM)
def dst_day_slots(spark, sf_dir):
    """C28 on six years of civil days: 23 slots on spring-forward days,
    25 on fall-back days, 24 otherwise."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("local_day")).distinct()
    s = d.withColumn("n_slots", CV.slots_in_local_day(F.col("local_day").cast("timestamp_ntz")))
    return s.groupBy("n_slots").agg(F.count(F.lit(1)).alias("n_days"),
                                    F.min("local_day").cast("timestamp_ntz").alias("first_day"),
                                    F.max("local_day").cast("timestamp_ntz").alias("last_day"))


def _coverage(spark, sf_dir):
    s = materialize(snapshots(spark, sf_dir))  # read for the active range and the merge
    act = s.groupBy("counter_id").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))
    slots = CV.expected_slots(act, "first_ts", "last_ts").select("counter_id", F.col("slot_utc").alias("ts_utc"))
    cur = C.merge(s, C.precedence_default(F.col("snapshot_no"))).select("counter_id", "ts_utc", "tie")
    j = slots.join(cur, ["counter_id", "ts_utc"], "left")
    return j.select("counter_id", day_floor(to_local("ts_utc")).alias("local_day"),
                    F.when(F.col("tie").isNull(), "unavailable").when(F.col("tie"), "quarantined")
                    .otherwise("valid").alias("state"))


@query("coverage_rollup", with_views("counts", "snapshots") + _merge_sql("snapshots") + f""",
act AS (SELECT counter_id, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts FROM counts GROUP BY 1),
b AS (SELECT counter_id,
        {UTC_OF_LOCAL_SQL.format(c="date_trunc('day', " + PARIS_SQL.format(c='first_ts') + ")")} AS start_utc,
        {UTC_OF_LOCAL_SQL.format(c="date_trunc('day', " + PARIS_SQL.format(c='last_ts') + ") + INTERVAL 1 DAY")} - INTERVAL 1 HOUR AS stop_utc
      FROM act),
slots AS (SELECT counter_id, unnest(generate_series(start_utc, stop_utc, INTERVAL 1 HOUR)) AS ts_utc FROM b),
st AS (SELECT s.counter_id, CAST(date_trunc('day', {PARIS_SQL.format(c='s.ts_utc')}) AS TIMESTAMP) AS local_day,
         CASE WHEN m.tie IS NULL THEN 'unavailable' WHEN m.tie THEN 'quarantined' ELSE 'valid' END AS state
       FROM slots s LEFT JOIN m ON s.counter_id = m.counter_id AND s.ts_utc = m.ts_utc)
SELECT counter_id, local_day, count(*) AS expected,
  count(*) FILTER (WHERE state = 'valid') AS valid,
  count(*) FILTER (WHERE state = 'quarantined') AS quarantined,
  count(*) FILTER (WHERE state = 'unavailable') AS unavailable,
  round(count(*) FILTER (WHERE state = 'valid') / count(*), 6) AS coverage_ratio
FROM st GROUP BY ROLLUP (counter_id, local_day)""", FAM)
def coverage_rollup(spark, sf_dir):
    """Expected / valid / quarantined / unavailable slots with a
    (counter, day) rollup."""
    cv = _coverage(spark, sf_dir)
    n = F.count(F.lit(1))
    valid = F.count(F.when(F.col("state") == "valid", 1))
    return cv.rollup("counter_id", "local_day").agg(
        n.alias("expected"), valid.alias("valid"),
        F.count(F.when(F.col("state") == "quarantined", 1)).alias("quarantined"),
        F.count(F.when(F.col("state") == "unavailable", 1)).alias("unavailable"),
        round_scaled(valid / n, 6).alias("coverage_ratio"))


@query("gap_intervals", with_views("counts") + """,
g AS (SELECT counter_id, ts_utc, lag(ts_utc) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS prev FROM counts)
SELECT counter_id, prev + INTERVAL 1 HOUR AS gap_start, ts_utc AS gap_end,
  CAST((epoch(ts_utc) - epoch(prev)) / 3600 - 1 AS BIGINT) AS n_missing
FROM g WHERE (epoch(ts_utc) - epoch(prev)) / 3600 - 1 > 0""", FAM)
def gap_intervals(spark, sf_dir):
    """Runs of missing hourly slots inside each counter's history."""
    return CV.gaps(counts(spark, sf_dir))


@query("gap_repair", with_views("counts", "snapshots") + """,
g AS (SELECT counter_id, ts_utc, lag(ts_utc) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS prev FROM counts),
gp AS (SELECT counter_id, prev + INTERVAL 1 HOUR AS gap_start, ts_utc AS gap_end FROM g
       WHERE (epoch(ts_utc) - epoch(prev)) / 3600 - 1 > 0),
miss AS (SELECT counter_id, unnest(generate_series(gap_start, gap_end - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts_utc FROM gp),
fix AS (SELECT counter_id, ts_utc, hourly_count FROM snapshots WHERE snapshot_no = 3)
SELECT m.counter_id, CASE WHEN f.hourly_count IS NULL THEN 'unavailable'
                          WHEN f.hourly_count > 3 THEN 'quarantined' ELSE 'filled' END AS outcome,
       count(*) AS n_slots
FROM miss m LEFT JOIN fix f ON m.counter_id = f.counter_id AND m.ts_utc = f.ts_utc
GROUP BY 1, 2""", FAM)
def gap_repair(spark, sf_dir):
    """Outcome of a repair batch (snapshot 3) on each missing slot:
    filled, quarantined (implausible value) or still unavailable."""
    s = materialize(snapshots(spark, sf_dir))  # read for the gaps and the repair batch
    g = CV.gaps(s.select("counter_id", "ts_utc").distinct())
    miss = g.select("counter_id", F.explode(F.sequence(
        "gap_start", F.timestamp_add("HOUR", F.lit(-1), F.col("gap_end")),
        F.expr("INTERVAL 1 HOUR"))).alias("ts_utc"))
    fix = s.filter(F.col("snapshot_no") == 3).select("counter_id", "ts_utc", "hourly_count")
    j = miss.join(fix, ["counter_id", "ts_utc"], "left")
    outcome = (F.when(F.col("hourly_count").isNull(), "unavailable")
               .when(F.col("hourly_count") > 3, "quarantined").otherwise("filled"))
    return j.groupBy("counter_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n_slots"))


@query("publish_gate", with_views("counts", "snapshots") + _merge_sql("snapshots") + f""",
act AS (SELECT counter_id, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts FROM counts GROUP BY 1),
b AS (SELECT counter_id,
        {UTC_OF_LOCAL_SQL.format(c="date_trunc('day', " + PARIS_SQL.format(c='first_ts') + ")")} AS start_utc,
        {UTC_OF_LOCAL_SQL.format(c="date_trunc('day', " + PARIS_SQL.format(c='last_ts') + ") + INTERVAL 1 DAY")} - INTERVAL 1 HOUR AS stop_utc
      FROM act),
slots AS (SELECT counter_id, unnest(generate_series(start_utc, stop_utc, INTERVAL 1 HOUR)) AS ts_utc FROM b),
c AS (SELECT s.counter_id, round(count(*) FILTER (WHERE m.tie = false) / count(*), 6) AS coverage_ratio
      FROM slots s LEFT JOIN m ON s.counter_id = m.counter_id AND s.ts_utc = m.ts_utc GROUP BY 1)
SELECT counter_id, coverage_ratio, ends_with(counter_id, 'N-S') AS required,
  CASE WHEN coverage_ratio >= 0.5 THEN 'publish' WHEN ends_with(counter_id, 'N-S') THEN 'block'
       ELSE 'publish_with_fallback' END AS decision
FROM c""", FAM)
def publish_gate(spark, sf_dir):
    """Publish when coverage reaches the threshold; a required counter
    below it blocks, an optional one publishes with a recorded fallback."""
    cv = _coverage(spark, sf_dir)
    c = cv.groupBy("counter_id").agg(
        round_scaled(F.count(F.when(F.col("state") == "valid", 1)) / F.count(F.lit(1)), 6)
        .alias("coverage_ratio"))
    c = c.withColumn("required", F.col("counter_id").endswith("N-S"))
    return CV.publish_gate(c, "counter_id", "coverage_ratio", 0.5).select(
        "counter_id", "coverage_ratio", "required", "decision")


LOOKBACK_HOURS = 48


@query("sync_lookback", with_views("counts") + f""",
e AS (SELECT concat(event_type, '_', CASE WHEN user_id % 2 = 0 THEN 'N-S' ELSE 'S-N' END) AS counter_id,
        ts, ts + INTERVAL (user_id % 72) HOUR AS available_at FROM events)
SELECT counter_id, CASE WHEN available_at > ts + INTERVAL {LOOKBACK_HOURS} HOUR THEN 'late' ELSE 'in_window' END AS route,
  count(*) AS n_rows, max(available_at) AS last_available
FROM e GROUP BY 1, 2""", FAM)
def sync_lookback(spark, sf_dir):
    """A daily sync re-reads a 48 h correction lookback; rows that arrive
    after their lookback closed go to the late side table."""
    ev = table(spark, sf_dir, "events")
    e = ev.select(F.concat_ws("_", "event_type", F.when(F.col("user_id") % 2 == 0, "N-S").otherwise("S-N"))
                  .alias("counter_id"), "ts",
                  F.timestamp_add("HOUR", (F.col("user_id") % 72).cast("int"), F.col("ts")).alias("available_at"))
    late = F.col("available_at") > F.timestamp_add("HOUR", F.lit(LOOKBACK_HOURS), F.col("ts"))
    return (e.groupBy("counter_id", F.when(late, "late").otherwise("in_window").alias("route"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.max("available_at").alias("last_available")))


BACKFILL_A, BACKFILL_B = "2024-01-10 00:00:00", "2024-01-15 00:00:00"


@query("backfill", with_views("snapshots") + _merge_sql("snapshots") + f""",
inside AS (SELECT counter_id, ts_utc, hourly_count, 'backfill' AS source FROM snapshots
           WHERE snapshot_no = 3 AND ts_utc >= TIMESTAMP '{BACKFILL_A}' AND ts_utc < TIMESTAMP '{BACKFILL_B}'),
outside AS (SELECT counter_id, ts_utc, hourly_count, 'kept' AS source FROM m
            WHERE ts_utc < TIMESTAMP '{BACKFILL_A}' OR ts_utc >= TIMESTAMP '{BACKFILL_B}')
SELECT counter_id, source, count(*) AS n_rows, CAST(sum(hourly_count) AS BIGINT) AS total
FROM (SELECT * FROM inside UNION ALL SELECT * FROM outside) GROUP BY 1, 2""", FAM)
def backfill(spark, sf_dir):
    """Recompute an explicit interval from the backfill snapshot; rows
    outside the interval are kept untouched."""
    lo = F.lit(BACKFILL_A).cast("timestamp_ntz")
    hi = F.lit(BACKFILL_B).cast("timestamp_ntz")
    s = materialize(snapshots(spark, sf_dir))  # read for the interval and the rows outside it
    inside = (s.filter((F.col("snapshot_no") == 3) & (F.col("ts_utc") >= lo) & (F.col("ts_utc") < hi))
              .select("counter_id", "ts_utc", "hourly_count", F.lit("backfill").alias("source")))
    m = C.merge(s, C.precedence_default(F.col("snapshot_no")))
    outside = (m.filter((F.col("ts_utc") < lo) | (F.col("ts_utc") >= hi))
               .select("counter_id", "ts_utc", "hourly_count", F.lit("kept").alias("source")))
    u = inside.unionByName(outside)
    return u.groupBy("counter_id", "source").agg(F.count(F.lit(1)).alias("n_rows"),
                                                 F.sum("hourly_count").cast("bigint").alias("total"))


@query("rolling_window", """
WITH mx AS (SELECT max(o_orderdate) AS t FROM orders)
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n_rows
FROM orders, mx WHERE o_orderdate >= mx.t - INTERVAL 13 MONTH GROUP BY 1""", FAM)
def rolling_window(spark, sf_dir):
    """Rebuild of the rolling 13-month window from the full history."""
    o = table(spark, sf_dir, "orders")
    newest = o.agg(F.max("o_orderdate")).scalar()
    w = o.filter(F.col("o_orderdate") >= F.timestamp_add("MONTH", F.lit(-13), newest))
    return (w.groupBy(F.trunc(F.to_date("o_orderdate"), "month").cast("timestamp_ntz").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("cutoff_filter", with_views("counts") + """,
mx AS (SELECT max(ts_utc) - INTERVAL 1 DAY AS cutoff FROM counts)
SELECT counter_id, count(*) AS n_usable, max(ts_utc) AS last_usable
FROM counts, mx WHERE ts_utc + INTERVAL 2 HOUR <= mx.cutoff GROUP BY 1""", FAM)
def cutoff_filter(spark, sf_dir):
    """Only observations available (2 h publication delay) before the
    prediction cut-off (a day before the newest hour) are used."""
    c = materialize(counts(spark, sf_dir))  # read by the cut-off subquery and the filter
    cutoff = F.timestamp_add("DAY", F.lit(-1), c.agg(F.max("ts_utc")).scalar())
    ok = F.timestamp_add("HOUR", F.lit(2), F.col("ts_utc")) <= cutoff
    return c.filter(ok).groupBy("counter_id").agg(F.count(F.lit(1)).alias("n_usable"),
                                                  F.max("ts_utc").alias("last_usable"))
