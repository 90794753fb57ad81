"""An append-only commit log over stored revisions.

A folder that all executors share holds

* ``rows/token=…``: the accepted and quarantined rows of one batch, never rewritten;
* ``log/number=…``: one row per commit, written after its rows.

Rows become visible with their log row, all at once: a run that is lost before
leaves rows that nothing names.  Commits are numbered; if two writers take the
same number, the smaller token holds it for every reader, and the other one
checks again and takes the next.  A batch is known by (source, version,
coverage, context, checksum), so a retry finds its own commit and adds nothing.
A writer that says which commit it worked from conflicts with a later commit of
its source whose coverage overlaps its own.

Reading as of a commit takes the newest accepted row of each key among the
commits up to it: one aggregate over the whole key, however large a counter is.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.operators.canonical import row_digest

LOG = ("number int, token string, source string, version string, covers_from timestamp_ntz, covers_to timestamp_ntz, "
       "context string, checksum string, outcome string, n_accepted long, n_quarantined long")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; no rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The log: one row per commit number."""
    log = stored(spark, f"{path}/log", LOG)
    names = log.columns
    return log.groupBy("number").agg(F.min_by(F.struct(*names), "token").alias("c")).select("c.*")


def last_number(spark: SparkSession, path: str) -> int:
    return commits(spark, path).agg(F.max("number")).first()[0] or 0


def append(path: str, rows: DataFrame, key: list[str], value: str, source: str, covers: tuple, version: str = "v1",
           context: str = "", based_on: int | None = None, reasons: Column | None = None) -> tuple[str, int]:
    """One batch of ``rows(key, value)``: (outcome, commit number).

    ``covers`` is the half-open time range that the batch speaks for.
    ``reasons`` is an array of a row's faults; a row with any is kept as
    quarantined.  Outcomes: ``accepted``; ``empty`` (no rows); ``rejected`` (no row is
    without fault; kept, never read as current); ``duplicate`` (the number is the earlier
    commit's); ``conflict`` (nothing written, the number is the one in the way).
    """
    spark = rows.sparkSession
    faults = F.coalesce(reasons if reasons is not None else F.array(), F.array().cast("array<string>")).cast("array<string>")
    kept = rows.select(*key, value, faults.alias("reasons"))
    digest = row_digest(*key, value)
    n, bad, checksum = kept.agg(F.count(F.lit(1)), F.count(F.when(F.size("reasons") > 0, 1)),
                                F.coalesce(F.sum(digest).cast("string"), F.lit("0"))).first()
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in covers)
    same = ((F.col("source") == source) & (F.col("version") == version) & (F.col("covers_from") == lo) & (F.col("covers_to") == hi)
            & (F.col("context") == context) & (F.col("checksum") == checksum))
    token, written = uuid.uuid4().hex, False
    while True:
        log = commits(spark, path)
        known = log.filter(same).agg(F.min("number")).first()[0]
        if known is not None:
            return "duplicate", known
        if based_on is not None:
            later = log.filter((F.col("source") == source) & (F.col("number") > based_on) & (F.col("outcome") == "accepted")
                               & (F.col("covers_from") < hi) & (F.col("covers_to") > lo)).agg(F.min("number")).first()[0]
            if later is not None:
                return "conflict", later
        if not written:
            kept.write.parquet(f"{path}/rows/token={token}")
            written = True
        number = last_number(spark, path) + 1
        outcome = "accepted" if n > bad else "rejected" if n else "empty"
        spark.range(1).select(
            F.lit(number).alias("number"), F.lit(token).alias("token"), F.lit(source).alias("source"), F.lit(version).alias("version"),
            lo.alias("covers_from"), hi.alias("covers_to"), F.lit(context).alias("context"), F.lit(checksum).alias("checksum"),
            F.lit(outcome).alias("outcome"), F.lit(n - bad).cast("long").alias("n_accepted"),
            F.lit(bad).cast("long").alias("n_quarantined")).coalesce(1).write.mode("append").partitionBy("number").parquet(f"{path}/log")
        if commits(spark, path).filter(F.col("number") == number).first().token == token:
            return outcome, number


def revisions(spark: SparkSession, path: str, key_schema: str, as_of: int | None = None) -> DataFrame:
    """All stored rows with their commit ``number``, ``outcome`` and ``reasons``, superseded ones included."""
    log = commits(spark, path)
    if as_of is not None:
        log = log.filter(F.col("number") <= as_of)
    rows = stored(spark, f"{path}/rows", f"{key_schema}, reasons array<string>, token string")
    rows = rows.join(log.select("token", "number", F.col("outcome").alias("_batch")), "token").drop("token")
    return rows.withColumn("outcome", F.when(F.size("reasons") > 0, "quarantined").otherwise(F.col("_batch"))).drop("_batch")


def current(spark: SparkSession, path: str, key_schema: str, key: list[str], value: str, as_of: int | None = None) -> DataFrame:
    """The newest accepted row of each key as of a commit: ``(key, value, number)``."""
    rows = revisions(spark, path, key_schema, as_of).filter("outcome = 'accepted'")
    return rows.groupBy(*key).agg(F.max_by(value, "number").alias(value), F.max("number").alias("number"))


# ---- sync with a correction lookback (C31) -----------------------------------

def sync(path: str, observed: DataFrame, now: str, lookback_hours: int, key: list[str], key_schema: str, source: str = "sync",
         ts: str = "ts", available: str = "available_at") -> tuple[str, int, int]:
    """One daily run up to the hour ``now`` over ``observed(key without the hour, ts, available_at)``.

    The high-water mark is the end of the last run's coverage.  Hours from mark
    less ``lookback_hours`` on are counted again from what is available, and
    only hours whose count is new or changed are appended.  Rows that became
    available since the mark for older hours go to the late table and change no
    count.  Returns (outcome, commit number, late rows); a run that changes
    nothing appends nothing, and a repeated run is a duplicate.
    """
    spark = observed.sparkSession
    log = commits(spark, path).filter((F.col("source") == source) & F.col("outcome").isin("accepted", "empty"))
    end = F.lit(now).cast("timestamp_ntz")
    before = log.filter(F.col("covers_to") < end).agg(F.max(F.struct("covers_to", "number")).alias("m")).first().m
    start = before.covers_to - datetime.timedelta(hours=lookback_hours) if before else datetime.datetime(1, 1, 1)
    here = observed.filter((F.col(available) <= end) & (F.col(ts) < end))
    plain = [k for k in key if k != "ts_utc"]
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias("ts_utc")
    counted = here.filter(F.col(ts) >= F.lit(start)).groupBy(*plain, hour).agg(F.count(F.lit(1)).alias("hourly_count"))
    known = current(spark, path, key_schema, key, "hourly_count", before.number if before else 0)
    changed = counted.join(known.select(*key, F.col("hourly_count").alias("_old")), key, "left").filter(
        ~F.col("_old").eqNullSafe(F.col("hourly_count"))).drop("_old")
    outcome, number = append(path, changed, key, "hourly_count", source, (str(start), now), context=f"lookback={lookback_hours}h")
    if before is None:
        return outcome, number, 0
    late = here.filter((F.col(ts) < F.lit(start)) & (F.col(available) > F.lit(before.covers_to))).select(*plain, ts, available)
    late.write.mode("overwrite").parquet(f"{path}/late/number={number}")  # a repeated run replaces its own
    return outcome, number, spark.read.schema(late.schema).parquet(f"{path}/late/number={number}").count()
