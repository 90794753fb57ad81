"""Invariants: sizes add up, replays are idempotent,
derived ids equal their definition."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as E
from hourcast.functions import labels as L
from hourcast.operators import ledger as LG
from hourcast.operators import sequence as seq
from hourcast.sources.tables import counts, ledger
from tests.conftest import SMALL

from hourcast.catalog import QUERIES as Q  # noqa: E402


def test_split_sizes_add_up(spark):
    s = Q["time_split"](spark, SMALL).groupBy("counter_id").agg(F.sum("n_rows").alias("n"))
    n = counts(spark, SMALL).groupBy("counter_id").count()
    assert s.join(n, "counter_id").filter(F.col("n") != F.col("count")).count() == 0


def test_coverage_adds_up(spark):
    c = Q["coverage_rollup"](spark, SMALL)
    assert c.filter(F.col("expected") != F.col("valid") + F.col("quarantined") + F.col("unavailable")).count() == 0
    total = c.filter(F.col("counter_id").isNull()).first()
    assert total.expected == Q["expected_slots"](spark, SMALL).agg(F.sum("n_slots")).first()[0]


def test_promotion_replay_is_idempotent(spark):
    lg = ledger(spark, SMALL)
    once = LG.current(lg)
    twice = LG.current(lg.unionByName(lg))
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_current_pointer_latest_promotion_wins(spark):
    rows = [("predictions", "c1", "1", "promoted", "2024-01-01 00:00:00"),
            ("predictions", "c1", "2", "promoted", "2024-01-02 00:00:00"),
            ("predictions", "c1", "3", "validated", "2024-01-03 00:00:00"),
            ("predictions", "c2", "10", "promoted", "2024-01-01 00:00:00"),
            ("predictions", "c2", "9", "promoted", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "artifact_type string, counter_id string, run_id string, status string, "
                                     "promoted_at string").withColumn("promoted_at",
                                                                      F.col("promoted_at").cast("timestamp_ntz"))
    got = {r.counter_id: r.run_id for r in LG.current(df).collect()}
    assert got == {"c1": "2", "c2": "10"}   # ties broken by the integer run id, not the text


def test_revision_numbers_are_dense(spark):
    r = Q["revision_ledger"](spark, SMALL).groupBy("counter_id", "ts_utc").agg(
        F.max("revision_no").alias("m"), F.count(F.lit(1)).alias("n"))
    assert r.filter(F.col("m") != F.col("n")).count() == 0


def test_job_id_digest_matches_hashlib(spark):
    df = spark.createDataFrame([(None, "ingest", "20240101", "Counter 7", "dag", "ingest", 2)],
                               "job_id string, job_type string, run_id string, counter_id string, dag_id string, "
                               "task_id string, try_number int")
    key = L.idempotency_key("job_id", "job_type", "run_id", "counter_id", "dag_id", "task_id", "try_number")
    r = df.select(key.alias("k"), L.job_id("job_id", "job_type", "counter_id", key).alias("j")).first()
    expected_key = "job_type=ingest|run_id=20240101|counter_id=Counter 7|dag_id=dag|task_id=ingest|try_number=2"
    assert r.k == expected_key
    assert r.j == "job-ingest-Counter-7-" + hashlib.sha256(expected_key.encode()).hexdigest()[:12]


def test_slug_cuts(spark):
    long = "é" + "a" * 100
    r = spark.createDataFrame([(long,)], "t string").select(L.slug_ascii("t").alias("a"), L.slug_id("t").alias("b")).first()
    assert r.a == "e" + "a" * 63
    assert len(r.b) == 48


def test_percent_and_test_split_boundaries(spark):
    df = spark.createDataFrame([("c", i) for i in range(7)], "counter_id string, ts_utc int")
    t = seq.time_split(df, 0.25).filter("is_test").count()
    assert t == int(7 * 0.25)
