"""The commit log: visibility, retries, conflicts, rivals for a number, reads as of a commit, syncs."""

import datetime
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from hourcast.operators import history_log as H

KEY = ["counter_id", "ts_utc"]
ROWS = "counter_id string, ts_utc timestamp_ntz, hourly_count long"
DAY = datetime.datetime(2024, 1, 1)
COVERS = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")


def batch(spark, *rows):
    return spark.createDataFrame([(k, DAY + datetime.timedelta(hours=h), n) for k, h, n in rows], ROWS)


def put(path, df, **how):
    return H.append(path, df, KEY, "hourly_count", how.pop("source", "s"), how.pop("covers", COVERS), **how)


def now(spark, path, number=None):
    got = H.current(spark, path, ROWS, KEY, "hourly_count", number).collect()
    return {(r.counter_id, r.ts_utc.hour): (r.hourly_count, r.number) for r in got}


def test_reads_as_of_each_commit_and_keeps_superseded_rows(spark, scratch):
    path = os.path.join(scratch, "log")
    assert now(spark, path) == {} and H.last_number(spark, path) == 0
    assert put(path, batch(spark, ("a", 0, 5), ("a", 1, 6), (None, 2, 7))) == ("accepted", 1)
    assert put(path, batch(spark, ("a", 1, 60), ("b", 0, 1)), context="second") == ("accepted", 2)
    assert now(spark, path, 1) == {("a", 0): (5, 1), ("a", 1): (6, 1), (None, 2): (7, 1)}
    assert now(spark, path) == {("a", 0): (5, 1), ("a", 1): (60, 2), (None, 2): (7, 1), ("b", 0): (1, 2)}
    assert H.revisions(spark, path, ROWS).count() == 5


@pytest.mark.parametrize("change,outcome", [({}, "duplicate"), ({"version": "v2"}, "accepted"), ({"context": "x"}, "accepted"),
                                            ({"source": "t"}, "accepted"), ({"covers": (COVERS[0], "2024-01-03 00:00:00")}, "accepted")])
def test_a_retry_is_known_by_all_parts_of_its_identity(spark, scratch, change, outcome):
    path = os.path.join(scratch, "log")
    rows = batch(spark, ("a", 0, 5), ("a", 1, 6))
    put(path, rows)
    files = set(os.listdir(f"{path}/rows"))
    assert put(path, rows.repartition(3), **change) == (outcome, 1 if outcome == "duplicate" else 2)
    assert (set(os.listdir(f"{path}/rows")) == files) == (outcome == "duplicate")
    assert put(path, batch(spark, ("a", 0, 5), ("a", 1, 7)))[0] == "accepted"  # another checksum


def test_conflict_only_with_a_later_commit_of_the_source_that_overlaps(spark, scratch):
    path = os.path.join(scratch, "log")
    put(path, batch(spark, ("a", 0, 1)))
    put(path, batch(spark, ("a", 0, 2)), context="2")
    assert put(path, batch(spark, ("a", 0, 3)), based_on=1) == ("conflict", 2)
    assert put(path, batch(spark, ("a", 0, 3)), based_on=1, source="other") == ("accepted", 3)
    assert put(path, batch(spark, ("a", 0, 3)), based_on=1, covers=("2024-01-02 00:00:00", "2024-01-03 00:00:00")) == ("accepted", 4)
    assert put(path, batch(spark, ("a", 0, 3)), based_on=2) == ("accepted", 5)


def test_quarantined_and_rejected_rows_are_kept_and_never_current(spark, scratch):
    path = os.path.join(scratch, "log")
    faults = F.filter(F.array(F.when(F.col("hourly_count") < 0, F.lit("negative")), F.when(F.col("hourly_count").isNull(), F.lit("missing"))),
                      lambda r: r.isNotNull())
    put(path, batch(spark, ("a", 0, 5), ("a", 1, 6)))
    assert put(path, batch(spark, ("a", 0, -5), ("a", 1, 7), ("a", 2, None)), reasons=faults) == ("accepted", 2)
    assert put(path, batch(spark, ("a", 1, -1)), reasons=faults) == ("rejected", 3)
    assert put(path, batch(spark).limit(0)) == ("empty", 4)
    assert now(spark, path) == {("a", 0): (5, 1), ("a", 1): (7, 2)}
    kept = sorted((r.number, r.outcome, r.reasons) for r in H.revisions(spark, path, ROWS).collect())
    assert kept == [(1, "accepted", []), (1, "accepted", []), (2, "accepted", []), (2, "quarantined", ["missing"]),
                    (2, "quarantined", ["negative"]), (3, "quarantined", ["negative"])]
    counts = {r.number: (r.outcome, r.n_accepted, r.n_quarantined) for r in H.commits(spark, path).collect()}
    assert counts == {1: ("accepted", 2, 0), 2: ("accepted", 1, 2), 3: ("rejected", 0, 1), 4: ("empty", 0, 0)}


def test_rows_of_a_lost_run_are_never_seen(spark, scratch):
    path = os.path.join(scratch, "log")
    put(path, batch(spark, ("a", 0, 5)))
    batch(spark, ("a", 0, 99)).withColumn("reasons", F.array().cast("array<string>")).write.parquet(f"{path}/rows/token={uuid.uuid4().hex}")
    assert now(spark, path) == {("a", 0): (5, 1)} and H.revisions(spark, path, ROWS).count() == 1


def test_a_rival_for_the_same_number_is_settled_alike_for_all(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "log")
    put(path, batch(spark, ("a", 0, 1)))
    real, rival = H.last_number, {}

    def late_rival(s, p):
        """Another writer takes the number between this writer's look and its commit."""
        number = real(s, p)
        if not rival:
            rival["at"] = number + 1
            token = "0" * 32  # smaller than any other: the rival holds the number
            batch(spark, ("a", 0, 50)).withColumn("reasons", F.array().cast("array<string>")).write.parquet(f"{p}/rows/token={token}")
            row = H.commits(s, p).filter("number = 1").withColumns({"number": F.lit(number + 1), "token": F.lit(token), "context": F.lit("rival")})
            row.coalesce(1).write.mode("append").partitionBy("number").parquet(f"{p}/log")
        return number

    monkeypatch.setattr(H, "last_number", late_rival)
    assert put(path, batch(spark, ("a", 0, 70)), context="mine") == ("accepted", 3)
    monkeypatch.setattr(H, "last_number", real)
    assert now(spark, path, 2) == {("a", 0): (50, 2)} and now(spark, path) == {("a", 0): (70, 3)}
    assert H.commits(spark, path).count() == 3


def some_events(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        ts = DAY + datetime.timedelta(minutes=rng.randrange(10 * 24 * 60))
        out.append((rng.choice(["a", "b", None]), ts, ts + datetime.timedelta(hours=rng.choice([0, 1, 30, 70, 200]))))
    return out


@pytest.mark.parametrize("runs", [["2024-01-11 00:00:00"], ["2024-01-04 00:00:00", "2024-01-08 00:00:00", "2024-01-12 00:00:00", "2024-01-25 00:00:00"]])
def test_syncs_equal_a_recount_and_late_rows_are_all_kept(spark, scratch, runs):
    path = os.path.join(scratch, "sync")
    events = some_events()
    df = spark.createDataFrame(events, "counter_id string, ts timestamp_ntz, available_at timestamp_ntz")
    history, late, mark = {}, [], None
    for at in runs:
        end = datetime.datetime.fromisoformat(at)
        start = mark - datetime.timedelta(hours=48) if mark else datetime.datetime.min
        counted = {}
        for k, ts, av in events:
            if av <= end and ts < end:
                if ts >= start:
                    h = (k, ts.replace(minute=0))
                    counted[h] = counted.get(h, 0) + 1
                elif av > mark:
                    late.append((k, ts))
        history.update(counted)
        for again in (False, True):
            outcome, number, n_late = H.sync(path, df, at, 48, KEY, ROWS)
            assert outcome == ("duplicate" if again else "accepted") and n_late == sum(1 for _ in late) - (0 if mark is None else late_before)
        late_before, mark = len(late), end
    got = {(r.counter_id, r.ts_utc): r.hourly_count for r in H.current(spark, path, ROWS, KEY, "hourly_count").collect()}
    assert got == history
    found = H.stored(spark, f"{path}/late", "counter_id string, ts timestamp_ntz, available_at timestamp_ntz").collect()
    assert sorted((str(r.counter_id), r.ts) for r in found) == sorted((str(k), t) for k, t in late)
    assert sum(history.values()) + len(late) == sum(av <= mark and ts < mark for _, ts, av in events)


def test_a_sync_without_news_moves_the_mark_and_appends_no_rows(spark, scratch):
    path = os.path.join(scratch, "sync")
    df = spark.createDataFrame([("a", DAY, DAY)], "counter_id string, ts timestamp_ntz, available_at timestamp_ntz")
    assert H.sync(path, df, "2024-01-02 00:00:00", 48, KEY, ROWS) == ("accepted", 1, 0)
    assert H.sync(path, df, "2024-01-04 00:00:00", 48, KEY, ROWS) == ("empty", 2, 0)
    more = df.unionByName(spark.createDataFrame([("a", DAY, datetime.datetime(2024, 1, 5))], df.schema))
    assert H.sync(path, more, "2024-01-06 00:00:00", 48, KEY, ROWS) == ("empty", 3, 1)
    assert H.revisions(spark, path, ROWS).count() == 1
