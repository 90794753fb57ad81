"""File sources and sinks (A1–A8, A92–A96) and the streams S1–S5 against
their batch twins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hourcast.catalog.alerting import HOLD_MINUTES
from hourcast.operators import alerts as A
from hourcast.sources import files as FS
from hourcast.sources import sinks as SK
from hourcast.sources.tables import counts, samples, snapshots, table
from hourcast.streaming import streams as ST
from tests.conftest import SMALL


def _raw_csv(spark, scratch):
    ev = table(spark, SMALL, "events")
    raw = ev.select(F.monotonically_increasing_id().alias("idx"),
                    F.when(F.col("event_type") == "view", "Totem 73 boulevard de Sébastopol")
                    .otherwise(F.col("event_type")).alias("nom_du_site_de_comptage"),
                    F.when(F.col("user_id") % 2 == 0, "N-S").otherwise("S-N").alias("orientation_compteur"),
                    F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))
                    .alias("date_et_heure_de_comptage"),
                    (F.col("user_id") % 50).cast("string").alias("comptage_horaire"))
    path = os.path.join(scratch, "raw")
    raw.coalesce(1).write.option("header", True).csv(path)
    return path


def test_raw_scan_select_parse(spark, scratch):
    path = _raw_csv(spark, scratch)
    df = FS.read_raw_counts(spark, path)
    assert "_c0" not in df.columns
    norm = FS.normalize_raw(df)
    sel = FS.select_counter(df, "Totem 73 boulevard de Sébastopol", "N-S")
    assert sel.count() > 0
    ids = {r.counter_id for r in norm.select("counter_id").distinct().collect()}
    assert "Totem_73_boulevard_de_Sebastopol_N-S" in ids
    # the +01:00 offset is converted to UTC
    import datetime as dt
    first = norm.orderBy("ts_utc").first()
    src = table(spark, SMALL, "events").agg(F.min("ts")).first()[0]
    assert first.ts_utc == src.replace(microsecond=0) - dt.timedelta(hours=1)
    req = spark.createDataFrame([("Nowhere", "N-S")], "nom_du_site_de_comptage string, orientation_compteur string")
    assert FS.unknown_keys(req, df, FS.KEY_COLS).count() == 1


def test_required_columns_and_empty_gate(spark, scratch):
    from hourcast.operators.validate import require_columns, require_rows
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        require_columns(df, ["a", "c", "b"])
    with pytest.raises(ValueError):
        require_rows(df.filter("a > 1"))


def test_dataset_roundtrip_prunes_partitions(spark, scratch):
    c = counts(spark, SMALL)
    path = os.path.join(scratch, "interim")
    SK.write_dataset(c, path)
    back = FS.read_dataset(spark, path, ["click_N-S"])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "click_N-S" in plan
    assert back.count() == c.filter(F.col("counter_id") == "click_N-S").count()
    # rerun overwrites only its partitions
    SK.write_dataset(c.filter(F.col("counter_id") == "view_N-S"), path)
    assert spark.read.parquet(path).count() == c.count()


def test_predictions_scan_checks(spark, scratch):
    good = os.path.join(scratch, "pred_ok")
    rows = [(f"2031-02-0{d} 01:30:00", f"2031-02-0{d} 00:30:00", 7.0 * d, 7.0 * d - 0.25, d > 2) for d in (1, 2, 3)]
    spark.createDataFrame(rows, FS.PREDICTION_SCHEMA).coalesce(1).write.option("header", True).csv(good)
    df = FS.read_predictions(spark, good)
    from hourcast.operators.ledger import paginate
    page = paginate(df.withColumn("k", F.lit(1)), "k", ["date_et_heure_de_comptage_utc"], 2, 5).collect()
    assert [r.y_true for r in page] == [21.0] and page[0].total == 3
    bad = os.path.join(scratch, "pred_bad")
    spark.createDataFrame([("a", "b", 1.0, True)], "date_et_heure_de_comptage_local string, "
                          "date_et_heure_de_comptage_utc string, y_pred double, forecast_mode boolean") \
        .write.option("header", True).csv(bad)
    with pytest.raises(ValueError, match="y_true"):
        FS.read_predictions(spark, bad)


def test_manifest_scan_errors_and_discovery(spark, scratch):
    root = os.path.join(scratch, "manifests", "predictions")
    valid = {"schema_version": "1.0", "artifact_type": "predictions", "status": "promoted", "run_id": "r7",
             "counter_id": "Quay_S-N", "created_at": "2031-02-01T00:30:00+00:00",
             "producer": {"service": "trainer"}, "source": {"raw_file_name": "quay.csv"},
             "storage": {"primary_backend": "local", "local_path": "out/quay.csv"}}
    docs = {"Quay_S-N/current.json": json.dumps(valid, indent=2),
            "Other_S-N/current.json": "{not json",
            "Third_N-S/current.json": "[1, 2]",
            "Fourth_N-S/current.json": json.dumps({**valid, "unexpected": 1})}
    for rel, text in docs.items():
        os.makedirs(os.path.join(root, os.path.dirname(rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write(text)
    m = FS.read_manifests(spark, os.path.join(root, "*", "current.json"))
    errors = {r.current_of: r.error for r in m.collect()}
    assert errors == {"Quay_S-N": None, "Other_S-N": "bad_json", "Third_N-S": "not_an_object",
                      "Fourth_N-S": "invalid_manifest"}
    assert [r.counter_id for r in FS.discover_current(m).collect()] == ["Quay_S-N"]


def test_config_and_allow_list(spark):
    cfg = {"scheduling": {"initial_anchor_date": "2026-06-10", "daily_increment_pct": 0.25},
           "counters": {"Sebastopol_N-S_airflow": {"site": "Totem 73 boulevard de Sébastopol",
                                                   "orientation": "N-S", "modeling": {"ar": 3}},
                        "Other": {"site": "x", "orientation": "S-N"}}}
    doc = spark.createDataFrame([(json.dumps(cfg),)], "value string")
    rows = {r.counter_id: r for r in FS.counter_config(doc).collect()}
    assert rows["Sebastopol_N-S_airflow"].ar == 3 and rows["Sebastopol_N-S_airflow"].roll == 24
    assert rows["Other"].ar == 7 and rows["Other"].test_ratio == 0.25
    got = spark.createDataFrame([(" a, ,b ,",)], "s string").select(FS.allow_list(F.col("s"))).first()[0]
    assert got == ["a", "b"]


def test_stream_hourly_counts_equal_batch(spark):
    got = ST.run_to_table(ST.hourly_counts(ST.events_stream(spark, SMALL)), "s1_counts")
    # batch twin: append mode holds back windows newer than max(ts) - lookback
    c = counts(spark, SMALL)
    horizon = table(spark, SMALL, "events").agg(F.max("ts")).first()[0]
    import datetime as dt
    cut = horizon - dt.timedelta(hours=2)
    twin = c.filter(F.timestamp_add("HOUR", F.lit(1), F.col("ts_utc")) <= F.lit(cut))
    a = {(r.counter_id, r.hourly_count) for r in got.collect()}
    assert got.count() == twin.count()
    assert a == {(r.counter_id, r.hourly_count) for r in twin.collect()}


def test_stream_first_submission_and_sliding(spark):
    got = ST.run_to_table(ST.idempotent_submits(ST.events_stream(spark, SMALL)), "s3_submits").collect()
    assert len({r.idem_key for r in got}) == len(got) > 0
    assert ST.run_to_table(ST.sliding_means(ST.events_stream(spark, SMALL)), "s2_means").count() > 0


def _held_batch(spark, sf_dir):
    hold = HOLD_MINUTES * 60_000_000
    s = samples(spark, sf_dir).withColumn("bucket", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9))
    batch = A.held(s, ["instance"], ["ts", "event_id"], "bucket", F.col("up") == 0, hold)
    # the stream emits islands once they close; the last island of an instance may still be open
    closed = batch.join(s.filter(F.col("up") == 1).select("instance", F.col("ts").alias("t2")), "instance") \
        .filter(F.col("t2") > F.col("end_ts")).select("instance", "start_ts", "n_samples", "fired").distinct()
    return {(r.instance, r.start_ts, r.n_samples, r.fired) for r in closed.collect()}


def _held_stream(spark, sf_dir, lookback="0 seconds", max_files=None):
    s = ST.held_alerts(ST.events_stream(spark, sf_dir, max_files), HOLD_MINUTES * 60_000_000, lookback)
    return [(r.instance, r.start_ts, r.n_samples, r.fired) for r in ST.run_to_table(s, "s4_held").collect()]


def test_stream_held_alert_equals_batch(spark):
    got = _held_stream(spark, SMALL)
    assert len(got) == len(set(got)) and set(got) == _held_batch(spark, SMALL)


def _parts(spark, folder, newest_first=True):
    """``events`` as a folder of four part files written newest first."""
    import time
    order = table(spark, SMALL, "events").orderBy("ts", "event_id").toPandas()
    cuts = [order.iloc[k * len(order) // 4:(k + 1) * len(order) // 4] for k in range(4)]
    os.makedirs(f"{folder}/events.parquet")
    for k, part in enumerate(reversed(cuts) if newest_first else cuts):
        part = part.assign(ts=part["ts"].astype("datetime64[us]"))
        part.to_parquet(f"{folder}/events.parquet/part-{k}.parquet", index=False)
        stamp = time.time() - 1000 + k
        os.utime(f"{folder}/events.parquet/part-{k}.parquet", (stamp, stamp))
    return folder


def test_streams_read_a_folder_of_parts_in_any_order(spark, scratch):
    from hourcast.catalog import QUERIES
    folder = _parts(spark, scratch)
    for name in ("stream_hourly_counts", "stream_sliding_means", "stream_submit_keys", "stream_held_alerts",
                 "stream_corrections", "stream_job_states"):
        whole, parts = QUERIES[name](spark, SMALL), QUERIES[name](spark, folder)
        assert parts.count() == whole.count() > 0 and parts.exceptAll(whole).count() == 0, name
    assert QUERIES["file_checksums"](spark, folder).count() == 4


@pytest.mark.parametrize("bucket_us", [3_600_000_000, 6 * 3_600_000_000, 600_000_000])
def test_runs_joined_across_buckets_equal_the_one_key_machine(spark, bucket_us):
    hold = HOLD_MINUTES * 60_000_000
    rows = ST.run_to_table(ST.bucket_runs(ST.events_stream(spark, SMALL), bucket_us=bucket_us), "s4_bucket_runs")
    got = ST.join_runs(rows, hold)
    one = ST.run_to_table(ST.held_alerts(ST.events_stream(spark, SMALL), hold), "s4_held")
    assert got.count() == one.count() > 0 and got.exceptAll(one).count() == 0


def test_runs_are_joined_only_across_neighbouring_buckets(spark):
    rows = [(0, 0, True, None, None, None, None, None), (0, 0, None, 1, 9, 3, True, True),
            (0, 1, True, None, None, None, None, None), (0, 1, None, 10, 19, 2, True, True),  # down throughout
            (0, 4, True, None, None, None, None, None), (0, 4, None, 40, 41, 2, True, False), (0, 4, None, 43, 44, 1, False, False),
            (0, 4, None, 48, 49, 1, False, True),
            (0, 7, False, None, None, None, None, None), (0, 7, None, 75, 79, 4, False, True),  # a bucket that begins up closes the last run
            (1, 0, True, None, None, None, None, None), (1, 0, None, 1, 9, 3, True, True)]  # still open
    got = ST.join_runs(spark.createDataFrame(rows, ST.RUN_OUT), 30).orderBy("start_ts").collect()
    assert [(r.instance, r.start_ts.microsecond, r.end_ts.microsecond, r.n_samples, r.fired) for r in got] == [
        (0, 1, 41, 7, True), (0, 43, 44, 1, False), (0, 48, 49, 1, False)]


def test_held_alerts_wait_for_late_files(spark, scratch):
    """One file per batch, newest first: a lookback over the whole span loses nothing, and
    without one the run raises instead of returning a part."""
    import pandas as pd
    folder = _parts(spark, scratch)
    with pytest.raises(RuntimeError, match="late rows"):
        _held_stream(spark, folder, "0 seconds", 1)
    last = pd.read_parquet(f"{folder}/events.parquet/part-0.parquet").head(5)
    end = last.assign(event_id=range(10**9, 10**9 + 5), user_id=range(5), event_type="view",
                      ts=(last["ts"].max() + pd.Timedelta(days=900)).to_datetime64())
    end.assign(ts=end["ts"].astype("datetime64[us]")).to_parquet(f"{folder}/events.parquet/part-9.parquet", index=False)
    got = _held_stream(spark, folder, "400 days", 1)
    assert len(got) == len(set(got)) and set(got) == _held_batch(spark, folder)


def test_islands_continue_across_batches():
    import numpy as np
    us, down = np.arange(10), np.array([1, 1, 0, 1, 0, 0, 1, 1, 1, 0], bool)
    whole = [x.tolist() for x in ST.islands(us, down, None)[:3]]
    for cut in range(11):
        a = ST.islands(us[:cut], down[:cut], None)
        b = ST.islands(us[cut:], down[cut:], a[3])
        assert [x.tolist() + y.tolist() for x, y in zip(a[:3], b[:3])] == whole and b[3] is None


def test_a_streams_time_limit_is_the_callers_and_raises():
    class Slow:
        name, stopped, recentProgress = "slow", False, []

        def awaitTermination(self, t):
            return False

        def stop(self):
            self.stopped = True
    q = Slow()
    with pytest.raises(TimeoutError):
        ST.finish(q, 0.1)
    assert q.stopped


def test_stream_corrections_foreach_batch(spark):
    out = ST.run_corrections(spark, SMALL)
    snaps = snapshots(spark, SMALL)
    assert out.count() == snaps.count()
    assert out.exceptAll(snaps.select(*out.columns)).count() == 0
