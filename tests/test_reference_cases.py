"""The reference's operator unit cases (FIXTURES.md §1.2) and DST fixtures."""

import datetime as dt
import math

from pyspark.sql import functions as F

from hourcast.functions import calendar as CAL
from hourcast.functions import labels as L
from hourcast.operators import coverage as CV
from hourcast.operators import sequence as seq
from hourcast.plans.window_plan import daily_window


def test_percent_slice_20_80(spark):
    df = spark.createDataFrame([("c", i, i) for i in range(5)], "counter_id string, ts_utc int, value int")
    out = seq.percent_slice(df, 20, 80).orderBy("rn")
    assert [r.value for r in out.collect()] == [1, 2, 3]


def test_percent_slice_reversed_is_empty(spark):
    df = spark.createDataFrame([("c", i, i) for i in range(3)], "counter_id string, ts_utc int, value int")
    assert seq.percent_slice(df, 80, 20).count() == 0


def test_percent_slice_uses_float_truncation(spark):
    # int(100 * (15 / 100)) is 15 in IEEE, int(7 * 0.5/100 ...) etc.: spot-check several n
    for n, s, e in [(100, 15.0, 30.0), (7, 0.5, 15.5), (333, 1.0, 15.0)]:
        df = spark.createDataFrame([("c", i) for i in range(n)], "counter_id string, ts_utc int")
        got = [r.ts_utc for r in seq.percent_slice(df, s, e).orderBy("ts_utc").collect()]
        assert got == list(range(n))[int(n * (s / 100)):int(n * (e / 100))]


def test_lag_one_keeps_alignment(spark):
    df = spark.createDataFrame([("c", 0, 10.0, 1), ("c", 1, 20.0, 2), ("c", 2, 30.0, 3)],
                               "counter_id string, ts_utc int, feature double, hourly_count int")
    f = seq.add_ar_features(df, 1, 0, 24)
    cc = seq.complete_case(f, ["target_ar_1"]).orderBy("ts_utc").collect()
    assert [r.target_ar_1 for r in cc] == [1.0, 2.0]
    assert [r.ts_utc for r in cc] == [1, 2]
    assert [r.hourly_count for r in cc] == [2, 3]


def test_rolling_mean_null_until_full(spark):
    df = spark.createDataFrame([("c", i, float(i)) for i in range(6)], "counter_id string, ts_utc int, y double")
    f = seq.add_ar_features(df, 0, 1, 3, target="y").orderBy("ts_utc").collect()
    assert [r.target_mm_3_1 for r in f] == [None, None, None, 1.0, 2.0, 3.0]


def test_calendar_columns_and_drop(spark):
    df = spark.createDataFrame([("2026-06-07 10:00:00+0000",)], "ts string")
    df = df.withColumn("ts_utc", CAL.parse_utc("ts")).drop("ts")
    out = CAL.add_calendar(df, "ts_utc", prefix="ts", drop_source=True)
    r = out.collect()[0]
    assert "ts_utc" not in out.columns
    assert r.ts_local == dt.datetime(2026, 6, 7, 12, 0)     # CEST
    assert r.ts_hour == 12 and r.ts_day_of_week == 6 and r.ts_week_end == 1
    assert abs(r.ts_sin_hour - math.sin(2 * math.pi * 12 / 24)) < 1e-12


def test_iso_week_wraps(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 12),)], "ts_utc timestamp_ntz")
    r = CAL.add_calendar(df, "ts_utc", prefix="t").collect()[0]
    assert r.t_week == 1


def test_site_orientation_split(spark):
    df = spark.createDataFrame([("Sebastopol_N-S_airflow",), ("Sebastopol",), ("_",)], "c string")
    s, o = L.split_site_orientation(F.col("c"))
    s2, o2 = L.split_site_orientation(F.col("c"), strict_empty=True)
    got = [(r[0], r[1], r[2], r[3]) for r in df.select(s, o, s2, o2).collect()]
    assert got[0] == ("Sebastopol", "N-S", "Sebastopol", "N-S")
    assert got[1] == ("Sebastopol", "NA", "Sebastopol", "NA")
    assert got[2] == ("", "", "NA", "NA")


def test_slugs(spark):
    df = spark.createDataFrame([("Totem 73 boulevard de Sébastopol",), ("/data/raw/Totem Sébastopol.csv",),
                                ("  ",), ("–",)], "t string")
    out = df.select(L.slug_ascii("t").alias("a"), L.slug_label("t").alias("b"), L.slug_id("t").alias("c")).collect()
    assert out[0].b == "Totem_73_boulevard_de_Sebastopol"
    assert out[0].a == "Totem_73_boulevard_de_Sebastopol"
    assert out[1].b == "data_raw_Totem_Sebastopol_csv"
    assert out[2].a == "counter" and out[2].c == "unknown"
    assert out[3].a == "counter"   # non-ASCII removed before the regex: no "_" left


def test_label_chain(spark):
    df = spark.createDataFrame([(None, " ", "Paris"), ("short", "raw", None), (None, None, None)],
                               "a string, b string, c string")
    got = [r[0] for r in df.select(L.first_present("a", "b", "c")).collect()]
    assert got == ["Paris", "short", "NA"]


def test_path_and_uri_rules(spark):
    df = spark.createDataFrame([("data/x.csv", "s3://bucket/key"), ("/abs/x", "https://bucket/key"),
                                ("data/../x", "s3://user:pw@bucket/key"), ("file:/x", "s3://bucket/"),
                                ("", "s3:///key")], "p string, u string")
    got = [(r[0], r[1]) for r in df.select(L.local_path_error("p"), L.object_uri_error("u")).collect()]
    assert got == [(None, None), ("absolute_path", "scheme_not_s3"), ("parent_traversal", "credentials_in_uri"),
                   ("scheme_not_allowed", "missing_key"), ("empty_path", "missing_bucket")]


def test_dst_status_fixture(spark):
    rows = [("2024-03-31 01:30:00", "ok"), ("2024-03-31 02:30:00", "nonexistent"), ("2024-03-31 03:30:00", "ok"),
            ("2024-10-27 01:30:00", "ok"), ("2024-10-27 02:30:00", "ambiguous"), ("2024-10-27 03:30:00", "ok")]
    df = spark.createDataFrame(rows, "t string, expected string").withColumn(
        "t", F.col("t").cast("timestamp_ntz"))
    got = [(r.expected, r.s) for r in df.select("expected", CAL.dst_status("t").alias("s")).collect()]
    assert all(a == b for a, b in got)


def test_dst_day_slots(spark):
    rows = [("2024-03-30", 24), ("2024-03-31", 23), ("2024-10-26", 24), ("2024-10-27", 25)]
    df = spark.createDataFrame(rows, "d string, expected int")
    got = df.select("expected", CV.slots_in_local_day(F.col("d").cast("timestamp_ntz")).alias("n")).collect()
    assert all(r.expected == r.n for r in got)


def test_window_plan_fixture(spark):
    # anchor 2026-06-10, step 0.25: +0, +1, +40, +100, +400 days
    df = spark.createDataFrame([(0,), (1,), (40,), (100,), (400,)], "d int")
    s, e, p = daily_window(F.col("d"))
    got = [(r[0], r[1], r[2]) for r in df.select(s, e, p).collect()]
    assert got == [(0.0, 75.0, False), (0.25, 75.25, True), (10.0, 85.0, True), (25.0, 100.0, True),
                   (100.0, 100.0, True)]


def test_cv_fold_sizes(spark):
    df = spark.createDataFrame([("c", i) for i in range(12)], "counter_id string, ts_utc int")
    f = seq.cv_folds(df, 5)
    got = {(r.fold, r.role): r.n for r in f.groupBy("fold", "role").count().withColumnRenamed("count", "n").collect()}
    # TimeSeriesSplit(5) on 12 rows: test size 2, train 2, 4, 6, 8, 10
    assert [got[(k, "train")] for k in range(5)] == [2, 4, 6, 8, 10]
    assert all(got[(k, "test")] == 2 for k in range(5))
