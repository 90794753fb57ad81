"""Small operators without a registered query: typed column split, history
gate, manifest projection, column drops, schema contract and the sinks."""

import json
import os

from pyspark.sql import functions as F

from hourcast.operators import ledger as LG
from hourcast.operators import model as MD
from hourcast.operators import validate as V
from hourcast.sources import files as FS
from hourcast.sources import sinks as SK
from hourcast.sources.tables import counts
from tests.conftest import SMALL


def test_typed_columns_ignore_bool_and_time(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "a int, b double, c string, d boolean") \
        .withColumn("t", F.current_timestamp())
    assert MD.typed_columns(df, exclude=["a"]) == (["b"], ["c"])


def test_history_gate(spark):
    df = spark.createDataFrame([("x", 1)] * 30 + [("y", 2)] * 5, "k string, y int")
    got = {r.k: r.reject_reason for r in MD.history_gate(df, ["k"], "y", 7, 1, 24).collect()}
    assert got == {"x": None, "y": "insufficient_history"}


def test_manifest_metadata_projection(spark):
    from hourcast.catalog.artifacts import artifact_metadata
    m = artifact_metadata(spark, SMALL)
    assert m.columns == ["counter_id", "run_id", "artifact_type", "status", "created_at", "producer_service",
                         "producer_image", "producer_version", "source", "primary_backend", "local_path",
                         "object_uri", "checksum_sha256"]
    r = m.first()
    assert json.loads(r.source)["raw_file_name"] == "events.parquet" and len(r.checksum_sha256) == 64


def test_outcome_codes_of_calls_and_reports(spark):
    rows = [("models", 503, False), ("models", 404, False), ("models", 200, False), ("models", 302, False),
            ("models", None, False), ("models", 200, True), ("metrics", 200, False), (None, 200, False)]
    df = spark.createDataFrame(rows, "job_type string, status int, timed_out boolean")
    code, _, retry = LG.outcome(F.col("status"), F.col("timed_out"), F.col("job_type"))
    got = [tuple(r) for r in df.select(code, retry).collect()]
    assert got == [("ML_SERVICE_HTTP_ERROR", True), ("ML_SERVICE_HTTP_ERROR", False), (None, None),
                   ("ML_SERVICE_INVALID_RESPONSE", True), ("ML_SERVICE_UNAVAILABLE", True), ("ML_SERVICE_UNAVAILABLE", True),
                   ("UNSUPPORTED_JOB_TYPE", False), ("UNSUPPORTED_JOB_TYPE", False)]
    said = spark.createDataFrame([("succeeded", None, None), ("failed", "MODELS_JOB_FAILED", False), ("failed", None, None)],
                                 "state string, code string, retry boolean")
    assert [tuple(r) for r in said.select(*LG.reported_outcome(F.col("state"), F.col("code"), F.col("retry"))).collect()] == [
        (None, None), ("MODELS_JOB_FAILED", False), ("ML_SERVICE_JOB_FAILED", True)]


def test_manifest_and_request_nulls_are_violations(spark):
    from hourcast.catalog.ledgers import manifest_violations
    names = ("schema_version artifact_type status run_id counter_id producer_service created_at raw_file_name "
             "checksum_sha256 local_path object_uri primary_backend").split()
    df = spark.createDataFrame([tuple([None] * len(names))], ", ".join(f"{n} string" for n in names))
    assert df.select(manifest_violations(df)).first()[0] == [
        "schema_version", "artifact_type", "status", "run_id", "counter_id", "producer", "created_at", "lineage",
        "checksum", "backend_reference"]


def test_null_keys_are_values_in_bucketed_operators(spark):
    from hourcast.operators.asof import asof_join
    from hourcast.operators.bucketed import bucketed_lag, running_sum
    rows = [(None, 1, 0), (None, 2, 0), (None, 5, 1), ("a", 1, 0), ("a", 9, None), (None, 7, None)]
    df = spark.createDataFrame(rows, "k string, t int, b int")
    lagged = {(r.k, r.t): r.p for r in bucketed_lag(df, ["k"], ["t"], "b", "t", "p").collect()}
    assert lagged[None, 2] == 1 and lagged[None, 5] == 2 and len(lagged) == 6
    sums = {(r.k, r.t): r.s for r in running_sum(df, ["k"], ["t"], "b", "t", "s").collect()}
    assert sums[None, 5] == 8 + 7 and len(sums) == 6  # a null bucket sorts first
    left = spark.createDataFrame([(None, 10), (None, 25), ("a", 10)], "k string, lt bigint")
    right = spark.createDataFrame([(None, 3, "x"), ("a", 12, "y")], "k string, rt bigint, v string")
    got = {(r.k, r.lt): r.v for r in asof_join(left, right, ["k"], "lt", "rt", ["v"], 10, numeric_time=True).collect()}
    assert got == {(None, 10): "x", (None, 25): "x", ("a", 10): None}


def test_checksums_tell_nulls_apart_and_do_not_overflow(spark):
    from hourcast.operators import canonical as C
    a = spark.createDataFrame([("x", None, "y")], "a string, b string, c string")
    b = spark.createDataFrame([("x", "y", None)], "a string, b string, c string")
    one, two = (f.select(C.row_digest("a", "b", "c")).first()[0] for f in (a, b))
    assert one != two
    big = spark.range(5).withColumn("d", F.lit(9 * 10**18).cast("decimal(20,0)"))
    assert C.evidence(big, [], "id", F.col("d")).first().checksum == str(45 * 10**18)


def test_means_use_the_stored_values(spark):
    import datetime as dt
    from hourcast.operators import metrics as M
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("j", t, 1, 0.004), ("j", t, 2, 0.0049)], "job string, ts timestamp_ntz, event_id int, value double")
    assert abs(M.over_time(df, ["job"], "value", ["ts", "event_id"], 6).first().avg_over_time - 0.00445) < 1e-12


def test_drop_listed_and_schema_contract(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "comptage_horaire int, rain_mm double, extra string")
    assert FS.drop_listed(df, ["extra"]).columns == ["comptage_horaire"]
    contract = [("comptage_horaire", "bigint", True), ("date_et_heure_de_comptage", "string", True),
                ("rain_mm", "double", False)]
    assert V.schema_diff(df, contract) == [("comptage_horaire", "block:type"),
                                           ("date_et_heure_de_comptage", "block:missing"),
                                           ("extra", "warning:extra")]


def test_sinks(spark, scratch):
    from hourcast.catalog.models import y_full_linear_df
    yf = y_full_linear_df(spark, SMALL)
    SK.write_evaluation(yf, os.path.join(scratch, "eval"))
    back = spark.read.parquet(os.path.join(scratch, "eval"))
    assert set(r.split for r in back.select("split").distinct().collect()) == {"train", "test"}
    assert back.count() == yf.count()
    params = spark.createDataFrame([("c", "ar", 7.0)], "counter_id string, key string, value double")
    SK.write_model_rows(params, params, os.path.join(scratch, "model"))
    SK.write_model_rows(params, params, os.path.join(scratch, "model"))
    assert spark.read.parquet(os.path.join(scratch, "model", "params")).count() == 2
    samples = counts(spark, SMALL).select("counter_id", F.lit("bike_obs").alias("metric"),
                                          F.col("hourly_count").cast("double").alias("value"))
    SK.append_samples(samples, os.path.join(scratch, "metrics"))
    assert spark.read.parquet(os.path.join(scratch, "metrics")).count() == samples.count()
