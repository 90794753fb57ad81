"""Plan properties that matter at scale, checked on every registered query:
no cartesian / nested-loop joins, no row-at-a-time Python UDFs, pruned and
pushed-down scans where the query allows it."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

from hourcast.catalog import QUERIES  # noqa: E402  the corpus queries have tests of their own
# these run iterative rounds or a stream while building (actions inside)
EAGER = {"alert_throttle", "gbt_scoring", "gbt_forecast", "stream_hourly_counts", "stream_sliding_means",
         "stream_submit_keys", "stream_held_alerts", "stream_corrections"}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairs_no_row_udfs(spark, name):
    text = plan_text(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text          # row-at-a-time Python UDF


def test_flagship_scan_is_pruned(spark):
    text = E.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_time_range_reaches_the_scan(spark):
    text = plan_text(QUERIES["range_extract"](spark, SMALL))
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text
    assert "In(event_" in text


def test_flagship_has_two_exchanges(spark):
    """Partial aggregate -> shuffle of counter-hours -> one shuffle for the
    shared window spec (all lags / means / row numbers in one Window)."""
    text = E.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Window [") == 1


def test_cluster_conf_is_runtime_applicable(spark):
    from hourcast.session import cluster_conf
    conf = cluster_conf(8000, "/tmp/ckpt")
    assert conf["spark.sql.shuffle.partitions"] == "32000"
    for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        old = spark.conf.get(key)
        spark.conf.set(key, conf[key])
        spark.conf.set(key, old)


@pytest.mark.parametrize("name", ["sliced_by_plan", "window_plan", "y_full_linear", "ridge_forecast",
                                  "manifest_build", "standardized_features", "cutoff_filter"])
def test_multi_branch_queries_read_raw_data_once(spark, name):
    """Derived tables read by several branches are materialised once (the
    raw scan happens inside ``materialize``), so the returned plan itself
    holds no further raw Parquet scan."""
    text = plan_text(QUERIES[name](spark, SMALL))
    assert text.count("FileScan parquet") == 0, text
