"""Every registered query against its DuckDB twin (the correctness gate),
plus the contract shape of ``__spark_entry__``."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tests.oracle import duck, rows

from hourcast.catalog import ORACLE, QUERIES  # noqa: E402  the corpus queries have tests of their own


def test_entry_smoke(spark):
    df = E.entry(spark)
    out = df.collect()
    assert len(out) > 0
    assert {"counter_id", "seasonal_rmse", "mean24_mae"} <= set(df.columns)


def test_entry_registers_everything():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_every_query_has_docstring_and_most_have_twins():
    assert len(QUERIES) >= 80
    assert set(ORACLE) <= set(QUERIES)
    assert len(ORACLE) >= len(QUERIES) - 5
    for name, fn in QUERIES.items():
        assert fn.__doc__, name


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql_twin(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    exp = con.execute(ORACLE[name]).fetchdf()
    c1, r1 = rows(got)
    c2, r2 = rows(exp)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


ZONE_SENSITIVE = ["forecast_eval", "calendar_features", "dst_quarantine", "expected_slots", "coverage_rollup",
                  "stream_hourly_counts", "step_samples", "rate_reset", "over_time", "window_plan",
                  "asof_forecast", "kpi_samples"]


@pytest.mark.parametrize("name", ZONE_SENSITIVE)
def test_results_do_not_depend_on_session_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = QUERIES[name](spark, SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert rows(got) == rows(con.execute(ORACLE[name]).fetchdf())
