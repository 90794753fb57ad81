"""Scenario fan-out (A9): one row per configured run, joined to the data so that
all scenarios execute in one plan instead of one process per scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The end-to-end scenarios of the reference (name, start %, end %),
# plus a reversed range that must yield nothing.
SCENARIOS = [("integration", 0.0, 15.0), ("day1", 0.5, 15.5), ("day2", 1.0, 15.0),
             ("reversed", 80.0, 20.0)]


def scenario_table(spark: SparkSession, rows=SCENARIOS) -> DataFrame:
    return spark.createDataFrame(rows, "scenario string, start_pct double, end_pct double")


def scenario_array(rows=SCENARIOS) -> Column:
    """The scenarios as a literal array of structs, for ``explode``."""
    return F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(a)).alias("start_pct"),
                              F.lit(float(b)).alias("end_pct")) for n, a, b in rows])
