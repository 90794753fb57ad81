"""Run planning (A42, A67, A68, A76): which window each counter trains on.

The scheduler in the reference runs one process per counter and day; here the
plan is a table – one row per (counter, run day) generated by exploding each
counter's own day sequence (no cross join) – and the slicing of every planned
run happens in the same plan (``sliced_by_plan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.functions.calendar import clamp_round
from hourcast.operators import sequence as seq

# Bootstrap window, daily shift (percent per day) and the
# threshold the daily window must pass to run.
BOOTSTRAP = (0.0, 75.0)
DAILY_INCREMENT_PCT = 0.25


def daily_window(delta_days: Column, step: float = DAILY_INCREMENT_PCT) -> tuple[Column, Column, Column]:
    """``shift = max(0, days*step)``, window ``[clamp(shift), clamp(75+shift)]``
    rounded to 2 digits; the run proceeds only when the end passes 75."""
    shift = F.greatest(F.lit(0.0), delta_days.cast("double") * F.lit(step))
    start = clamp_round(shift)
    end = clamp_round(F.lit(BOOTSTRAP[1]) + shift)
    return start, end, end > F.lit(BOOTSTRAP[1])


def window_plan(active: DataFrame, anchor: Column) -> DataFrame:
    """A67 + A76: init row plus one daily row per active day of every counter.

    ``active`` has ``counter_id``, ``first_day``, ``last_day`` (dates).
    """
    days = active.select("counter_id", F.explode(F.sequence("first_day", "last_day")).alias("run_day"))
    delta = F.datediff("run_day", anchor)
    start, end, proceed = daily_window(delta)
    daily = days.select("counter_id", F.lit("daily").alias("mode"), "run_day",
                        delta.alias("delta_days"), start.alias("start_pct"), end.alias("end_pct"),
                        proceed.alias("proceed"))
    init = active.select("counter_id", F.lit("init").alias("mode"), F.col("first_day").alias("run_day"),
                         F.lit(0).alias("delta_days"), F.lit(BOOTSTRAP[0]).alias("start_pct"),
                         F.lit(BOOTSTRAP[1]).alias("end_pct"), F.lit(True).alias("proceed"))
    plan = daily.unionByName(init)
    return plan.withColumn("sub_dir", F.concat(F.col("counter_id"), F.lit("_day"),
                                               F.col("delta_days").cast("string")))


def sliced_by_plan(plan: DataFrame, series: DataFrame, ts: str = "ts_utc") -> DataFrame:
    """A24 for every planned run at once.

    The slice of run r is positions ``[int(n*s/100), int(n*e/100))`` of its
    counter's series; instead of joining every run to every row (runs × rows),
    the bounds are computed from ``n`` and only the two boundary rows are
    looked up by equi-join on ``(counter, position)``.
    """
    numbered = seq.number_rows(series)
    n = numbered.groupBy("counter_id").agg(F.max("n").alias("n"))
    p = plan.filter("proceed").join(n, "counter_id")
    lo, hi = seq.percent_bounds(F.col("n"), F.col("start_pct"), F.col("end_pct"))
    p = p.withColumns({"_lo": lo, "_hi": hi})
    p = p.withColumn("n_rows", F.when((F.col("start_pct") < F.col("end_pct")) & (F.col("_hi") > F.col("_lo")),
                                      F.col("_hi") - F.col("_lo")).otherwise(F.lit(0)).cast("bigint"))
    pos = numbered.select("counter_id", F.col("rn"), F.col(ts).alias("_ts"))
    first = pos.withColumnRenamed("_ts", "first_ts").withColumnRenamed("rn", "_first_rn")
    last = pos.withColumnRenamed("_ts", "last_ts").withColumnRenamed("rn", "_last_rn")
    out = (p.withColumns({"_first_rn": F.when(F.col("n_rows") > 0, F.col("_lo") + 1),
                          "_last_rn": F.when(F.col("n_rows") > 0, F.col("_hi"))})
           .join(first, ["counter_id", "_first_rn"], "left")
           .join(last, ["counter_id", "_last_rn"], "left"))
    return out.drop("_lo", "_hi", "_first_rn", "_last_rn", "n")
