"""Order-dependent series operators that stay parallel inside one hot series.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends a whole series to one
task; a single series may carry a third of all rows.  The helpers here add a
time bucket to the partition key and repair the bucket boundaries with a small
per-(series, bucket) table:

* ``bucketed_lag``   – previous value in series order;
* ``running_sum``    – inclusive prefix sum in series order.

The per-bucket table has one row per series and bucket (e.g. per hour), so the
window over it is tiny and the join back is a broadcast or a cheap shuffle.

Null keys and null buckets are values like any other: rows are partitioned and
joined by one struct of keys and bucket, and structs with equal null fields are
equal, so the join loses no row and needs no exchange beyond the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def bucketed_lag(df: DataFrame, keys: list[str], order: list[str], bucket: str,
                 value: str, name: str, reverse: bool = False) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` split by bucket;
    ``reverse`` gives ``lead`` (next value in series order)."""
    cols = _cols(order)
    df = df.withColumn("_kb", F.struct(*keys, bucket))
    inner = Window.partitionBy("_kb").orderBy(*([c.desc() for c in cols] if reverse else cols))
    tagged = df.withColumns({"_prev_in": F.lag(value).over(inner),
                             "_first_in": F.row_number().over(inner) == 1})
    pick = F.min_by if reverse else F.max_by
    last = (df.groupBy("_kb").agg(pick(F.col(value), F.struct(*cols)).alias("_last")))
    at = F.col(f"_kb.{bucket}")
    bw = Window.partitionBy(*[f"_kb.{k}" for k in keys]).orderBy(at.desc() if reverse else at)
    carry = last.withColumn("_carry", F.lag("_last").over(bw)).drop("_last")
    return (tagged.join(carry, "_kb", "inner")
            .withColumn(name, F.when(F.col("_first_in"), F.col("_carry")).otherwise(F.col("_prev_in")))
            .drop("_prev_in", "_first_in", "_carry", "_kb"))


def running_aggs(df: DataFrame, keys: list[str], order: list[str], bucket: str,
                 specs: dict[str, tuple[Column, str]], exclusive: bool = False) -> DataFrame:
    """Several running ``sum``/``max`` columns in series order in one pass.

    ``specs`` maps output name -> (value column, "sum" | "max").  Per-bucket
    totals become offsets through one window over the small bucket table, one
    join brings them back, and one window inside (key, bucket) finishes every
    column.  ``exclusive`` leaves the current row out.
    """
    fns = {"sum": F.sum, "max": F.max}
    base = df.withColumns({"_kb": F.struct(*keys, bucket), **{f"_v_{n}": v for n, (v, _) in specs.items()}})
    over_buckets = (Window.partitionBy(*[f"_kb.{k}" for k in keys]).orderBy(f"_kb.{bucket}")
                    .rowsBetween(Window.unboundedPreceding, -1))
    per_bucket = base.groupBy("_kb").agg(
        *[fns[a](f"_v_{n}").alias(f"_s_{n}") for n, (_, a) in specs.items()])
    per_bucket = per_bucket.select("_kb", *[
        (F.coalesce(fns[a](f"_s_{n}").over(over_buckets), F.lit(0)) if a == "sum"
         else fns[a](f"_s_{n}").over(over_buckets)).alias(f"_o_{n}") for n, (_, a) in specs.items()])
    inner = (Window.partitionBy("_kb").orderBy(*_cols(order))
             .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    out = {}
    for n, (_, a) in specs.items():
        within = fns[a](f"_v_{n}").over(inner)
        out[n] = (F.coalesce(within, F.lit(0)) + F.col(f"_o_{n}") if a == "sum"
                  else F.greatest(within, F.col(f"_o_{n}")))  # greatest skips nulls
    drop = ["_kb"] + [f"_v_{n}" for n in specs] + [f"_o_{n}" for n in specs]
    return base.join(per_bucket, "_kb", "inner").withColumns(out).drop(*drop)


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: str,
                value: str | Column, name: str, agg: str = "sum",
                exclusive: bool = False) -> DataFrame:
    """One running ``sum`` (or ``max``) column; see ``running_aggs``."""
    v = F.col(value) if isinstance(value, str) else value
    return running_aggs(df, keys, order, bucket, {name: (v, agg)}, exclusive)


def running_count(df: DataFrame, keys: list[str], order: list[str], bucket: str,
                  name: str) -> DataFrame:
    """``count(*) over (partition by keys order by order)`` (unique order)."""
    return running_sum(df, keys, order, bucket, F.lit(1).cast("bigint"), name)
