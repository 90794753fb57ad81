"""Exact as-of join without a nested-loop plan and without a hot task.

``asof_join(left, right, keys, left_time, right_time, ...)`` attaches to every
left row the latest right row of the same key with ``right_time <= left_time``.

Plan: both sides get a time bucket.  Inside a (key, bucket) partition the two
sides are unioned and ordered by time (right rows first on equal time), and
``last(payload, ignorenulls)`` picks the latest right row seen so far.  Left
rows whose bucket holds no earlier right row take the carry: the last right row
of any earlier bucket, found by a window over the small (key, bucket) table.
A key with a third of all rows is spread over its buckets; no pairs are formed.
Null keys match null keys: key and bucket form one struct, and structs with
equal null fields are equal.
(Spark's own ``_joinAsOf`` plans a nested-loop join.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.functions.timecols import epoch_micros


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str,
              right_time: str, right_cols: list[str], bucket_us: int,
              right_tie: list[str] | None = None, prefix: str = "",
              numeric_time: bool = False) -> DataFrame:
    """``numeric_time``: the time columns are already integers (e.g. negated
    microseconds for a forward search) instead of timestamps."""
    tie = right_tie or []
    payload_fields = [right_time, *[c for c in right_cols if c != right_time]]
    as_us = (lambda c: F.col(c).cast("bigint")) if numeric_time else epoch_micros
    lt = left.withColumns({"_t": as_us(left_time), "_kind": F.lit(1)})
    lt = lt.withColumn("_kb", F.struct(*keys, F.floor(F.col("_t") / F.lit(bucket_us)).cast("bigint").alias("_bk")))
    rt = right.select(*keys, as_us(right_time).alias("_t"),
                      F.struct(*[F.col(c).alias(c) for c in payload_fields]).alias("_payload"),
                      *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)])
    rt = rt.withColumns({"_kind": F.lit(0), "_kb": F.struct(
        *keys, F.floor(F.col("_t") / F.lit(bucket_us)).cast("bigint").alias("_bk"))})

    # 1. latest right row at or before each left row inside the same bucket
    ties = [F.col(f"_tie{i}") for i in range(len(tie))]
    w = (Window.partitionBy("_kb").orderBy("_t", "_kind", *ties)
         .rowsBetween(Window.unboundedPreceding, 0))
    unioned = lt.unionByName(rt, allowMissingColumns=True)
    within = (unioned.withColumn("_within", F.last("_payload", ignorenulls=True).over(w))
              .filter(F.col("_kind") == 1).drop("_payload", *[f"_tie{i}" for i in range(len(tie))]))

    # 2. carry: the last right row of the buckets before each one, over the
    # per-bucket aggregate of the same union (one row per key and bucket)
    last = unioned.groupBy("_kb").agg(
        F.max_by(F.when(F.col("_kind") == 0, F.col("_payload")),
                 F.when(F.col("_kind") == 0, F.struct("_t", *ties))).alias("_last"))
    wb = (Window.partitionBy(*[f"_kb.{k}" for k in keys]).orderBy("_kb._bk")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = last.select("_kb", F.last("_last", ignorenulls=True).over(wb).alias("_carry"))

    out = within.join(carry, "_kb", "left")
    hit = F.coalesce(F.col("_within"), F.col("_carry"))
    return (out.withColumns({f"{prefix}{c}": hit.getField(c) for c in payload_fields})
            .drop("_t", "_kind", "_kb", "_within", "_carry"))
