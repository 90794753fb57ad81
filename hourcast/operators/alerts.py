"""Alert rules over samples (B20–B22): held conditions, change counts and
notification throttling.

All three are order-dependent per series.  They are built from the bucketed
lag / prefix-sum helpers, aggregates with map-side combine and windows over
small per-bucket tables, so one noisy instance or alert name never lands in a
single task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourcast.functions.timecols import epoch_micros
from hourcast.session import ensure_checkpoint_dir
from hourcast.operators.asof import asof_join
from hourcast.operators.bucketed import bucketed_lag, running_aggs


def held(df: DataFrame, keys: list[str], order: list[str], bucket: str, cond: Column,
         hold_us: int) -> DataFrame:
    """Islands of consecutive samples where ``cond`` holds; an island
    fires when it lasts at least ``hold_us`` (gaps-and-islands).

    ``island`` = (running count of all samples) - (running count of true
    samples) = number of false samples before the run: constant inside a run
    of true samples and different across runs.  Both counts come from one
    bucketed prefix-sum pass; the islands are then a plain aggregate.
    """
    ts = order[0]
    c = df.withColumn("_cond", cond)
    c = running_aggs(c, keys, order, bucket, {
        "_n_all": (F.lit(1).cast("bigint"), "sum"),
        "_n_true": (F.col("_cond").cast("bigint"), "sum")})
    t = c.filter(F.col("_cond")).withColumn("island", F.col("_n_all") - F.col("_n_true"))
    span = F.max(epoch_micros(ts)) - F.min(epoch_micros(ts))
    return t.groupBy(*keys, "island").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_samples"),
        (span >= F.lit(hold_us)).alias("fired"))


def changes(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: str,
            range_steps: int) -> DataFrame:
    """``changes(value[range])`` evaluated at every non-empty bucket.

    Changes inside the range = Σ per-bucket change flags − the flag of the first
    sample in range (its predecessor lies outside the range).
    """
    c = bucketed_lag(df, keys, order, bucket, value, "_prev")
    flag = F.when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col(value)), 1).otherwise(0)
    c = c.withColumn("_flag", flag)
    per = c.groupBy(*keys, bucket).agg(
        F.sum("_flag").cast("bigint").alias("_n"),
        F.min_by("_flag", F.struct(*[F.col(o) for o in order])).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(bucket).rangeBetween(-(range_steps - 1), 0)
    return per.select(*keys, bucket,
                      (F.sum("_n").over(w) - F.first("_first").over(w)).cast("bigint").alias("changes"))


def held_steps(steps: DataFrame, keys: list[str], bucket: str, cond: Column) -> DataFrame:
    """Condition at a step held since the previous (consecutive) step."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    s = steps.withColumn("_c", cond)
    prev_c, prev_b = F.lag("_c").over(w), F.lag(bucket).over(w)
    return s.withColumn("fired", F.col("_c") & F.coalesce(prev_c, F.lit(False))
                        & (prev_b == F.col(bucket) - 1)).withColumnRenamed("_c", "condition")


BUCKET_US = 3_600_000_000  # one hour: spreads a hot alert group over its hours


def _next_event(ev: DataFrame, g: list[str]) -> DataFrame:
    """For each event, the first event of its group at or after ``ts + repeat``.

    A forward as-of join is a backward one on negated time: the latest
    ``-t_event <= -(t + repeat)`` is the earliest event at or after the target;
    ``-eid`` as tie-break keeps the smallest id among equal times.  The as-of
    operator splits every group into hour buckets (no hot task, no pairs).
    """
    targets = ev.select(*g, F.col("eid").alias("src"),
                        (-(F.col("_us") + F.col("_rep"))).alias("_neg_target"))
    events = ev.select(*g, (-F.col("_us")).alias("_neg_us"), F.col("eid").alias("nxt"),
                       (-F.col("eid")).alias("_neg_eid"))
    j = asof_join(targets, events, g, "_neg_target", "_neg_us", ["nxt"], BUCKET_US,
                  right_tie=["_neg_eid"], numeric_time=True)
    return j.select(*g, F.col("src").alias("eid"), "nxt")


def throttle(spark: SparkSession, ev: DataFrame, g: list[str], ts: str, eid: str,
             repeat_us: Column) -> DataFrame:
    """Notifications of one alert group – the first firing, then the first
    firing at least ``repeat`` after the last notification, and so on.

    The chain is a sequential fold, computed in parallel by pointer doubling.
    Seeds: every firing whose gap to the previous firing of its group is at
    least ``repeat`` is certainly notified (the last notification is no later
    than that previous firing), and so is each group's first firing.  From the
    seeds, ``S_{k+1} = S_k ∪ J_k(S_k)`` with ``J_k`` the 2^k-th successor, so
    the number of rounds is log2 of the longest seed-free stretch of the chain.
    Each round is two equi-joins; every third one is checkpointed, so a lost
    executor recomputes three rounds at most.  The loop ends when a round finds
    nothing new: the rounds are bounded by the data, never by a limit.
    """
    ensure_checkpoint_dir(spark)   # the session's shared folder; created only when unset
    # the input is read by every round: materialise it once in the checkpoint folder
    base = ev.select(*g, F.col(ts).alias("ts"), F.col(eid).cast("bigint").alias("eid"),
                     epoch_micros(ts).alias("_us"), repeat_us.cast("bigint").alias("_rep")).checkpoint()
    jump = _next_event(base, g).select("eid", "nxt").checkpoint()
    lagged = bucketed_lag(base.withColumn("_bk", F.floor(F.col("_us") / F.lit(BUCKET_US)).cast("bigint")),
                          g, ["_us", "eid"], "_bk", "_us", "_prev_us")
    seeds = lagged.filter(F.col("_prev_us").isNull()
                          | (F.col("_us") - F.col("_prev_us") >= F.col("_rep"))).select("eid")
    chosen = seeds.checkpoint()
    # keep the chosen set at a fixed partition count: a union adds the new
    # rows' partitions every round, coalesce folds them back without a shuffle
    n_parts = max(1, chosen.rdd.getNumPartitions())
    frontier = chosen
    held, k = [], -1
    while True:
        k += 1
        # nodes reached from the frontier through J_k that are not chosen yet
        new = (frontier.join(jump, "eid").select(F.col("nxt").alias("eid"))
               .filter(F.col("eid").isNotNull()).distinct()
               .join(chosen, "eid", "left_anti"))
        new = new.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(new)
        if new.isEmpty():
            break
        # every chosen node must also jump by 2^k later on; the frontier of the
        # next round is the whole chosen set (S_{k+1} = S_k ∪ J_k(S_k))
        chosen = chosen.unionByName(new).coalesce(n_parts)
        j2 = (jump.alias("a").join(jump.alias("b"), F.col("a.nxt") == F.col("b.eid"), "left")
              .select(F.col("a.eid").alias("eid"), F.col("b.nxt").alias("nxt")))
        if k % 3 == 2:  # cut lineage every few rounds in the shared checkpoint folder
            chosen, jump = chosen.checkpoint(), j2.checkpoint()
        else:
            chosen, jump = (chosen.persist(StorageLevel.MEMORY_AND_DISK),
                            j2.persist(StorageLevel.MEMORY_AND_DISK))
        frontier = chosen
    for frame in held[:-1]:
        frame.unpersist()
    out = base.join(chosen, "eid", "left_semi").select(*g, "ts", "eid")
    return out

