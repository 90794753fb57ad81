"""Structured Streaming versions of the continuous operators.

Each stream has a batch twin in the catalog; tests run them with
``trigger(availableNow=True)`` on the same files and compare.  Checkpoints go
under the session's ``spark.checkpoint.dir`` (shared storage on a cluster),
never a machine-local folder.  State uses the RocksDB provider, so state size
is bounded by disk, not executor heap.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hourcast.functions.timecols import epoch_micros, hour_floor
from hourcast.operators import canonical as C

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def checkpoint_path(spark: SparkSession, name: str, run: str | None = None) -> str:
    """Folder of a stream's state and output.  A caller that gives ``run``
    resumes the run of that name; without one, each call is a run of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a shared folder for stream checkpoints")
    return os.path.join(base, "streams", f"{name}-{run or uuid.uuid4().hex[:8]}")


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The ``events`` table (one file or a folder of part files) as a file
    stream; ``ts`` becomes an instant (``withWatermark`` rejects
    ``timestamp_ntz``).  All files there form one micro-batch unless the caller
    caps them; a cap lets file order decide which rows are late."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a pattern, as a plain path to a single file is refused (its base must be a folder)
    s = reader.parquet(os.path.join(sf_dir, "events.parque[t]"))
    return s.withColumn("ts_i", F.timestamp_micros(epoch_micros("ts")))


def counter_col() -> F.Column:
    return F.concat_ws("_", "event_type", F.when(F.col("user_id") % 2 == 0, "N-S").otherwise("S-N"))


def hourly_counts(stream: DataFrame, lookback: str = "2 hours") -> DataFrame:
    """Tumbling hourly counts per counter; rows later than the lookback
    behind the watermark are dropped, windows are emitted once (append)."""
    return (stream.withWatermark("ts_i", lookback)
            .groupBy(F.window("ts_i", "1 hour").alias("w"), counter_col().alias("counter_id"))
            .agg(F.count(F.lit(1)).alias("hourly_count"))
            .select("counter_id", F.col("w.start").alias("window_start"), "hourly_count"))


def sliding_means(stream: DataFrame, lookback: str = "2 hours") -> DataFrame:
    """1 h windows sliding every 5 min, mean value and up-ratio per job.

    Samples are summed once per 5-minute pane; a pane, not a sample, goes to the
    twelve windows that hold it.
    """
    up = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
    panes = (stream.withWatermark("ts_i", lookback)
             .groupBy(F.window("ts_i", "5 minutes").alias("pane"), F.col("event_type").alias("job"))
             .agg(F.sum("value").alias("v"), F.count("value").alias("nv"), F.sum(up).alias("u"), F.count(F.lit(1)).alias("n")))
    return (panes.groupBy(F.window(F.window_time("pane"), "1 hour", "5 minutes").alias("w"), "job")
            .agg((F.sum("v") / F.sum("nv")).alias("mean_value"), (F.sum("u") / F.sum("n") * 100).alias("availability_pct"),
                 F.sum("n").alias("n_samples"))
            .select("job", F.col("w.start").alias("window_start"), "mean_value", "availability_pct", "n_samples"))


def idempotent_submits(stream: DataFrame, lookback: str = "2 hours") -> DataFrame:
    """S3: the first submission, by time and id, of each idempotency key.

    Keys are day-scoped, so a key's submissions share one day window; the
    minimum inside it does not depend on arrival order (a deduplication that
    keeps whichever row arrives first would)."""
    key = F.concat_ws("|", F.col("event_type"), F.date_format("ts", "yyyyMMdd"),
                      (F.col("user_id") % 20).cast("string"))
    return (stream.withColumn("idem_key", key).withWatermark("ts_i", lookback)
            .groupBy(F.window("ts_i", "1 day").alias("w"), "idem_key")
            .agg(F.min(F.struct("ts", "event_id")).alias("first"), F.count(F.lit(1)).alias("n_submissions"))
            .select("idem_key", "first.event_id", "first.ts", "n_submissions"))


HELD_OUT = T.StructType([T.StructField("instance", T.IntegerType()),
                         T.StructField("start_ts", T.TimestampNTZType()),
                         T.StructField("end_ts", T.TimestampNTZType()),
                         T.StructField("n_samples", T.LongType()),
                         T.StructField("fired", T.BooleanType())])
HELD_STATE = T.StructType([T.StructField("open", T.BooleanType()),
                           T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()),
                           T.StructField("n", T.LongType()),
                           T.StructField("us", T.ArrayType(T.LongType())),
                           T.StructField("ids", T.ArrayType(T.LongType())),
                           T.StructField("down", T.ArrayType(T.BooleanType()))])


def islands(us: np.ndarray, down: np.ndarray, carried: tuple[int, int, int] | None):
    """Closed runs of ``down`` samples as (starts, ends, sizes), and the run still open.

    ``carried`` is the open run (start, end, size) that the samples continue.
    """
    if carried:  # put it in front as one sample, and give it its size back below
        us, down = np.append(carried[0], us), np.append(True, down)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], down.astype(np.int8), [0]])))
    first, last = edge[0::2], edge[1::2] - 1
    start, end, size = us[first], us[last], last - first + 1
    if carried:
        size[0] += carried[2] - 1
        end[0] = max(end[0], carried[1])
    if len(last) and last[-1] == len(us) - 1:
        return start[:-1], end[:-1], size[:-1], (int(start[-1]), int(end[-1]), int(size[-1]))
    return start, end, size, None


def held_alert_state(hold_us: int):
    """Per-instance state machine for ``up == 0`` held ``hold_us``.

    Samples wait in the state until the watermark has passed them and are then
    worked off in (time, id) order, so the order of files and batches does not
    matter inside the lookback.  A closed island is emitted when the condition
    turns false.  Samples that come later than the lookback never reach the
    state; ``finish`` counts them and raises.
    """
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        (instance,) = key
        is_open, start, end, n, us, ids, down = state.get if state.exists else (False, 0, 0, 0, [], [], [])
        us, ids, down = (np.array(x, t) for x, t in ((us, np.int64), (ids, np.int64), (down, bool)))
        if not state.hasTimedOut:
            batch = pd.concat(list(pdfs), ignore_index=True)
            us = np.append(us, batch["ts"].astype("datetime64[us]").astype("int64").to_numpy())
            ids = np.append(ids, batch["event_id"].to_numpy(np.int64))
            down = np.append(down, (batch["event_type"] == "error").to_numpy(bool))
        passed = state.getCurrentWatermarkMs() * 1000
        order = np.lexsort((ids, us))
        us, ids, down = us[order], ids[order], down[order]
        cut = int(np.searchsorted(us, passed, side="right"))
        starts, ends, sizes, still = islands(us[:cut], down[:cut], (start, end, n) if is_open else None)
        us, ids, down = us[cut:], ids[cut:], down[cut:]
        state.update((still is not None, *(still or (0, 0, 0)), us.tolist(), ids.tolist(), down.tolist()))
        if len(us):
            state.setTimeoutTimestamp(max(int(us[0]) // 1000, passed // 1000) + 1)
        if len(starts):
            yield pd.DataFrame({"instance": instance, "start_ts": pd.to_datetime(starts, unit="us"),
                                "end_ts": pd.to_datetime(ends, unit="us"), "n_samples": sizes,
                                "fired": ends - starts >= hold_us})
    return fn


def held_alerts(stream: DataFrame, hold_us: int, lookback: str = "0 seconds") -> DataFrame:
    """S4 over all instances; a sample counts once it is ``lookback`` behind the latest one."""
    s = stream.withWatermark("ts_i", lookback).withColumn("instance", (F.col("user_id") % 5).cast("int"))
    return s.groupBy("instance").applyInPandasWithState(
        held_alert_state(hold_us), HELD_OUT, HELD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


RUN_OUT = T.StructType([T.StructField("instance", T.IntegerType()), T.StructField("bucket", T.LongType()),
                        T.StructField("first_down", T.BooleanType()),
                        T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()),
                        T.StructField("n", T.LongType()),
                        T.StructField("at_start", T.BooleanType()), T.StructField("at_end", T.BooleanType())])
RUN_STATE = T.StructType([T.StructField("seen", T.BooleanType()), T.StructField("leads", T.BooleanType()), *HELD_STATE.fields])


def bucket_runs_state(bucket_us: int):
    """S4, first step: the ``down`` runs of one instance and time bucket.

    The state holds one bucket's samples until the watermark has passed them and
    ends with its bucket.  Emitted are a row that says how the bucket begins
    (``first_down``), each run that closes inside, and at the bucket's end the run
    still open there (``at_end``).
    """
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        instance, bucket = (None if k is None else int(k) for k in key)
        seen, leads, is_open, start, end, n, us, ids, down = state.get if state.exists else (False, False, False, 0, 0, 0, [], [], [])
        us, ids, down = (np.array(x, t) for x, t in ((us, np.int64), (ids, np.int64), (down, bool)))
        if not state.hasTimedOut:
            for batch in pdfs:
                us = np.append(us, batch["ts"].astype("datetime64[us]").astype("int64").to_numpy())
                ids = np.append(ids, batch["event_id"].to_numpy(np.int64))
                down = np.append(down, (batch["event_type"] == "error").to_numpy(bool))
        passed, stop = state.getCurrentWatermarkMs() * 1000, (bucket + 1) * bucket_us
        order = np.lexsort((ids, us))
        us, ids, down = us[order], ids[order], down[order]
        cut = int(np.searchsorted(us, passed, side="right"))
        rows = []
        if cut and not seen:
            seen, leads = True, bool(down[0])
            rows.append((instance, bucket, leads, None, None, None, None, None))
        starts, ends, sizes, still = islands(us[:cut], down[:cut], (start, end, n) if is_open else None)
        for a, b, m in zip(starts.tolist(), ends.tolist(), sizes.tolist()):
            rows.append((instance, bucket, None, a, b, m, leads, False))
            leads = False  # only the first run can begin the bucket
        if cut and not len(starts) and still is None:
            leads = False
        us, ids, down = us[cut:], ids[cut:], down[cut:]
        if passed >= stop and not len(us):
            if still is not None:
                rows.append((instance, bucket, None, *still, leads, True))
            state.remove()
        else:
            state.update((seen, leads, still is not None, *(still or (0, 0, 0)), us.tolist(), ids.tolist(), down.tolist()))
            due = int(us[0]) // 1000 if len(us) else stop // 1000
            state.setTimeoutTimestamp(max(due, passed // 1000) + 1)
        if rows:
            yield pd.DataFrame(rows, columns=RUN_OUT.fieldNames()).astype({"start_us": "Int64", "end_us": "Int64", "n": "Int64"})
    return fn


def bucket_runs(stream: DataFrame, lookback: str = "0 seconds", bucket_us: int = 21_600_000_000) -> DataFrame:
    """S4, first step, over all (instance, time bucket) keys."""
    s = stream.filter("ts IS NOT NULL").withWatermark("ts_i", lookback).select(
        (F.col("user_id") % 5).cast("int").alias("instance"), F.floor(epoch_micros("ts") / bucket_us).alias("bucket"), "ts", "event_id", "event_type", "ts_i")
    return s.groupBy("instance", "bucket").applyInPandasWithState(
        bucket_runs_state(bucket_us), RUN_OUT, RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def join_runs(rows: DataFrame, hold_us: int) -> DataFrame:
    """S4, second step: runs that meet at bucket edges joined; the islands that have closed.

    Only the runs at edges, two a bucket at most, go through a window per instance.
    """
    by_bucket = Window.partitionBy("instance").orderBy("bucket")
    firsts = rows.filter("first_down IS NOT NULL").select(
        "instance", "bucket", F.lead("bucket").over(by_bucket).alias("next_bucket"), F.lead("first_down").over(by_bucket).alias("next_down"))
    runs = rows.filter("n IS NOT NULL").drop("first_down").join(firsts, ["instance", "bucket"], "left")
    inner = runs.filter("NOT at_start AND NOT at_end").select("instance", "start_us", "end_us", "n")
    w = Window.partitionBy("instance").orderBy("bucket", "start_us")
    before = F.lag(F.struct("at_end", "next_bucket")).over(w)
    edge = runs.filter("at_start OR at_end").withColumn("goes_on", F.coalesce(
        F.col("at_start") & before["at_end"] & (before["next_bucket"] == F.col("bucket")), F.lit(False)))
    edge = edge.withColumn("island", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w))
    whole = edge.groupBy("instance", "island").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"),
        F.max_by(~F.col("at_end") | ~F.coalesce(F.col("next_down"), F.lit(True)), F.struct("bucket", "start_us")).alias("closed"))
    found = inner.unionByName(whole.filter("closed").drop("island", "closed"))

    def time(c):
        return F.timestamp_add("MICROSECOND", F.col(c), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))

    return found.select("instance", time("start_us").alias("start_ts"), time("end_us").alias("end_ts"), F.col("n").alias("n_samples"),
                        (F.col("end_us") - F.col("start_us") >= hold_us).alias("fired"))


JOB_OUT = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("event_id", T.LongType()),
                        T.StructField("previous_state", T.StringType()), T.StructField("state", T.StringType()),
                        T.StructField("updated_at", T.TimestampNTZType()), T.StructField("seq_no", T.LongType())])


def job_state_processor():
    """Per-job state machine as a ``StatefulProcessor``.

    State (one value per job): last state, last ``updated_at`` (the stored
    time never goes backwards: ``max(now, previous)``) and the transition
    count.  Every input transition is emitted with its predecessor.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class JobStates(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState(
                "last", "state STRING, updated_us LONG, n LONG")

        def handleInputRows(self, key, rows, timerValues):
            (job_id,) = key
            batch = pd.concat(list(rows), ignore_index=True)
            us = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            batch = batch.assign(_us=us).sort_values(["_us", "event_id"])
            if self.last.exists():
                prev_state, prev_us, n = self.last.get()
            else:
                prev_state, prev_us, n = None, None, 0
            # vectorised over the batch: monotone time = running max seeded with
            # the stored time; predecessor = previous row, the stored state first
            upd = batch["_us"].cummax()
            if prev_us is not None:
                upd = upd.clip(lower=prev_us)
            prev_states = batch["state"].shift(1).astype(object)
            prev_states.iloc[0] = prev_state
            frame = pd.DataFrame({
                "job_id": job_id, "event_id": batch["event_id"].astype("int64").to_numpy(),
                "previous_state": prev_states.to_numpy(), "state": batch["state"].to_numpy(),
                "updated_at": pd.to_datetime(upd.to_numpy(), unit="us"),
                "seq_no": n + 1 + pd.RangeIndex(len(batch)).to_numpy()})
            self.last.update((batch["state"].iloc[-1], int(upd.iloc[-1]), int(n + len(batch))))
            yield frame

        def close(self) -> None:
            pass

    return JobStates()


def job_states(stream: DataFrame) -> DataFrame:
    state = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running")
             .when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed")
             .otherwise("pending"))
    s = stream.select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
                      "event_id", state.alias("state"), "ts")
    return s.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=job_state_processor(), outputStructType=JOB_OUT, outputMode="Append", timeMode="None")


def correction_sink(target: str):
    """``foreachBatch`` that appends each micro-batch of events to the
    revision ledger at ``target`` as rows (counter, hour, snapshot, count).

    The ledger is partitioned by ``batch_id`` and a batch overwrites only its
    own partition: replays are idempotent and the work of a batch is its own
    size, whatever the history.  Selection happens at read time.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rev = (batch.select(counter_col().alias("counter_id"), hour_floor("ts").alias("ts_utc"),
                            ((F.col("user_id") % 3) + 1).cast("int").alias("snapshot_no"))
               .groupBy("counter_id", "ts_utc", "snapshot_no").agg(F.count(F.lit(1)).alias("hourly_count"))
               .withColumn("batch_id", F.lit(batch_id).cast("bigint")))
        C.write_canonical(rev, target, ("batch_id",))
    return write


LEDGER_SCHEMA = "counter_id string, ts_utc timestamp_ntz, snapshot_no int, hourly_count bigint, batch_id bigint"


def run_corrections(spark: SparkSession, sf_dir: str, run: str | None = None,
                    timeout_s: float | None = None) -> DataFrame:
    """Drive S5 over the events files; returns the canonical revision ledger."""
    base = checkpoint_path(spark, "s5_corrections", run)
    target = os.path.join(base, "canonical")
    writer = (events_stream(spark, sf_dir).writeStream.queryName(f"s5_{uuid.uuid4().hex[:6]}")
              .option("checkpointLocation", os.path.join(base, "state"))
              .foreachBatch(correction_sink(target)).trigger(availableNow=True))
    finish(start_with_state_partitions(spark, writer), timeout_s)
    return (spark.read.schema(LEDGER_SCHEMA).parquet(target).groupBy("counter_id", "ts_utc", "snapshot_no")
            .agg(F.sum("hourly_count").cast("bigint").alias("hourly_count")))


def finish(query, timeout_s: float | None = None, allow_late: bool = False) -> int:
    """Wait until the stream has worked off everything; the number of late rows.

    Only a caller's own ``timeout_s`` ends it earlier, and that raises.  Rows
    that came after the watermark had passed them are dropped by the stateful
    operators; that raises, too, unless the caller allows it."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream {query.name} did not finish in {timeout_s}s")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
    if late and not allow_late:
        raise RuntimeError(f"stream {query.name} dropped {late} late rows: widen its lookback or allow them")
    return late


def state_partitions(spark: SparkSession) -> int:
    """One state-store partition per core of the cluster (every shuffle
    partition of a stateful stream carries a state store)."""
    return max(4, spark.sparkContext.defaultParallelism)


def start_with_state_partitions(spark: SparkSession, writer):
    """Start a stream with ``state_partitions`` shuffle partitions.  The
    stream clones the session conf at start (and then keeps it in its
    checkpoint), so the caller's setting is restored right after."""
    conf = {"spark.sql.shuffle.partitions": str(state_partitions(spark)),
            "spark.sql.streaming.numRecentProgressUpdates": "100000",  # late rows are counted over all batches
            # transformWithState needs the RocksDB state store
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_to_table(df: DataFrame, name: str, run: str | None = None,
                 timeout_s: float | None = None) -> DataFrame:
    """Run a stream to completion (``availableNow``) into a Parquet table in
    the shared checkpoint folder and return that table as a batch DataFrame.
    Results never pass through the driver (no memory sink)."""
    spark = df.sparkSession
    base = checkpoint_path(spark, name, run)
    writer = (df.writeStream.queryName(f"{name}_{uuid.uuid4().hex[:6]}").outputMode("append")
              .format("parquet").option("path", os.path.join(base, "out"))
              .option("checkpointLocation", os.path.join(base, "state"))
              .trigger(availableNow=True))
    finish(start_with_state_partitions(spark, writer), timeout_s)
    return spark.read.schema(df.schema).parquet(os.path.join(base, "out"))
