"""Session helpers.

Every query in the package is written to be independent of the session time
zone: timestamps stay ``timestamp_ntz`` (civil UTC) end to end and all epoch
arithmetic goes through ``timestampdiff``.  The builder below is what tests and
the benchmark use; on a cluster the caller's own session is passed in instead.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans shuffles from runtime
# statistics (coalesces tiny partitions, splits skewed join partitions) and the
# broadcast threshold stays at a size we can prove for dimension-like inputs.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files of iterative rounds once their RDDs are unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "hourcast") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("HOURCAST_DRIVER_MEM", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset (local tests) do we create a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="hourcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cluster_conf(total_cores: int, checkpoint_dir: str) -> dict[str, str]:
    """Settings for a large cluster (e.g. 1000 executors reading ~100 TB).

    * Scan splits of 256 MB keep tasks large enough to amortise scheduling
      but small enough to fit executor memory.
    * Shuffle partitions start at 4x the cores; AQE coalesces them towards
      256 MB and splits skewed join partitions (a key holding a third of a
      table) into advisory-sized pieces.
    * Broadcast stays capped at 32 MB: only calendars and fixed dimensions
      are broadcast by hint, everything else by AQE's runtime statistics.
    * Iterative rounds and stream state go to the shared ``checkpoint_dir``.
    """
    return {
        **{k: v for k, v in BASE_CONF.items() if k != "spark.ui.enabled"},
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.shuffle.partitions": str(4 * total_cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
        "spark.checkpoint.dir": checkpoint_dir,
    }
