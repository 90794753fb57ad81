"""Sinks (A92–A96): datasets, evaluation outputs, model artefacts and metric
samples.  Writes are partitioned by counter and use dynamic partition
overwrite, so a rerun replaces exactly the counters it recomputed and a
failed task is retried without leaving partial partitions (Spark's commit
protocol)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: tuple[str, ...] = ("counter_id",)) -> None:
    """Interim or feature dataset, one directory per counter."""
    w = (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_evaluation(y_full: DataFrame, path: str) -> None:
    """The nine reference CSVs as one wide table with a ``split`` column."""
    out = y_full.withColumn("split", F.when(F.col("forecast_mode"), "test").otherwise("train"))
    write_dataset(out, path, partition_by=("counter_id", "split"))


#: The nine outputs of an evaluation: (name, split that it is cut from, columns besides the key and row number).
OUTPUTS = (("X_train", "train", "features"), ("X_test", "test", "features"), ("X_train_dates", "train", "dates"),
           ("X_test_dates", "test", "dates"), ("y_train", "train", "truth"), ("y_test", "test", "truth"),
           ("y_train_pred", "train", "prediction"), ("y_test_pred", "test", "prediction"), ("y_full", None, "full"))


def write_outputs(evaluated: DataFrame, path: str, train_features: list[str], test_features: list[str], key: str = "counter_id",
                  date: str = "ts_local", predicted: str = "comptage_horaire_predit") -> None:
    """The nine outputs as CSV datasets, one folder per key, numbered from 0 in time order.

    ``evaluated(key, date, y_true, y_pred, forecast_mode, features)`` should be a
    stored table: each output is cut from it.  Test rows have no lagged features,
    as those of a recursive forecast are not known beforehand.
    """
    split = F.when(F.col("forecast_mode"), "test").otherwise("train")
    in_split, whole = (Window.partitionBy(*k).orderBy(date) for k in ((key, "forecast_mode"), (key,)))
    rows = evaluated.withColumns({"_split": split, "row": F.row_number().over(in_split) - 1, "_row": F.row_number().over(whole) - 1})
    columns = {"dates": [F.col(date)], "truth": [F.col("y_true")], "prediction": [F.col("y_pred").alias(predicted)],
               "full": [F.col(date), F.col("y_true"), F.col("y_pred"), F.col("forecast_mode")]}
    for name, part, kind in OUTPUTS:
        chosen = [F.col(c) for c in (train_features if part == "train" else test_features)] if kind == "features" else columns[kind]
        own = rows if part is None else rows.filter(F.col("_split") == part)
        write_dataset(own.select(key, F.col("_row" if part is None else "row").alias("row"), *chosen), f"{path}/{name}", "csv", (key,))


def save_model(path: str, tables: dict[str, DataFrame]) -> int:
    """One new version of a model: its tables, then a marker row that names them.

    A version without its marker was never finished and is never loaded; an
    older version stays as it was.  Returns the version's number.
    """
    spark = next(iter(tables.values())).sparkSession
    version = (latest_version(spark, path) or 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    marker = spark.range(1).select(F.lit(version).alias("saved"), F.array(*[F.lit(n) for n in tables]).alias("tables"))
    marker.coalesce(1).write.mode("overwrite").parquet(f"{path}/saved/number={version}")
    return version


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest finished version, or None if there is none."""
    try:
        return spark.read.schema("saved int").parquet(f"{path}/saved").agg(F.max("saved")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_model(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a finished version (the newest, if none is named)."""
    version = latest_version(spark, path) if version is None else version
    marker = None if version is None else spark.read.parquet(f"{path}/saved").filter(F.col("saved") == version).first()
    if marker is None:
        raise ValueError(f"no saved model version {version} under {path}")
    return {name: spark.read.parquet(f"{path}/version={version}/{name}") for name in marker.tables}


def write_model_rows(params: DataFrame, metrics: DataFrame, path: str) -> None:
    """Parameters and metrics of every run as rows (flattened keys)."""
    params.write.mode("append").parquet(f"{path}/params")
    metrics.write.mode("append").parquet(f"{path}/metrics")


ROUTES = ("accepted", "warned", "quarantined")


def write_routed(df: DataFrame, path: str, batch: str) -> dict[str, int]:
    """C3 + C22: the accepted, warned and quarantined rows of a batch, one table each, by one job.

    ``df`` has ``route`` and its reasons.  The counts that the evidence row holds are
    observed while the rows are written; the evidence is written last and makes
    the batch visible.  A rerun of a batch replaces its rows.
    """
    spark = df.sparkSession
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("route") == r, 1)).alias(r) for r in ROUTES])
    counted.write.mode("overwrite").partitionBy("route").parquet(f"{path}/rows/batch={batch}")
    counts = {k: int(v) for k, v in seen.get.items()}
    spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()]).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/evidence/batch={batch}")
    return counts


def read_routed(spark: SparkSession, path: str, route: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the finished batches, their evidence)."""
    evidence = spark.read.parquet(f"{path}/evidence")
    rows = spark.read.parquet(f"{path}/rows").join(evidence.select("batch"), "batch", "left_semi")
    return (rows if route is None else rows.filter(F.col("route") == route)), evidence


def append_samples(samples: DataFrame, path: str) -> None:
    """Append metric samples to the long metric table."""
    samples.write.mode("append").partitionBy("metric").parquet(path)
