"""File sources (A1–A8): raw count CSV, partitioned datasets, prediction files,
manifest JSON documents, counter configuration and allow-lists.

Schemas are explicit (no inference pass over 100 TB); partitioned layouts are
``counter_id=<id>/`` so a counter filter prunes directories before any file
is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.calendar import parse_utc
from hourcast.functions.labels import slug_ascii
from hourcast.operators import ledger as LG
from hourcast.operators.validate import require_columns

KEY_COLS = ["nom_du_site_de_comptage", "orientation_compteur"]
TS_COL = "date_et_heure_de_comptage"
TARGET_COL = "comptage_horaire"

RAW_SCHEMA = T.StructType([
    T.StructField("_c0", T.StringType()),
    T.StructField("nom_du_site_de_comptage", T.StringType()),
    T.StructField("orientation_compteur", T.StringType()),
    T.StructField("date_et_heure_de_comptage", T.StringType()),
    T.StructField("comptage_horaire", T.StringType()),
])


def read_raw_counts(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A1: raw CSV scan; the leading unnamed index column is dropped."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    first = df.columns[0]
    return df.drop(first) if first.startswith("_c") else df


def normalize_raw(df: DataFrame) -> DataFrame:
    """A10 + A15 + A43: counter id, UTC timestamp and numeric count."""
    require_columns(df, [*KEY_COLS, TS_COL, TARGET_COL])
    cid = F.concat_ws("_", slug_ascii(F.col("nom_du_site_de_comptage")),
                      F.coalesce(F.col("orientation_compteur"), F.lit("NA")))
    return df.select(cid.alias("counter_id"), *KEY_COLS,
                     parse_utc(TS_COL).alias("ts_utc"),
                     F.col(TARGET_COL).try_cast("bigint").alias("hourly_count"))


# Columns dropped before modelling (key text, weather, location
# and calendar attributes embedded in the raw file).
COLUMNS_TO_DROP = [
    "nom_du_site_de_comptage", "orientation_compteur", "weather_code_wmo_code",
    "temperature_2m_c", "rain_mm", "snowfall_cm", "weather_code_wmo_code_category",
    "latitude", "longitude", "arrondissement", "elevation",
    "date_et_heure_de_comptage_hour", "date_et_heure_de_comptage_day",
    "date_et_heure_de_comptage_day_of_year", "date_et_heure_de_comptage_day_of_week",
    "date_et_heure_de_comptage_week", "date_et_heure_de_comptage_month",
    "date_et_heure_de_comptage_year", "date_et_heure_de_comptage_sin_week",
    "date_et_heure_de_comptage_cos_week", "date_et_heure_de_comptage_cos_day_of_year",
    "date_et_heure_de_comptage_sin_day_of_year"]


def drop_listed(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Drop the listed columns that exist, plus caller extras."""
    return df.drop(*COLUMNS_TO_DROP, *extra)


def select_counter(df: DataFrame, site: str | None, orientation: str | None) -> DataFrame:
    """A10: exact two-column key, null keys matched as values (``<=>``)."""
    return df.filter(F.col("nom_du_site_de_comptage").eqNullSafe(F.lit(site))
                     & F.col("orientation_compteur").eqNullSafe(F.lit(orientation)))


def unknown_keys(requested: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys the data does not contain."""
    return requested.join(present.select(*keys).distinct(), keys, "left_anti")


def read_dataset(spark: SparkSession, path: str, counters: list[str] | None = None) -> DataFrame:
    """A2 / A3: partitioned Parquet dataset; a counter list prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("counter_id").isin(*counters)) if counters else df


PREDICTION_SCHEMA = T.StructType([
    T.StructField("date_et_heure_de_comptage_local", T.StringType()),
    T.StructField("date_et_heure_de_comptage_utc", T.StringType()),
    T.StructField("y_true", T.DoubleType()),
    T.StructField("y_pred", T.DoubleType()),
    T.StructField("forecast_mode", T.BooleanType()),
])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A4: prediction file with a fixed schema, required columns and a
    non-empty gate (reads one row)."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, [f.name for f in PREDICTION_SCHEMA.fields])
    df = spark.read.option("header", True).schema(PREDICTION_SCHEMA).csv(path)
    if df.limit(1).count() == 0:
        raise ValueError(f"prediction file is empty: {path}")
    return df


MANIFEST_SCHEMA = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("artifact_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("counter_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("producer", T.StructType([T.StructField(n, T.StringType()) for n in
                                            ("service", "image", "version")])),
    T.StructField("source", T.StructType([T.StructField(n, T.StringType()) for n in
                                          ("raw_file_name", "dataset_version", "model_version")])),
    T.StructField("storage", T.StructType([T.StructField(n, T.StringType()) for n in
                                           ("primary_backend", "local_path", "object_uri",
                                            "checksum_sha256")])),
])


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """A5 + A6: every manifest document under ``pattern`` with its error class.

    Files are read whole (one small JSON document each); parsing is
    ``from_json`` in PERMISSIVE mode, so a bad document becomes a row with an
    ``error`` instead of failing the job: ``bad_json``, ``not_an_object``,
    ``invalid_manifest`` (unknown field or missing required field).
    """
    raw = (spark.read.text(pattern, wholetext=True)
           .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    out = classify_manifests(raw, "text")
    pointer = F.regexp_extract("path", r"/([^/]+)/current\.json$", 1)
    return out.select("path", F.nullif(pointer, F.lit("")).alias("current_of"), "m.*", "error")


# Fields whose text must name a known member.
MANIFEST_ENUMS = {"artifact_type": LG.ARTIFACT_TYPES, "status": LG.ARTIFACT_STATUSES}


def classify_manifests(docs: DataFrame, text: str) -> DataFrame:
    """A5: ``docs`` plus the parsed manifest ``m`` and its ``error`` class.

    A manifest is invalid if it has a field that the schema does not name, at
    the top or inside an object, if an enum is null or unknown, or if it names
    no counter.
    """
    keys = F.json_object_keys(text)          # null unless a valid JSON object
    out = docs.withColumns({"_keys": keys, "m": F.from_json(text, MANIFEST_SCHEMA)})
    extra = [F.size(F.array_except("_keys", F.array(*[F.lit(f.name) for f in MANIFEST_SCHEMA.fields]))) > 0]
    for f in MANIFEST_SCHEMA.fields:
        if isinstance(f.dataType, T.StructType):
            inner = F.json_object_keys(F.get_json_object(text, f"$.{f.name}"))
            extra.append(F.coalesce(F.size(F.array_except(inner, F.array(*[F.lit(x.name) for x in f.dataType.fields]))) > 0,
                                    F.lit(False)))
    unknown = [~F.coalesce(F.col(f"m.{c}").isin(*values), F.lit(False)) for c, values in MANIFEST_ENUMS.items()]
    invalid = F.col("m.counter_id").isNull()
    for cond in [*extra, *unknown]:
        invalid = invalid | cond
    error = (F.when(F.col("_keys").isNull(),
                    F.when(F.ltrim(F.col(text)).startswith("{"), F.lit("bad_json"))
                    .when(F.try_parse_json(text).isNotNull(), F.lit("not_an_object"))
                    .otherwise(F.lit("bad_json")))
             .when(invalid, F.lit("invalid_manifest")))
    return out.withColumn("error", error).drop("_keys")


def discover_current(manifests: DataFrame) -> DataFrame:
    """Sorted counters that have a current prediction manifest."""
    return (manifests.filter(F.col("current_of").isNotNull() & F.col("error").isNull())
            .select(F.col("current_of").alias("counter_id")).distinct().orderBy("counter_id"))


def allow_list(csv_text: Column) -> Column:
    """Comma-separated allow-list -> trimmed, non-empty array."""
    return F.filter(F.transform(F.split(csv_text, ","), lambda x: F.trim(x)), lambda x: x != "")


MODELING = T.StructType([T.StructField("ar", T.IntegerType()), T.StructField("mm", T.IntegerType()),
                         T.StructField("roll", T.IntegerType()),
                         T.StructField("test_ratio", T.DoubleType()),
                         T.StructField("grid_iter", T.IntegerType())])
COUNTER_CFG = T.StructType([T.StructField(n, T.StringType()) for n in
                            ("raw_file_name", "site", "orientation", "interim_name", "processed_name",
                             "final_basename")] + [T.StructField("modeling", MODELING)])
# Modelling defaults when a counter omits them.
MODELING_DEFAULTS = {"ar": 7, "mm": 1, "roll": 24, "test_ratio": 0.25, "grid_iter": 0}


def counter_config(doc: DataFrame, text_col: str = "value") -> DataFrame:
    """``{"counters": {id: {...}}, "scheduling": {...}}`` -> one row per
    counter with modelling defaults filled in."""
    schema = T.StructType([
        T.StructField("counters", T.MapType(T.StringType(), COUNTER_CFG)),
        T.StructField("scheduling", T.StructType([T.StructField("initial_anchor_date", T.StringType()),
                                                  T.StructField("daily_increment_pct", T.DoubleType())]))])
    parsed = doc.select(F.from_json(text_col, schema).alias("cfg"))
    rows = parsed.select(F.explode("cfg.counters").alias("counter_id", "c"), F.col("cfg.scheduling").alias("s"))
    cols = [F.coalesce(F.col(f"c.modeling.{k}"), F.lit(v)).alias(k) for k, v in MODELING_DEFAULTS.items()]
    return rows.select("counter_id", "c.site", "c.orientation", "c.raw_file_name", *cols,
                       F.col("s.initial_anchor_date").alias("anchor"),
                       F.col("s.daily_increment_pct").alias("daily_increment_pct"))
