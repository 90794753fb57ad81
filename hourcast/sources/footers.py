"""Schema contracts checked against the footers of Parquet part files.

Listing the part files is Spark's work; each task opens the footers of its
files and nothing else of them.  A contract is a table with a row per version
and field; the fields of one version are compared inside each file's row, so
the audit of any number of files needs no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOOTER = "path string, n_rows long, fields array<struct<field:string,type:string,meaning:string>>"
CONTRACT = "version int, field string, type string, required boolean, meaning string"


def part_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """``(path, length)`` of all files below ``path``; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .load(path).select("path", "length"))


def open_input(path: str):
    """A seekable stream of a file named by a path or URI."""
    from pyarrow import fs
    system, inside = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def _fields(file) -> list[dict]:
    """Names, Spark types and comments; from Spark's own footer entry if there is one."""
    entry = (file.schema_arrow.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if entry:
        from pyspark.sql.types import StructType
        return [{"field": f.name, "type": f.dataType.simpleString(), "meaning": f.metadata.get("comment")}
                for f in StructType.fromJson(json.loads(entry)).fields]
    from pyspark.sql.pandas.types import from_arrow_type
    return [{"field": f.name, "type": from_arrow_type(f.type).simpleString(), "meaning": None} for f in file.schema_arrow]


def read_footers(files: DataFrame) -> DataFrame:
    """``(path, n_rows, fields)`` of every part file."""
    def footers(batches):
        import pandas as pd
        import pyarrow.parquet as pq
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                with open_input(path) as stream:
                    file = pq.ParquetFile(stream)
                    out.append((path, file.metadata.num_rows, _fields(file)))
            yield pd.DataFrame(out, columns=["path", "n_rows", "fields"])

    return files.select("path").mapInPandas(footers, FOOTER)


def fingerprint(fields: Column) -> Column:
    """SHA-256 of the ``name:type`` texts in the file's order."""
    return F.sha2(F.array_join(F.transform(fields, lambda f: F.concat(f["field"], F.lit(":"), f["type"])), ","), 256)


def audit(footers: DataFrame, contract: DataFrame, version: int) -> DataFrame:
    """``(path, n_rows, fingerprint, field, outcome)``: every field of every file against one contract version.

    A required field that is missing or of another type blocks, and so does a
    changed meaning; an optional field of another type and an extra field warn.
    """
    wanted = contract.filter(F.col("version") == version).agg(
        F.array_sort(F.collect_list(F.struct("field", "type", "required", "meaning"))).alias("w")).scalar()  # one contract's fields

    def outcome(w, f):
        hard = F.when(w["required"], "block:").otherwise("warning:")
        return (F.when(f.isNull() & w["required"], "block:missing").when(f.isNull(), "ok:absent")
                .when(f["type"] != w["type"], F.concat(hard, F.lit("type")))
                .when(f["meaning"] != w["meaning"], "block:meaning").otherwise("ok"))

    checked = F.transform("_wanted", lambda w: F.element_at(F.transform(F.array(F.try_element_at(
        F.filter(F.col("fields"), lambda f: f["field"] == w["field"]), F.lit(1))), lambda f: F.struct(
            w["field"].alias("field"), outcome(w, f).alias("outcome"))), 1))
    extra = F.transform(F.filter("fields", lambda f: ~F.exists("_wanted", lambda w: w["field"] == f["field"])),
                        lambda f: F.struct(f["field"].alias("field"), F.lit("warning:extra").alias("outcome")))
    return (footers.withColumn("_wanted", wanted)
            .select("path", "n_rows", fingerprint(F.col("fields")).alias("fingerprint"), F.explode(F.concat(checked, extra)).alias("x"))
            .select("path", "n_rows", "fingerprint", "x.*"))


def decisions(audited: DataFrame) -> DataFrame:
    """``(path, n_rows, fingerprint, decision)``: block, warn or accept, by the worst field."""
    worst = F.max(F.when(F.col("outcome").startswith("block"), 2).when(F.col("outcome").startswith("warning"), 1).otherwise(0))
    return audited.groupBy("path", "n_rows", "fingerprint").agg(
        F.element_at(F.array(F.lit("accept"), F.lit("warn"), F.lit("block")), worst + 1).alias("decision"))
