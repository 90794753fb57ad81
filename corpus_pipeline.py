"""The corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage
before kept and returns the columns of ``documents`` (the last one: pieces).
Stages run one after the other; each result is written as Parquet to the shared
folder and read back, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import decontaminate, jaccard, langid, linededup, packing
from hourcast.llm.common import documents, shared_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject.

    Fitted on a bounded sample of the rows with a language; rows without text
    or without a letter, and rows under the calibrated level, go.
    """
    model = langid.fit(docs)
    return langid.identify(docs, model, prefix="__").filter(~F.col("__rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line runs of three or more that occur earlier; ``n_chars`` follows the text.

    A changed document with nothing but white space left (blank lines never
    match and stay) has no text of its own and goes.
    """
    cut = linededup.remove_repeated_runs(docs, prefix="__", every_run=True)
    changed = F.col("__n_removed") > 0
    return (cut.filter(~changed | F.col("text").rlike(r"(?U)\S"))
            .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at five words and similarity 0.8: the one with the smallest id."""
    classes = shared_table(jaccard.join(docs, n=5, percent=80), "classes")
    kept = classes.filter("doc_id IS NULL OR doc_id = component_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("__rows")).withColumnRenamed("doc_id", "__id")
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")))
    once = out.filter("__rows = 1 OR doc_id IS NULL").select(*docs.columns)
    if not kept.filter("__rows > 1 AND __id IS NOT NULL").limit(1).count():
        return once
    # an id given to several rows: its equal texts are one document
    again = out.filter("__rows > 1 AND doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again.select(*docs.columns))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified test item."""
    items = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    found = decontaminate.find_matches(docs, items, column="__matches")
    return found.filter(F.size("__matches") == 0).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their ids."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates),
          ("decontamination", clean_of_benchmark), ("packing", sequences)]

#: Language ID, the similarity classes and the tokenizer are beyond SQL; the
#: tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
