"""Canonical history over append-only snapshot and revision ledgers
(C1, C22–C27, C31–C35, C37, C38).

Nothing is updated in place: revisions are appended and every "current" view
is an aggregate over the ledger.  Per-(counter, hour) selection partitions on
the full key, so each group is a handful of revisions however large a counter
is.  Writing back uses dynamic partition overwrite (``write_canonical``), the
row-level ``MERGE`` of table formats being unavailable here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["counter_id", "ts_utc"]


def precedence_default(snapshot_no: Column) -> Column:
    """Latest snapshot wins, but snapshots 1 and 2 rank equal (a tie)."""
    return F.when(snapshot_no >= 3, F.lit(2)).otherwise(F.lit(1))


def merge(revisions: DataFrame, precedence: Column, value: str = "hourly_count",
          lineage: str = "snapshot_no", key=KEY) -> DataFrame:
    """One current row per key by precedence; equal top precedence with
    several candidates is a blocking tie (value withheld, ``tie`` = true)."""
    r = revisions.withColumn("_p", precedence)
    top = F.max("_p").over(Window.partitionBy(*key))
    best = r.withColumn("_top", top).filter(F.col("_p") == F.col("_top"))
    g = best.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"),
                               F.max_by(F.col(value), F.col(lineage)).alias("_v"),
                               F.max(lineage).alias("_lin"))
    tie = F.col("_n") > 1
    return g.select(*key, F.when(~tie, F.col("_v")).alias(value),
                    F.when(~tie, F.col("_lin")).alias(lineage), tie.alias("tie"))


def as_of(revisions: DataFrame, max_snapshot: int, lineage: str = "snapshot_no") -> DataFrame:
    """The ledger as it was when snapshot ``max_snapshot`` was the last."""
    return revisions.filter(F.col(lineage) <= max_snapshot)


def extract(df: DataFrame, start: Column, end: Column, counters: list[str] | None = None,
            ts: str = "ts_utc") -> DataFrame:
    """Half-open ``[start, end)`` range, optional counter list (pushed down)."""
    out = df.filter((F.col(ts) >= start) & (F.col(ts) < end))
    if counters:
        out = out.filter(F.col("counter_id").isin(*counters))
    return out


def row_digest(*cols: str | Column) -> Column:
    """32-bit digest of a row's text (first 8 hex digits of MD5); a null column
    is the text ``\\N``.  Summed as a 38-digit decimal (``evidence``) it is an
    order-independent checksum that both Spark and SQL compute and that no
    number of rows overflows."""
    text = F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N"))
                              for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")


def evidence(df: DataFrame, keys: list[str], ts: str, digest: Column) -> DataFrame:
    """Row count, covered range and order-independent checksum."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"),
                                 F.max(ts).alias("last_ts"),
                                 F.sum(digest).cast("string").alias("checksum"))


def append_outcomes(ledger: DataFrame, incoming: DataFrame, identity: list[str], checksum: str) -> DataFrame:
    """C22 + C23: each incoming snapshot against the immutable ledger.

    The retry key is the identity (source, version, coverage, context) and the
    checksum: an equal one is a retry and adds nothing, one with another
    checksum conflicts and is rejected, a new identity is appended.
    """
    have = ledger.select(*identity, F.col(checksum).alias("_have")).groupBy(*identity).agg(
        F.collect_set("_have").alias("_have"))  # the accepted checksums of one snapshot: one
    same = F.array_contains("_have", F.col(checksum))
    return (incoming.join(have, identity, "left").withColumn(
        "outcome", F.when(F.col("_have").isNull(), "appended").when(same, "duplicate").otherwise("conflict")).drop("_have"))


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 of the schema's ``name:type`` texts (driver-side metadata, not data)."""
    import hashlib
    return hashlib.sha256(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema).encode("utf-8")).hexdigest()


def change_set(before: DataFrame, after: DataFrame, key=KEY, value: str = "hourly_count") -> DataFrame:
    """Keyed difference of two versions: added / removed / changed / unchanged."""
    b = before.select(*key, F.col(value).alias("_before"))
    a = after.select(*key, F.col(value).alias("_after"))
    j = b.join(a, key, "full_outer")
    kind = (F.when(F.col("_before").isNull() & F.col("_after").isNotNull(), "added")
            .when(F.col("_after").isNull() & F.col("_before").isNotNull(), "removed")
            .when(F.col("_before").isNull() & F.col("_after").isNull(), "unchanged")
            .when(F.col("_before") != F.col("_after"), "changed").otherwise("unchanged"))
    return j.withColumn("change", kind)


def write_canonical(df: DataFrame, path: str, partition_cols=("counter_id",)) -> None:
    """C25/C32/S5 sink: overwrite only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))
