"""Helpers shared by the corpus operators: shared-folder tables, bounded samples, components."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.session import ensure_checkpoint_dir


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage with compressed columnar files that every executor can
    read, so a lost executor costs no recomputation of what stands before.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_mod(column: str, n: int):
    """``crc32(id as text) mod n``: the split that the result contracts name."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, bound: int, by: tuple[str, ...] = ()) -> DataFrame:
    """At most ``bound`` rows (all, if there are no more), chosen by a hash of the whole row.

    Rows of one ``key`` (null included) are chosen each by its own, since the
    other columns count, too; rows equal in all columns are alike and taken until
    the bound is full.  ``by`` names fewer columns to hash: those of one side of a
    join below, so that Spark can filter that side before it joins.  The cut is found among the hashes of about twice the
    bound's share, which the driver holds as numbers.  Rows that are copies of
    few others may leave the sample under its bound, never over it.
    """
    n = df.count()
    if n <= bound:
        return df
    lot = F.shiftrightunsigned(F.xxhash64(*(by or df.columns), F.lit("sample")), 1)
    most = ((1 << 63) - 1) * min(2 * bound, n) // n
    sizes = df.select(lot.alias("lot")).filter(F.col("lot") <= F.lit(most)).groupBy("lot").agg(F.count(F.lit(1)).alias("n")).toPandas()
    sizes = sizes.sort_values("lot")
    full = sizes["n"].cumsum().to_numpy()
    k = int(np.searchsorted(full, bound, side="right"))  # this many whole hashes fit
    if k == len(sizes):
        return df.filter(lot <= F.lit(most))
    taken = df.filter(lot <= F.lit(int(sizes["lot"].iloc[k - 1]))) if k else df.filter(F.lit(False))
    room = bound - (int(full[k - 1]) if k else 0)
    return taken.unionByName(df.filter(lot == F.lit(int(sizes["lot"].iloc[k]))).limit(room)) if room else taken


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(id, component_id)`` for every id in ``edges(src, dst)``; component = smallest id.

    Alternating large-star and small-star rounds: each groups neighbours with a
    map-side minimum and joins it back (AQE splits a hot node), so no
    neighbourhood is gathered.  Every round is written to the shared folder.
    Raises if ``max_rounds`` does not reach the fixed point.
    """
    e = shared_table(edges.filter("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own, so that the join below has plain exchanges that AQE can split at a hot node
        low = shared_table(both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("v"), F.least("u", "m").alias("m")), "low")
        large = e.join(low, "v").select("u", F.col("m").alias("v")).filter("u <> v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(first, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(first.select("u", F.col("m").alias("v"))).distinct())
        e = shared_table(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                                                  F.lit(0).cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            roots = e.select(F.col("v").alias("u"), "v").distinct()
            return (e.unionByName(roots).groupBy("u").agg(F.min("v").alias("component_id"))
                    .withColumnRenamed("u", "id"))
        seen = tuple(now)
    raise RuntimeError("components did not settle")


def union_find(n: int, pairs) -> list[int]:
    """Smallest-index root of each of ``n`` items under ``pairs``."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a byte string, for all words at once.

    A word's hash is a polynomial in an odd base modulo 2^64, taken from prefix
    sums over the bytes and shifted to the word's start by the inverse powers.
    Pickles as an empty hasher: each worker builds its own table of powers.
    """

    BASE = 0x5851F42D4C957F2D

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def __reduce__(self):
        return WordHasher, ()

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 1 << 16)
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position of the first byte) of each word."""
        b = np.frombuffer(b" " + raw + b" ", np.uint8)
        self._powers(len(b))
        space = self.space[b]
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, last = edge[0::2], edge[1::2]  # each one byte early
        sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[:len(b)], dtype=np.uint64)
        h = (sums[last] - sums[first]) * self.inverse[first]
        return mix(h + (last - first).astype(np.uint64) * _M2), first

    def many(self, raws: list[bytes], piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, number of words of each byte string)."""
        out, counts, at = [], np.zeros(len(raws), np.int64), 0
        while at < len(raws):
            to, size = at, 0
            while to < len(raws) and (to == at or size + len(raws[to]) < piece):
                size += len(raws[to]) + 1
                to += 1
            h, first = self(b" ".join(raws[at:to]))
            ends = np.cumsum([len(r) + 1 for r in raws[at:to]])
            counts[at:to] = np.diff(np.concatenate([[0], np.searchsorted(first, ends - 1, side="left")]))
            out.append(h)
            at = to
        return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
