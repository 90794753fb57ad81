"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its ``prefix`` nearest reference points (pivots) in
order.  Pivots come from a bounded sample of the vectors; their number follows
the table's size up to ``max_pivots``.  Every vector is indexed: for each of its
pivots it enters the inverted list of (label, pivot).  Within a list the
shared-pivot counts of all pairs come from one product of the membership
matrix; a pair with at least ``min_shared`` of them is judged in the list of its
smallest shared pivot only, by cosine in double precision.

Vectors equal in label and components are one class with a multiplicity, so
groups of copies of any size are one entry.  A list longer than ``block``
entries is dealt to tasks as pairs of hash blocks.  Tasks return link counts and
a spanning set of links per vector, never the pairs of a group.

Recall is that of the index: a pair at the threshold shares most of its nearest
pivots; the tests measure it against brute force (0.9 is required).

Defined cases: a null label, and a vector that is null, empty, zero or has null
or non-finite components, links with nothing; vectors of different lengths
never link; a row repeated with id and vector counts once; an id with several
vectors has a row for each; rows with a null id link like others but name no
component (null if no other id is linked); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import bounded_sample, connected_components, shared_table, union_find


def _unit(rows) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Ordered numbers of the ``prefix`` pivots most similar to each unit vector."""
    sims = x @ pivots.T
    k = min(prefix, pivots.shape[0])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)


def list_links(names, weight, units, perms, low_side, high_side, pivot: int, threshold: float, min_shared: int):
    """Link counts and spanning links among the entries of one inverted list (or of two blocks of it)."""
    n = len(names)
    inside, column = np.unique(perms, return_inverse=True)
    member = np.zeros((n, len(inside)), np.float32)
    member[np.arange(n)[:, None], column.reshape(perms.shape)] = 1
    shared = member @ member.T
    before = member[:, inside < pivot]
    ok = (shared >= min_shared) & (before @ before.T == 0) & (low_side[:, None] & high_side[None, :])
    i, j = np.nonzero(ok & (names[:, None] != names[None, :]))
    cos = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        cos[s] = np.einsum("ij,ij->i", units[i[s]], units[j[s]])
    good = cos >= threshold
    i, j = i[good], j[good]
    degree = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
    if (low_side & high_side).all():  # one block: every pair was seen from both ends
        degree = degree / 2
    root = np.array(union_find(n, zip(i.tolist(), j.tolist()))) if len(i) else np.arange(n)
    return degree.astype(np.int64), root


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = 0.98, prefix: int = 12, min_shared: int = 2, max_pivots: int = 4096,
                    rows_per_pivot: int = 100, block: int = 1500) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per vector."""
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(label).alias("l"),
                          F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    valid = F.expr("l IS NOT NULL AND v IS NOT NULL AND forall(v, x -> coalesce(NOT isnan(x) AND abs(x) < double('Infinity'), false))"
                   " AND exists(v, x -> x <> 0)")
    named = rows.withColumn("c", F.when(F.coalesce(valid, F.lit(False)), F.xxhash64("l", "v")))
    members = shared_table(named.select("k", "c", F.when(F.col("c").isNull(), F.xxhash64("l", "v")).alias("w"))
                           .distinct(), "members")
    counts = members.filter("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    classes = (named.filter("c IS NOT NULL").groupBy("c").agg(F.first("l").alias("l"), F.first("v").alias("v"))
               .join(counts, "c"))

    def as_bytes(series):
        return series.map(lambda v: np.asarray(v, np.float64).tobytes())

    packed = shared_table(classes.select("c", "m", F.xxhash64("l").alias("l"), F.size("v").alias("dim"),
                                         F.pandas_udf("binary")(as_bytes)("v").alias("v")), "classes")
    n = packed.count()
    pivots: dict[int, np.ndarray] = {}
    wanted = int(min(max_pivots, max(32, n // rows_per_pivot)))
    for dim, vs in (bounded_sample(packed, "c", wanted).orderBy("c").groupBy("dim")
                    .agg(F.collect_list("v")).collect()):
        pivots[dim] = _unit(vs)

    def describe(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if dim in pivots:
                    near = nearest_pivots(_unit(part["v"]), pivots[dim], prefix)
                else:  # a rare length without a pivot: one list for all its vectors
                    near = np.zeros((len(part), 1), np.int64)
                yield part.assign(p=list(near.astype(np.int32)))[["c", "m", "l", "dim", "v", "p"]]

    described = packed.mapInPandas(describe, "c long, m long, l long, dim int, v binary, p array<int>")
    described = shared_table(described, "described")
    lists = described.select("l", "dim", F.explode("p").alias("pivot")).groupBy("l", "dim", "pivot").agg(
        F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    postings = described.withColumn("pivot", F.explode("p")).join(lists, ["l", "dim", "pivot"])
    dealt = (postings.withColumn("own", F.pmod(F.xxhash64("c", F.lit(1)), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("c", "m", "l", "dim", "v", "p", "pivot", "own", F.least("own", "other").alias("lo"),
                     F.greatest("own", "other").alias("hi")))

    def work(table):
        import pyarrow as pa
        names = table.column("c").to_numpy()
        own, lo, hi = (table.column(x).to_numpy() for x in ("own", "lo", "hi"))
        width = max(len(p) for p in table.column("p"))
        perms = np.array([p + [p[0]] * (width - len(p)) for p in table.column("p").to_pylist()], np.int64)
        # a rare length's only list counts as shared in full
        least = min_shared if width > 1 else 1
        weight = table.column("m").to_numpy().astype(float)
        degree, root = list_links(names, weight, _unit(table.column("v").to_pylist()), perms, own == lo[0], own == hi[0],
                                  int(table.column("pivot")[0].as_py()), threshold, least)
        keep = (degree > 0) | (root != np.arange(len(names)))
        return pa.table({"c": names[keep], "root": names[root[keep]], "links": degree[keep]})

    found = shared_table(dealt.groupBy("l", "dim", "pivot", "lo", "hi").applyInArrow(
        work, "c long, root long, links long"), "links")
    degree = found.groupBy("c").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("root").alias("src"), F.col("c").alias("dst")))
    joined = (members.filter("c IS NOT NULL").join(counts, "c").join(degree, "c", "left")
              .join(component.withColumnRenamed("id", "c"), "c", "left")
              .select("k", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("component_id", "c").alias("g")))
    joined = shared_table(joined, "counted")
    smallest = shared_table(joined.groupBy("g").agg(F.min("k").alias("component_id")), "smallest")
    alone = members.filter("c IS NULL").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    out = joined.join(smallest, "g").select("k", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("k").alias(key), "n_links", "component_id",
                      F.coalesce(F.col("k") == F.col("component_id"), F.lit(False)).alias("kept"))
