"""Removal of repeated line runs by winnowing, in DataFrame functions only.

A document's non-blank lines are hashed; every ``gram`` consecutive ones give a
gram hash, and of every ``window`` consecutive grams the smallest is selected
(leftmost on ties; a document with fewer grams is one window).  A run of
``gram + window - 1`` lines that occurs twice therefore has a common
fingerprint, and nothing shorter than ``gram`` lines ever matches.

Each fingerprint is joined with its first occurrence in (id, position) order.
Both carry the line hashes around them, so the match is extended both ways
without another read: up to ``window`` lines, which reaches the next selected
fingerprint of the same run or the run's end.  The lines of the later
occurrence go; every deleted line has an equal one that starts earlier.

The first occurrence may stand in another context than an earlier copy of the
run, so an edge line of such a run can stay.  With ``every_run`` a fingerprint
is also joined with the first occurrence that has the same lines before it, and
with the first that has the same lines after it, for up to ``window - 1`` lines
each: then every line of every run of ``gram + window - 1`` lines or more that
starts earlier goes.

Shuffles carry fingerprints, never text: a map-side minimum per fingerprint,
one join that AQE splits where a fingerprint is hot, and one set of line numbers
per changed document joined back.  No Python, no pairs within a group.

Defined cases: null or empty text and blank lines (spaces only) never match and
stay; rows equal in id and text are one document and are treated alike; null
ids sort first; an empty table gives no rows; other columns pass through, and
one named like a result (``prefix`` + name) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import shared_table


def line_hash(line: Column) -> Column:
    return F.substring(F.md5(line.cast("binary")), 1, 16)


def fingerprints(docs: DataFrame, gram: int = 2, window: int = 2) -> DataFrame:
    """``(k, d, pos, first, fp, around)`` of ``docs(k, d, t)``: selected grams with their context.

    ``pos`` counts non-blank lines; ``lines`` holds the original numbers of the
    lines from ``pos - window`` to ``pos + gram - 1 + window`` (null outside).
    """
    lines = docs.select("k", "d", F.expr(
        "filter(transform(split(t, '\\n', -1), (x, i) -> struct(i AS i, x AS x)), e -> length(trim(e.x)) > 0)").alias("e"))
    hashed = lines.select("k", "d", F.transform("e", lambda e: F.struct(
        e["i"].alias("i"), line_hash(e["x"]).alias("h"))).alias("e")).filter(F.size("e") >= gram)
    grams = hashed.select("k", "d", "e", F.expr(
        f"transform(sequence(0, size(e) - {gram}), p -> struct("
        f"substring(md5(cast(array_join(transform(slice(e, p + 1, {gram}), s -> s.h), '') AS binary)), 1, 16) AS fp, p AS pos))").alias("g"))
    chosen = grams.select("k", "d", "e", F.explode(F.expr(
        f"array_distinct(transform(sequence(0, greatest(0, size(g) - {window})), w -> array_min(slice(g, w + 1, {window}))))")).alias("s"))
    return chosen.select("k", "d", F.col("s.pos").alias("pos"), F.col("s.fp").alias("fp"), F.expr(
        f"transform(sequence(s.pos - {window}, s.pos + {gram - 1 + window}), j -> try_element_at(e, if(j < 0, size(e) + 1, j + 1)))").alias("around"))


def repeated_edges(found: DataFrame, gram: int, window: int) -> DataFrame:
    """``(k, d, gone)``: the lines beside a fingerprint that stood beside it before."""
    end = window + gram
    spans = [(window - n + 1, n) for n in range(1, window)] + [(end + 1, n) for n in range(1, window)]
    sides = ", ".join(f"struct({s} AS side, slice(around, {at}, {n}) AS a)" for s, (at, n) in enumerate(spans))
    beside = found.select("k", "d", "pos", "fp", F.explode(F.expr(f"array({sides})")).alias("s")).filter(
        "forall(s.a, x -> x IS NOT NULL)").select(
        "k", "d", "pos", "s.side", F.expr("concat(fp, array_join(transform(s.a, x -> x.h), ''))").alias("run"),
        F.expr("transform(s.a, x -> x.i)").alias("gone"))
    first = beside.groupBy("side", "run").agg(F.min(F.struct("k", "d", "pos")).alias("o"))
    return beside.join(first, ["side", "run"]).filter(
        F.expr("NOT (k <=> o.k AND d = o.d AND pos = o.pos)")).select("k", "d", "gone")


def repeated_lines(docs: DataFrame, gram: int = 2, window: int = 2, every_run: bool = False) -> DataFrame:
    """``(k, d, gone)``: the original line numbers to delete in each document that has any."""
    found = shared_table(fingerprints(docs, gram, window), "fingerprints")
    first = found.groupBy("fp").agg(F.min(F.struct(
        "k", "d", "pos", F.transform("around", lambda a: a["h"]).alias("h"))).alias("o"))
    later = found.join(first, "fp").filter(F.expr("NOT (k <=> o.k AND d = o.d AND pos = o.pos)"))
    same = later.withColumn("same", F.expr("zip_with(around, o.h, (a, b) -> coalesce(a.h = b, false))"))
    end = window + gram  # the context that follows the gram begins here
    reach = same.select("k", "d", F.expr(
        f"filter(transform(around, (a, i) -> if("
        f"(i >= {window} AND i < {end}) "
        f"OR (i < {window} AND forall(slice(same, i + 1, {window} - i), x -> x)) "
        f"OR (i >= {end} AND forall(slice(same, {end + 1}, i - {end} + 1), x -> x)), a.i, null)), x -> x IS NOT NULL)").alias("gone"))
    if every_run and window > 1:
        reach = reach.unionByName(repeated_edges(found, gram, window))
    return reach.select("k", "d", F.explode("gone").alias("i")).groupBy("k", "d").agg(F.collect_set("i").alias("gone"))


def remove_repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = 2,
                         window: int = 2, prefix: str = "", every_run: bool = False) -> DataFrame:
    """``docs`` with its repeated runs cut from ``text``, plus ``n_lines`` and ``n_removed``."""
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    keyed = own.filter("t IS NOT NULL").select("k", F.xxhash64("t").alias("d"), "t")
    gone = repeated_lines(keyed, gram, window, every_run).select(
        F.col("k").alias("__k"), F.col("d").alias("__d"), F.col("gone").alias("__gone"))
    joined = docs.withColumn("__key", F.col(key)).withColumn("__digest", F.xxhash64(F.col(text)))
    joined = joined.join(gone, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__digest") == F.col("__d")), "left")
    joined = joined.withColumn("__lines", F.split(F.col(text), "\n", -1))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> element_at(__lines, i + 1)), '\\n')")
    new = {prefix + "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("__lines")),
           prefix + "n_removed": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone"))}
    columns = [F.when(F.col("__gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c)
               for c in docs.columns if c not in new]
    return joined.select(*columns, *[v.cast("long").alias(c) for c, v in new.items()])
