"""Importance resampling towards a target distribution, with Arrow kernels.

Every run of 1 to ``n`` words of a text is a feature; its bucket is the CRC-32
of its bytes modulo ``buckets``.  Buckets are counted over all documents and
over all target texts, and a bucket's gain is the logarithm of the smoothed
ratio.  A document's weight is the mean gain of its features; with a Gumbel
number drawn from its id added, the highest scores are a sample without
replacement in proportion to exp(weight).

Inside a task, texts go through ``ascii_lower``, ``split_pattern_regex``,
``list_flatten`` and ``dictionary_encode``; runs are formed from the shifted
dictionary indices, the CRC is taken once per distinct run (continued from the
run without its last word), and gains are taken by bucket and summed per
segment.  A task works off ``PIECE`` bytes of text at a time and cuts longer
texts at a word border, carrying the last ``n - 1`` words over.

The two passes over the texts shuffle ``buckets`` counts per task and nothing
else.  The gains are the only thing sent to all tasks: ``buckets`` whole
numbers.  Ranks need no window over all rows: scores are whole thousandths of
logarithms, so their histogram is small and gives the cut-off; the rows above
it are range-partitioned, and each partition's offset is added.

Defined cases: null and empty texts have no words, weight 0; a null id draws
the number of the empty id and ranks first among ties; rows equal in score and
id rank by their number of features, each with a rank of its own; without
documents or target texts gains come from the smoothing alone; empty tables
give no rows; other columns pass through, and those named like a result are
replaced by it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.llm.common import shared_table

#: What stands between words: ASCII but for digits and letters (texts are lower-cased before).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 4 << 20
_GAP_BYTES = re.compile(GAP.encode())


def segments(text: bytes, carry: int, most: int) -> Iterator[tuple[bytes, int]]:
    """The text in parts of about ``most`` bytes, each after the first led by the last words before it.

    Yields (bytes, number of words carried over).
    """
    at, kept = 0, []
    while True:
        cut = _GAP_BYTES.search(text, at + most) if len(text) - at > most else None
        end = cut.end() if cut else len(text)
        own = text[at:end]
        yield (b" ".join([*kept, own]) if kept else own), len(kept)
        if not cut:
            return
        if carry:
            words, back = [], most
            while len(words) <= carry and back < 2 * len(own):  # the first word found may be cut
                back *= 2
                words = [w for w in _GAP_BYTES.split(own[-back:]) if w]
            kept = [*kept, *words][-carry:]
        at = end


def pieces(texts, carry: int, most: int):
    """Arrow arrays of about ``most`` bytes of segments: (strings, row of each, words carried into each)."""
    import pyarrow as pa
    part, row, carried, size = [], [], [], 0
    for i, text in enumerate(texts):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        for own, k in segments(raw, carry, most):
            part.append(own), row.append(i), carried.append(k)
            size += len(own)
            if size >= most:
                yield pa.array(part, pa.binary()).cast(pa.string()), np.array(row), np.array(carried)
                part, row, carried, size = [], [], [], 0
    if part:
        yield pa.array(part, pa.binary()).cast(pa.string()), np.array(row), np.array(carried)


def features(strings, carried: np.ndarray, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, segment, bucket) of the runs of k = 1 .. n words, in the order of the text."""
    import pyarrow.compute as pc
    parts = pc.split_pattern_regex(pc.ascii_lower(strings), pattern=GAP)
    words, segment = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(words), 0)
    encoded = pc.dictionary_encode(words.filter(real))
    segment = segment.filter(real).to_numpy()
    index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    named = [w.encode() for w in encoded.dictionary.to_pylist()]
    after = [b" " + w for w in named]
    first = np.searchsorted(segment, np.arange(len(strings)))
    place = np.arange(len(segment)) - first[segment]
    code = index
    crc = [zlib.crc32(w) for w in named]
    for k in range(1, n + 1):
        if k > 1:
            code = code[:-1] * len(named) + index[k - 1:] if len(code) else code
            distinct, code = np.unique(code, return_inverse=True)
            crc = [zlib.crc32(after[b], crc[a]) for a, b in zip(*(x.tolist() for x in np.divmod(distinct, max(1, len(named)))))]
        starts = len(code)
        if not starts:
            return
        whole = (segment[:starts] == segment[k - 1:]) & (place[:starts] + k > carried[segment[:starts]])
        hashed = np.array(crc, np.int64) % buckets
        yield k, segment[:starts][whole], hashed[code[whole]]


def bucket_counts(texts: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket."""
    most = PIECE

    def count(batches):
        import pyarrow as pa
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for strings, _, carried in pieces(batch.column(0), n - 1, most):
                for _, _, bucket in features(strings, carried, n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": some.astype(np.int64), "n": total[some]})

    out = np.zeros(buckets, np.int64)
    for r in (texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of the smoothed ratio of target to corpus share, floored, per bucket."""
    size = len(corpus)
    s_all, t_all = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id",
          n: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    new = ["n_words", "n_features", "weight"]
    kept = [c for c in docs.columns if c not in (*new, "score")]
    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in new]])
    most = PIECE

    def apply(batches):
        import pyarrow as pa
        for batch in batches:
            words, count, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for strings, row, carried in pieces(batch.column(kept.index(text)), n - 1, most):
                for k, segment, bucket in features(strings, carried, n, buckets):
                    ends = np.searchsorted(segment, np.arange(len(row) + 1))
                    sums = np.concatenate([[0], np.cumsum(gain.take(bucket))])
                    np.add.at(total, row, np.diff(sums[ends]))
                    np.add.at(count, row, np.diff(ends))
                    if k == 1:
                        np.add.at(words, row, np.diff(ends))
            mean = np.floor_divide(total, np.maximum(count, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words), pa.array(count), pa.array(mean)],
                                             names=[*kept, *new])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256),
                           1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    return rows.mapInArrow(apply, schema).withColumn("score", (F.col("weight") + noise).cast("long"))


def draw(weighed: DataFrame, key: str = "doc_id", percent: int = 25, least_words: int = 20) -> DataFrame:
    """``weighed`` (a stored table) with ``rank``: 1, 2, ... for the drawn rows, else null.

    Drawn are ``percent`` of the rows with ``least_words`` words, highest scores
    first, ties to the smaller id.
    """
    rows = weighed.drop("rank")
    able = F.col("n_words") >= least_words
    by_score = rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("__n"))
    by_score = shared_table(by_score, "scores")
    most = (by_score.agg(F.sum("__n")).first()[0] or 0) * percent // 100
    from pyspark.sql import Window
    above = F.sum("__n").over(Window.orderBy(F.desc("score"))) - F.col("__n")  # one row per score: thousands
    lowest = by_score.select("score", above.alias("__above")).filter(F.col("__above") < most).agg(F.min("score")).first()[0]
    if lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    top = able & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc(key), F.asc("n_features"), F.asc("__salt")]
    ranked = shared_table(
        rows.filter(top).withColumn("__salt", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order).drop("__salt")
        .withColumn("__at", F.monotonically_increasing_id()), "ranked")  # partition and place in it
    part = F.shiftright("__at", 33)
    sizes = ranked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(F.col("__part"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranked.withColumn("__part", part).join(offsets, "__part").select(
        *rows.columns, F.when(place <= most, place).alias("rank"))
    return ranked.unionByName(rows.filter(~top).withColumn("rank", F.lit(None).cast("long")))
