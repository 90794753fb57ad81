"""Language-model scoring by deleted interpolation of n-gram estimates.

Tokens are lower-cased words and one end mark per document.  A token's
probability mixes the maximum-likelihood bigram and unigram estimates and a
uniform one over the vocabulary and one unseen word; the weights depend on the
frequency bucket (powers of two) of the context and are learned by
expectation-maximisation on held-out training documents, whose own counts are
taken out ("deleted") of the estimates that they are to predict.

Counts cover all training documents.  Documents are dealt to batches by a hash
of the id; a batch sends each of its distinct n-grams once, as a sorted
difference-coded hash with its training count, reducers add them up and answer
in the same order, so only counts travel back.  Answers are written to the
shared folder; they serve the held-out statistics and then the scores.  The
held-out statistic is a histogram of (context bucket, estimates in tenths of a
decade), whose size has a fixed bound whatever the input.  A frequent n-gram
costs one posting per batch, so no key is hot.

Unigrams are told apart by 64 bits and bigrams by 48 bits of hash.

Defined cases: null or empty text is the end mark alone; without training
documents every estimate is uniform over the one unseen word (score 0);
repeated rows count and are scored one by one; ids may be null; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.llm.common import WordHasher, mix, shared_table

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0x0FEDCBA987654321)
HELD_EVERY = 20  # one batch in so many is held out for the weights
BUCKETS = 32
_BINS = 100  # tenths of a decade down to 1e-10


def pack_sorted(keys: np.ndarray) -> bytes:
    """Non-decreasing numbers below 2^48 as a first value and 32-bit differences (raw where one is larger)."""
    step = np.diff(keys)
    if len(step) and step.max() >= 1 << 32:
        return b"r" + keys.astype("<u8").tobytes()
    return b"d" + keys[:1].astype("<u8").tobytes() + step.astype("<u4").tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if blob[:1] == b"r":
        return np.frombuffer(blob, "<u8", offset=1)
    first = np.frombuffer(blob, "<u8", 1, 1)
    return np.cumsum(np.concatenate([first, np.frombuffer(blob, "<u4", offset=9).astype(np.uint64)]), dtype=np.uint64)


class Batch:
    """Token and bigram hashes of a batch of documents in (id, text) order."""

    def __init__(self, table, words: WordHasher):
        ids, texts = table.column("k").to_pylist(), table.column("t").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        train = table.column("train").to_pylist()
        self.train = np.array([bool(train[i]) for i in order], bool)
        own, count = words.many([(texts[i] or "").encode("utf-8", "replace").lower() for i in order])
        self.size = count + 1
        n = int(self.size.sum())
        self.doc = np.repeat(np.arange(len(order)), self.size)
        last = np.cumsum(self.size) - 1
        self.token = np.empty(n, np.uint64)
        inner = np.ones(n, bool)
        inner[last] = False
        self.token[inner] = own
        self.token[~inner] = END
        self.before = np.empty(n, np.uint64)
        self.before[1:] = self.token[:-1]
        self.before[np.cumsum(self.size) - self.size] = START
        self.pair = mix(self.before * _A + self.token * _B) >> np.uint64(16)

    def distinct(self):
        """((distinct keys, their training counts, where each token's key is) for tokens and for pairs."""
        own = self.train[self.doc].astype(float)
        out = []
        for keys in (self.token, self.pair):
            names, where = np.unique(keys, return_inverse=True)
            out.append((names, np.bincount(where, own, len(names)).astype("<u4"), where))
        return out


def expectation_maximisation(cells: np.ndarray, weight: np.ndarray, bucket: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Mixture weights per bucket from estimates (rows of ``cells``) seen ``weight`` times."""
    out = np.tile(np.array([0.4, 0.5, 0.1]), (BUCKETS, 1))
    out[0] = [0, 0.8, 0.2]  # a context that was never seen
    for b in np.unique(bucket):
        p, n = cells[bucket == b], weight[bucket == b]
        lam = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            part = p * lam
            part /= part.sum(axis=1, keepdims=True)
            new = (part * n[:, None]).sum(axis=0) / n.sum()
            if np.abs(new - lam).max() < 1e-9:
                break
            lam = new
        lam = np.maximum(lam, [0, 1e-6, 1e-6])  # no known or unseen word may become impossible
        out[b] = lam / lam.sum()
    return out


def score(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id",
          batch_bytes: int = 6 << 20, bucket_bytes: int = 6 << 20) -> DataFrame:
    """``(key, train, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    ``train`` says which rows the counts are taken from.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_batches = max(HELD_EVERY, int(size // batch_bytes) + 1)
    buckets = 1 << max(5, int(size // bucket_bytes).bit_length())
    shift = np.uint64(48 - buckets.bit_length() + 1)
    own = docs.select(F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(n_batches)).cast("int").alias("batch"),
                      F.col(key).cast("long").alias("k"), F.col(text).alias("t"),
                      F.coalesce(train, F.lit(False)).alias("train"))
    # the first twentieth of the batches that has training rows: in small tables some have none
    held_at = own.filter("train").agg(F.coalesce(F.min(F.col("batch") % HELD_EVERY), F.lit(0))).first()[0]
    words = WordHasher()
    low = np.uint64(16)

    def send(batch_key, table):
        import pyarrow as pa
        rows = []
        for kind, (names, counts, _) in enumerate(Batch(table, words).distinct()):
            top = names >> low if kind == 0 else names
            full, cut = np.unique(top >> shift, return_index=True)
            for b, low_end, end in zip(full.tolist(), cut.tolist(), [*cut[1:].tolist(), len(top)]):
                s = slice(low_end, end)
                rest = (names[s] & np.uint64(0xFFFF)).astype("<u2").tobytes() if kind == 0 else b""
                rows.append((b, batch_key[0].as_py(), kind, pack_sorted(top[s]), rest, counts[s].tobytes()))
        schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()),
                            ("low", pa.binary()), ("counts", pa.binary())])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def add_up(bucket_key, table):
        import pyarrow as pa
        out = []
        cols = [table.column(c).to_pylist() for c in ("batch", "kind", "keys", "low", "counts")]
        for kind in (0, 1):
            rows = sorted((b, k, lo, c) for b, kd, k, lo, c in zip(*cols) if kd == kind)
            if not rows:
                continue
            parts = [unpack_sorted(k) for _, k, _, _ in rows]
            if kind == 0:
                parts = [(p << low) | np.frombuffer(lo, "<u2") for p, (_, _, lo, _) in zip(parts, rows)]
            counts = np.concatenate([np.frombuffer(c, "<u4") for *_, c in rows]).astype(float)
            held = np.repeat([b % HELD_EVERY == held_at for b, *_ in rows], [len(p) for p in parts])
            names, where = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(where, counts, len(names))
            rest = total - np.bincount(where, counts * held, len(names))
            ends = np.cumsum([len(p) for p in parts])
            for (b, *_), p, e in zip(rows, parts, ends):
                w = where[e - len(p):e]
                out.append((bucket_key[0].as_py(), b, kind, *(pa.compress(x[w].astype("<u4").tobytes(), "zstd", asbytes=True)
                                                             if keep else None for x, keep in ((total, True), (rest, b % HELD_EVERY == held_at))),
                            len(p), 0, 0, 0))
            if kind == 0:  # the corpus figures: tokens, vocabulary, and tokens without the held-out part
                out.append((bucket_key[0].as_py(), -1, 0, None, None, 0, int(total.sum()), int((total > 0).sum()), int(rest.sum())))
        schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("kind", pa.int8()), ("total", pa.binary()),
                            ("rest", pa.binary()), ("size", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64()),
                            ("rest_tokens", pa.int64())])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    answers = shared_table(
        own.groupBy("batch").applyInArrow(send, "bucket int, batch int, kind tinyint, keys binary, low binary, counts binary")
        .groupBy("bucket").applyInArrow(add_up, "bucket int, batch int, kind tinyint, total binary, rest binary, "
                                        "size long, tokens long, words long, rest_tokens long"), "counts")
    figures = answers.filter("batch = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "rest_tokens")]).first()
    n, vocabulary, n_rest = (int(x) for x in figures)

    def estimates(table, found, which: str, tokens: int):
        """(batch, token counts, context buckets, rows of bigram, unigram and uniform estimates)."""
        import pyarrow as pa
        b = Batch(table, words)
        got = sorted(zip(*(found.column(c).to_pylist() for c in ("kind", "bucket", which, "size"))), key=lambda r: r[:2])
        count = []
        for kind, (names, _, where) in enumerate(b.distinct()):
            flat = np.concatenate([np.frombuffer(pa.decompress(x, 4 * m, "zstd", asbytes=True), "<u4")
                                   for kd, _, x, m in got if kd == kind]).astype(float)
            if len(flat) != len(names):
                raise RuntimeError("the answers do not fit the batch's n-grams")
            count.append(flat[where])
        one, two = count
        context = np.empty_like(one)
        first = np.cumsum(b.size) - b.size
        context[1:] = one[:-1]
        context[first] = one[np.cumsum(b.size) - 1]  # as many starts as ends
        p = np.stack([two / np.maximum(context, 1), one / max(tokens, 1), np.full(len(one), 1 / (vocabulary + 1))], axis=1)
        bucket = np.minimum(np.floor(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)
        return b, one, bucket, p

    def held_out(batch_key, table, found):
        import pyarrow as pa
        if not table.num_rows or not n_rest:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        b, _, bucket, p = estimates(table, found, "rest", n_rest)
        own_rows = b.train[b.doc]
        with np.errstate(divide="ignore"):
            bins = np.where(p[:, :2] > 0, np.clip(np.floor(-10 * np.log10(p[:, :2])), 0, _BINS - 1), _BINS).astype(np.int64)
        cell = ((bucket * (_BINS + 1) + bins[:, 0]) * (_BINS + 1) + bins[:, 1])[own_rows]
        names, counts = np.unique(cell, return_counts=True)
        return pa.table({"cell": names, "n": counts})

    held = F.col("batch") % HELD_EVERY == held_at
    cells = (own.filter(held).groupBy("batch").cogroup(answers.filter(held & (F.col("batch") >= 0)).groupBy("batch"))
             .applyInArrow(held_out, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    cell = cells["cell"].to_numpy(np.int64)
    second = np.stack([cell // (_BINS + 1) % (_BINS + 1), cell % (_BINS + 1)], axis=1)
    value = np.where(second < _BINS, 10.0 ** (-(second + 0.5) / 10), 0.0)
    value[second == 0] = 0.9  # the bin that holds 1
    grid = np.column_stack([value, np.full(len(cell), 1 / (vocabulary + 1))])
    weights = (expectation_maximisation(grid, cells["n"].to_numpy(float), cell // (_BINS + 1) ** 2)
               if n else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1)))

    result = T.StructType([T.StructField(key, T.LongType()), T.StructField("train", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])

    def apply(batch_key, table, found):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        kind = [to_arrow_type(f.dataType) for f in result]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in kind], names=result.fieldNames())
        b, one, bucket, p = estimates(table, found, "total", n)
        m = len(b.ids)
        base = np.bincount(b.doc, np.log10((one + 1) / (n + vocabulary + 1)), m)
        own_score = np.bincount(b.doc, np.log10((p * weights[bucket]).sum(axis=1)), m)
        known = np.bincount(b.doc, one > 0, m).astype(np.int64)
        cols = [b.ids, b.train, b.size, known, np.full(m, n), base, own_score]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kind)], names=result.fieldNames())

    return (own.groupBy("batch").cogroup(answers.filter("batch >= 0").select("batch", "kind", "bucket", "total", "size").groupBy("batch"))
            .applyInArrow(apply, result))
