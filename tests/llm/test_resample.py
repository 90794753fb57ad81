"""Importance resampling against a plain Python recomputation, and the query against its SQL."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hourcast.llm import queries, resample
from tests.oracle import duck, rows

SMALL = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def runs(text, n=2):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=2, buckets=10_000, seed=7, percent=25, least=20):
    """(id, n_features, weight, score, rank) of each row."""
    count = [collections.Counter(zlib.crc32(f.encode()) % buckets for _, t in part for f in runs(t, n)) for part in (docs, target)]
    size = [sum(c.values()) for c in count]
    gain = {b: math.floor(1000 * math.log((count[1][b] + 1.0) * (size[0] + buckets) / ((count[0][b] + 1.0) * (size[1] + buckets))))
            for b in range(buckets)}
    out = []
    for i, (key, text) in enumerate(docs):
        f = runs(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // max(1, len(f))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, t) in zip(out, docs) if len(words(t)) >= least),
                  key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=repr)


def some_texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma9", "été", "ÉTÉ", "数据", "x", "y1", "don't", "K", "😀", "\0nul"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (5, texts[6]), (None, texts[9])]
    return docs + [(200, None), (201, ""), (202, " -- "), (203, "one"), (204, "A-B c_D")], [(i, t) for i, t in enumerate(texts[:4])] + [(9, None)]


def operator(spark, docs, target, n=2, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    stored = resample.shared_table(resample.weigh(d, spark.createDataFrame(target, "item_id long, text string"), n=n), "test")
    out = resample.draw(stored, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_operator_equals_plain_python(spark, n):
    docs, target = some_texts()
    assert operator(spark, docs, target, n) == brute(docs, target, n)


@pytest.mark.parametrize("percent,least", [(100, 0), (0, 0), (40, 20), (25, 10**6)])
def test_shares_and_limits(spark, percent, least):
    docs, target = some_texts(8)
    assert operator(spark, docs, target, percent=percent, least_words=least) == brute(docs, target, percent=percent, least=least)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é-9") for _ in range(rng.randrange(400))) for _ in range(50)] + ["word" * 100, "a " * 90]
    for n in (1, 2, 3):
        for most in (1, 7, 40, 10**6):
            got = collections.Counter()
            for strings, row, carried in resample.pieces(pa.array(texts), n - 1, most):
                for k, segment, bucket in resample.features(strings, carried, n, 1 << 40):
                    got.update((int(row[s]), int(b)) for s, b in zip(segment, bucket))
            assert got == collections.Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in runs(t, n))


def test_ranks_of_many_ties_are_gapless(spark):
    docs = [(7, "same words " * 10)] * 3000 + [(i, f"other {i} " * 10) for i in range(100, 1100)]
    got = operator(spark, docs, [(1, "same words")], percent=60)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 4000 * 60 // 100 + 1))
    by_rank = [r[3] for r in sorted((r for r in got if r[4]), key=lambda r: r[4])]
    assert by_rank == sorted(by_rank, reverse=True)


def test_empty_tables_and_clashing_columns(spark):
    assert operator(spark, [], []) == []
    docs, target = some_texts()
    assert operator(spark, docs, []) == brute(docs, [])
    d = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, weight string, more int")
    out = resample.weigh(d, d)
    assert out.columns == ["doc_id", "text", "more", "n_words", "n_features", "weight", "score"] and out.first().n_features == 3


def test_gains_are_floored_logs():
    g = resample.gains(np.array([0, 9, 100]), np.array([4, 0, 1]))
    s, t = 109 + 3, 5 + 3
    assert g.tolist() == [math.floor(1000 * math.log(x)) for x in (5 * s / t, s / (10 * t), 2 * s / (101 * t))]


def test_query_equals_its_sql_and_plain_python(spark):
    got = queries.QUERIES["op12_resampling"](spark, SMALL).toPandas()
    assert rows(got) == rows(duck(SMALL).execute(queries.ORACLE["op12_resampling"]).df())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    have = [(r.doc_id, r.n_features, r.weight, r.score, None if r.rank != r.rank else int(r.rank)) for r in got.itertuples()]
    assert sorted(have, key=repr) == brute(docs, items)
