import random

from hourcast.llm.common import bounded_sample, connected_components, union_find


def brute(edges):
    names = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(names)}
    root = union_find(len(names), [(at[a], at[b]) for a, b in edges])
    return {n: names[root[at[n]]] for n in names}


def test_components_of_chain_star_and_random(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)]  # a chain
    edges += [(500 + i, 999) for i in range(60)]  # a star around its largest id
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    edges += [(-5, -9), (7, 7), (-9, -5)]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_bounded_sample_is_whole_when_small_and_near_its_bound_when_large(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    assert bounded_sample(df, "k", 20000).count() == 20000
    assert abs(bounded_sample(df, "k", 2000).count() - 2000) < 250


def test_bounded_sample_is_bounded_whatever_ids_repeat(spark):
    from pyspark.sql import functions as F
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 20).alias("k"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    got = bounded_sample(rows, "k", 3000)
    assert got.count() == 3000
    by = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert len(by) == 21 and abs(by[None] - 1000) < 150 and all(60 < n < 145 for k, n in by.items() if k is not None)
    assert bounded_sample(rows.repartition(3), "k", 3000).exceptAll(got).count() == 0
    assert bounded_sample(rows, "k", 59_000).count() == 59_000
    copies = rows.filter("k IS NULL").limit(500).unionByName(spark.range(20_000).select(F.lit(1).cast("long").alias("k"), F.lit("same").alias("t")))
    assert 0 < bounded_sample(copies, "k", 100).count() <= 100


def test_word_hashes_tell_words_apart_wherever_they_stand():
    import pickle

    from hourcast.llm.common import WordHasher
    rng = random.Random(5)
    alphabet = ["a", "b", "\0", "é", " ", "x" * 9, " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c"]
    raws = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))).encode() for _ in range(400)]
    raws += [b"", b"  ", b"word" * 50_000 + b" tail"]
    for piece in (1 << 18, 64):
        hashes, counts = pickle.loads(pickle.dumps(WordHasher())).many(raws, piece)
        words = [w for r in raws for w in r.split()]
        assert counts.tolist() == [len(r.split()) for r in raws] and len(hashes) == len(words)
        named = {}
        assert all(named.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
        assert len(set(named.values())) == len(named)
    assert WordHasher().many([])[0].tolist() == []
