"""Classifiers, language model, packing and decontamination: brute force, round trips, held-out accuracy."""

import collections
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from hourcast.llm import decontaminate, langid, lm, packing, quality, queries, toxicity

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def crc_mod(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# ---- language ID ------------------------------------------------------------

def test_language_accuracy_on_held_out_rows(spark):
    got = queries.QUERIES["op3_language"](spark, MEDIUM).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{MEDIUM}/documents.parquet").set_index("doc_id")
    assert len(got) == len(docs)
    assert all(got["held_out"] == [crc_mod(i, 4) == 2 for i in got.index])
    held = got[got["held_out"]]
    assert (held["lang_pred"] == docs.loc[held.index, "lang"]).mean() >= 0.98
    assert got["score"].between(0, 1).all() and got["rejected"].mean() < 0.01


def test_long_texts_hash_the_same_in_pieces(monkeypatch):
    text = "Höhe und Tiefe 123 the end " * 300
    whole = langid.gram_counts(text, 512)
    monkeypatch.setattr(langid, "_CHUNK", 37)
    assert np.array_equal(langid.gram_counts(text, 512), whole)


def test_language_edge_cases(spark):
    docs = [(i, "der die das und nicht " * 3, "de") for i in range(30)] + [(100 + i, "the and of with from " * 3, "en") for i in range(30)]
    train = spark.createDataFrame(docs + [(7, None, "xx"), (8, "words", None), (None, "the of", "en")], "doc_id long, text string, lang string")
    model = langid.fit(train, train_rows=200)
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of"), (4, "the and of"), (None, "der und nicht"), (5, "the and " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'q' AS lang_pred", "'e' AS lang")
    got = langid.identify(df, model).select("doc_id", "lang_pred", "rejected").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de", "en"]
    assert [r.rejected for r in got[:3]] == [True] * 3
    assert langid.identify(df.limit(0), model).collect() == []
    nothing = langid.fit(train.filter("lang IS NULL"))
    assert nothing is None and {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_unlearned_languages_and_letter_junk_are_rejected(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").filter("text IS NOT NULL AND lang IS NOT NULL")
    model = langid.fit(docs.filter(queries.id_mod("doc_id", 4) != 2))
    odd = ["Ovo je sasvim običan tekst na jeziku koji nije naučen i trebalo bi ga odbiti",
           "jest to zwykły polski tekst który powinien zostać odrzucony ponieważ nie zna go model",
           "Это обычный русский текст который не был выучен", "これは日本語の文章です。学習されていない言語です",
           "xq zvkj qwrtp zzkx vbnm qqq xkcd wvw pqz", "łżźć " * 40, "def f(x): return [i**2 for i in range(x)] if x else None"]
    got = langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert all(r.rejected for r in got)
    clean = docs.filter(queries.id_mod("doc_id", 4) == 2).filter("size(split(text, ' ')) >= 5")
    held = langid.identify(clean.select("doc_id", "text"), model)
    assert held.count() > 200 and held.filter("rejected").count() < 0.01 * held.count()


def test_rejection_level_is_the_quantile_of_right_answers():
    right = np.random.default_rng(5).lognormal(2, 0.3, 20_000)
    assert (right < langid.rejection_level(right, 0.001)).mean() <= 0.001
    lost = [(right < langid.rejection_level(own, 0.001)).mean() for own in right.reshape(-1, 40)]
    assert np.mean(lost) < 0.01 < np.mean([(right < own.min()).mean() for own in right.reshape(-1, 40)])
    assert langid.rejection_level(right[:19], 0.001) == -np.inf


# ---- toxicity ---------------------------------------------------------------

def test_composed_grammar_marks_scope():
    m = toxicity.ToxicityModel({"idiot": 2.0})
    marks = lambda s: dict(zip(toxicity.MARKS, m.clause(s.split()).tolist()))
    assert marks("what idiot wrote it")["i"] == 2
    assert marks("you complete idiot")["I"] == 2
    assert marks("you are not an idiot")["x"] == 2
    assert marks("she said you are an idiot")["q"] == 2
    assert marks("i will kill you")["t"] == 1 and marks("you die i kill")["T"] == 1
    one = toxicity.compose(toxicity.scope("a", {"b": "c"}, 1), toxicity.scope("c", {"d": "e"}, None), "abcd")
    state, out = one.start, ""
    for x in "abxdabd":
        state, y = one.step(state, x)
        out += y
    assert out == "acxeace"


@pytest.mark.parametrize("text,mark", [
    ("what an idiot wrote it", "i"), ("you complete idiot", "I"), ("stupid idiot you", "I"), ("you are not an idiot", "x"), ("an idiot you are not", "x"),
    ("she said you are an idiot", "q"), ("you are an idiot he said", "q"), ("you are an idiot said he", "q"), ("the idiot said hello to all", "i"),
    ("i will kill you", "T"), ("they kill time", "t"), ("i will not kill you", ""), ("he said kill time", "q"), ("never call me idiot he said", ""),
    ("plain words only", "")])
def test_matches_are_read_both_ways(text, mark):
    m = toxicity.ToxicityModel({"idiot": 2.0, "stupid": 3.0}, threats={"kill": 1.5})
    got = dict(zip(toxicity.MARKS, m.matches(text.split()).tolist()))
    weight = 1.5 if "kill" in text else 5.0 if "stupid" in text else 2.0
    assert got == {x: weight if x == mark else 0 for x in toxicity.MARKS}


def test_fitted_factors_keep_their_order_and_follow_the_data():
    rng = np.random.default_rng(3)
    marks = rng.poisson(0.3, size=(3000, 6)) * 2.0
    for told in (0.0, 1.0, 5.0):  # labels that ignore, halve or overrate negated and reported matches
        z = marks @ np.array([1, 1.4, told, told, 1, 1.4]) * 1.5 - 2
        y = (rng.uniform(size=len(z)) < 1 / (1 + np.exp(-z))).astype(float)
        factors, layer = toxicity.fit_factors(marks, y)
        assert factors[0] in toxicity.AIMED and factors[1] in toxicity.LESS and factors[2] in toxicity.LESS and layer[1] > 0
        assert (max(factors[1:]) <= 0.3) == (told == 0.0)


def test_negated_and_reported_clauses_score_below_bare_and_aimed_ones_above(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs.join(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic"), "doc_id"))
    worst = max(model.insults, key=lambda w: (model.insults[w], w))
    bare, aimed, negated, told, nothing = (model.score(t.format(worst)) for t in (
        "what {} wrote it", "you complete {}", "you are not {}", "she said you are {}", "you are fine"))
    assert nothing < negated < bare < aimed and nothing < told < bare


def test_toxicity_on_held_out_rows(spark):
    got = queries.QUERIES["op9_toxicity"](spark, MEDIUM).toPandas().merge(pd.read_parquet(f"{MEDIUM}/labels.parquet"), on="doc_id")
    held = got[got["held_out"]]
    assert all(held["doc_id"].map(lambda i: crc_mod(i, 5)) == 0)
    right = (held["predicted"] == held["toxic"]).mean()
    assert right >= 0.95 and right > 1 - held["toxic"].mean()
    assert (got["predicted"] == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()


def test_toxicity_edge_cases(spark):
    rows = [(i, f"word{i % 7} you total zorgle . fine" if i % 2 else f"word{i % 7} all is fine", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows + [(99, "zorgle", None), (98, None, 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df)
    assert set(model.insults) >= {"zorgle"} and "fine" not in model.insults
    tests = spark.createDataFrame([(1, None), (2, ""), (3, "You zorgle!"), (None, "you ZORGLE"), (4, "plain " * 400_000)],
                                  "doc_id long, text string").selectExpr("*", "'x' AS toxic", "2 AS score")
    s = [r.score for r in toxicity.score(tests, model).collect()]
    assert s[0] == s[1] == s[4] < 0.5 < s[2] == s[3]
    assert toxicity.score(tests.limit(0), model).collect() == []
    assert toxicity.fit(df.filter("toxic = 1")).base == 1.0 and toxicity.fit(df.limit(0)).base == 0.0


def test_pieces_cover_the_text(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE", 10)
    for text in ("", "a b c " * 20, "x" * 95, "one two\nthree four five six"):
        assert "".join(toxicity.pieces(text)) == text


# ---- quality ----------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    got = queries.QUERIES["op10_quality"](spark, MEDIUM).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = got[got["held_out"]].merge(pd.read_parquet(f"{MEDIUM}/labels.parquet"), on="doc_id")
    assert (held["kept"] == (held["quality"] == 1)).mean() >= 0.97


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000).astype(float)
    xt = y[:, None] * 2 + rng.normal(size=(4000, 3))
    xm = y[:, None] * 2 + rng.normal(size=(4000, 3))
    few = quality.co_train(xt[:20], xm[:20], y[:20], xt[20:2000], xm[20:2000])
    p = few.scores(xt[2000:], xm[2000:])
    assert all(((v >= 0.5) == y[2000:]).mean() > 0.9 for v in p[:2])
    assert ((p[2] >= 0.5) == y[2000:]).mean() > 0.95


def test_quality_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = [(i, f"A good sentence number {i} stands here.", "en", "web", 30) for i in range(60)]
    bad = [(100 + i, "%%% $$$ ### " * (1 + i % 5), None, None, None) for i in range(60)]
    odd = [(500, None, None, None, None), (None, "", "en", "web", 0), (1, "A good sentence.", "en", "web", -5),
           (600, "long words here " * 100_000, "en", "web", 1)]
    docs = spark.createDataFrame(good + bad + odd, schema)
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(40), *range(100, 140)]] + [(None, 1), (55, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs.selectExpr("*", "9 AS score", "'k' AS y"), model).toPandas().set_index("doc_id")["score"]
    assert (got.loc[range(2, 60)] > 0.5).all() and (got.loc[range(100, 160)] < 0.5).all() and got.between(0, 1).all()
    assert quality.score(docs.limit(0), model).collect() == []
    assert quality.fit(docs, labels.limit(0)).base == 0.5


# ---- language model ---------------------------------------------------------

def base_scores(data, train):
    tokens = [[*(t or "").encode().lower().split(), b"\0end"] for _, t in data]
    count = collections.Counter(w for use, seq in zip(train, tokens) if use for w in seq)
    n, v = sum(count.values()), len(count)
    return [(len(s), sum(count[w] > 0 for w in s), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s)) for s in tokens]


def test_lm_counts_match_brute_force_and_the_model_beats_the_base(spark):
    got = queries.QUERIES["op5_lm_scoring"](spark, SMALL).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    held = [crc_mod(i, 7) == 2 for i in docs["doc_id"]]
    want = base_scores(list(zip(docs["doc_id"], docs["text"])), [not h for h in held])
    assert got["held_out"].tolist() == held
    assert list(zip(got["n_tokens"], got["n_known"], got["train_tokens"])) == [w[:3] for w in want]
    assert np.allclose(got["base_score"], [w[3] for w in want], rtol=1e-9)
    own = got[got["held_out"]]
    assert own["score"].sum() > own["base_score"].sum() and (got["score"] < 0).all()


def test_lm_next_word_probabilities_sum_to_one(spark):
    vocab = ["a", "b", "c", "d"]
    rng = random.Random(1)
    train = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9)))) for i in range(400)]
    # score(prefix + word) - score(prefix without its end) over all words, one unseen word and the end
    probes = {w: f"a {w} b" for w in [*vocab, "unseen"]}
    rows = [(i, t, True) for i, t in train] + [(1000 + k, t, False) for k, t in enumerate(probes.values())] + [(2000, "a", False)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string, use boolean")
    got = {r.doc_id: r.score for r in lm.score(df, F.col("use")).collect()}
    # P(w|a) enters "a w b end" together with P(b|w) P(end|b); compare two texts that differ in known parts only
    text = [(0, "a b", True), (1, "a c", True), (2, "a", True), (3, "b", True)]
    assert all(np.isfinite(v) for v in got.values()) and got[2000] > got[1004]
    tiny = {r.doc_id: r for r in lm.score(spark.createDataFrame(text, "doc_id long, text string, use boolean"), F.col("use")).collect()}
    assert tiny[0].train_tokens == 10 and tiny[0].n_known == 3


def test_em_raises_the_likelihood_and_keeps_unseen_words_possible():
    rng = np.random.default_rng(3)
    cells = rng.dirichlet([1, 1, 1], 200)
    weight, bucket = rng.integers(1, 9, 200).astype(float), rng.integers(0, 4, 200)
    lam = lm.expectation_maximisation(cells, weight, bucket)
    assert np.allclose(lam.sum(axis=1), 1) and (lam[:, 1:] > 0).all() and (lam[0, 0] == 0)
    for b in range(1, 4):
        like = lambda l: (weight * np.log(cells @ l))[bucket == b].sum()  # noqa: E731, E741
        assert all(like(lam[b]) >= like(x) - 1e-6 for x in rng.dirichlet([1, 1, 1], 50))


def test_sorted_keys_round_trip():
    rng = np.random.default_rng(4)
    for keys in (np.sort(rng.integers(0, 1 << 48, 1000, dtype=np.uint64)), np.array([5], np.uint64),
                 np.array([3, 3, 9], np.uint64), np.array([0, 1 << 40], np.uint64)):
        assert np.array_equal(lm.unpack_sorted(lm.pack_sorted(keys)), keys)


def test_lm_edge_cases(spark):
    from pyspark.sql import functions as F
    rows = [(1, None, True), (2, "", True), (3, "A a", None), (3, "A a", None), (None, "x", False), (4, "a " * 300_000, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, use boolean").selectExpr("*", "1 AS k", "2 AS batch", "3 AS score")
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in lm.score(df, F.col("use")).collect()), key=str)
    assert got == sorted([(1, 1, 1, 300003), (2, 1, 1, 300003), (3, 3, 3, 300003), (3, 3, 3, 300003), (None, 2, 1, 300003),
                          (4, 300001, 300001, 300003)], key=str)
    none = lm.score(df, F.lit(False)).collect()
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in none} == {(0.0, 0.0, 0, 0)}
    assert lm.score(df.limit(0), F.lit(True)).collect() == []


# ---- packing ----------------------------------------------------------------

def tokens_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def test_packing_round_trip(spark):
    got = queries.QUERIES["op6_packing"](spark, SMALL).toPandas().sort_values(["doc_id", "start"])
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    ids = dict(zip(docs["doc_id"], tokens_of(docs["text"])))
    for k, g in got.groupby("doc_id"):
        at = 0
        for p in g.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(ids[k][at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids[k])
    assert set(got["doc_id"]) == set(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
        total = g["length"].sum()
        assert total <= 1024 and total & (total - 1) == 0  # full, or a power of two: no padding


def test_combinations_and_counts():
    lengths = np.array([1, 2, 3, 5, 6, 7])
    got = {tuple(sorted(x for x in c if x)) for c in packing.combinations(lengths, 8).tolist()}
    want = {(a, 8 - a) for a in (1, 2, 3)} | {(1, 1, 6), (1, 2, 5), (2, 3, 3)}
    assert got == want
    filled, rest = packing.plan(np.array([7, 1, 5, 3, 6, 1, 1, 4]), 8)
    lens = [7, 1, 5, 3, 6, 1, 1, 4]
    assert all(sum(lens[i] for i in f) == 8 for f in filled) and len(filled) == 3 and rest == [7]
    assert sorted([i for f in filled for i in f] + rest) == list(range(8))
    assert packing.borders(2 * 8 + 7, 8) == [8, 8, 4, 2, 1]


def test_packing_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "one two"), (3, "<|endoftext|> as text"), (4, "long text " * 20_000), (5, "ß→😀" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS ids")
    got = packing.pack(df, group_rows=2).toPandas()
    own = tokens_of([t for _, t in rows])
    assert got["length"].sum() == sum(map(len, own))
    for k, ids in ((3, own[4]), (4, own[5]), (5, own[6])):
        g = got[got["doc_id"] == k].sort_values("start")
        assert b"".join(g["ids"]) == ids.tobytes()
    assert packing.pack(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, window=1000)


# ---- decontamination --------------------------------------------------------

def brute_matches(docs, items, overlap=0.8):
    out = set()
    for k, t in docs:
        seq = decontaminate.words(t or "")
        for i, x in items:
            if x and decontaminate.words(x):
                item, parts = decontaminate.words(x), decontaminate.question_answer(x)
                for at in range(max(1, len(seq))):  # some stretch of the item's length around holds it
                    near = seq[at:at + 2 * len(item)]
                    if item[0] not in near and item[-1] not in near:
                        continue
                    if decontaminate.contained(item, near) >= overlap and all(
                            len(set(p) & set(near)) >= 0.5 * len(set(p)) for p in parts):
                        out.add((k, i))
                        break
    return out


def leak_rows(seed=6):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(500)]
    items = []
    for i in range(30):
        w = [rng.choice(vocab) for _ in range(rng.randrange(8, 40))]
        cut = len(w) - rng.randrange(1, 6)
        items.append((i, " ".join(w[:cut]) + ("\n" if i % 2 else ". ") + " ".join(w[cut:])))
    docs = []
    for k in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 400))]
        if k % 3 == 0:
            at = rng.randrange(len(w) + 1)
            part = items[rng.randrange(30)][1].upper().split()
            if k % 9 == 3:
                part = part[:len(part) // 2]  # half an item is no leak
            elif k % 9 == 6 and len(part) > 24:
                part[len(part) // 2] = "changed"
            w[at:at] = part
        docs.append((k, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("shard", [4 << 20, 900])
def test_leaks_match_brute_force(spark, shard, monkeypatch):
    docs, items = leak_rows()
    build = decontaminate.build_shards
    monkeypatch.setattr(decontaminate, "build_shards", lambda x: build(x, shard_bytes=shard))
    got = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, m.item_id) for r in got.collect() for m in r.matches} == brute_matches(docs, items)


def test_wand_finds_all_above_the_threshold():
    docs, items = leak_rows(7)
    seqs = [decontaminate.words(t) for _, t in items]
    df = collections.Counter(w for s in seqs for w in set(s))
    index = decontaminate.ItemIndex(items, df, len(items), sum(map(len, seqs)) / len(seqs), max(map(len, seqs)))
    for _, t in docs:
        ids = np.array([index.terms.get(w, -1) for w in decontaminate.words(t)], np.int64)
        for goal in (0.1, 0.3, 0.6):
            found = {}
            for start, block in index.promising(ids, goal):
                part = ids[start:start + index.window]
                found.update({(start, i): s for i, s in index.wand(np.unique(part[part >= 0]).tolist(), block, goal)})
            full = {}
            for start in range(0, len(ids), index.stride):
                part = ids[start:start + index.window]
                for i in range(len(items)):
                    s = sum(index.impacts[k][index.items[k].index(i)] for k in np.unique(part[part >= 0]).tolist() if i in index.items[k])
                    if s >= goal - 1e-9:
                        full[start, i] = s
            assert found.keys() == full.keys() and all(abs(found[k] - full[k]) < 1e-9 for k in full)


def test_leak_edge_cases(spark):
    items = spark.createDataFrame([(1, "What is the name of the river?\nThe Long River."), (2, None), (3, "...!"), (None, "x y z"),
                                   (4, "What is the name of the river?\nThe Long River.")], "item_id long, text string")
    q = "so WHAT is the name of the river? the long river - yes"
    docs = spark.createDataFrame([(1, q), (1, q), (2, None), (3, ""), (None, q), (4, "what is the name of the river"), (5, "pad " * 90_000 + q)],
                                 "doc_id long, text string").selectExpr("*", "0 AS item_id", "'m' AS matches")
    got = [(r.doc_id, [m.item_id for m in r.matches]) for r in decontaminate.find_matches(docs, items).collect()]
    assert got == [(1, [1, 4]), (1, [1, 4]), (2, []), (3, []), (None, [1, 4]), (4, []), (5, [1, 4])]
    assert all(not r.matches for r in decontaminate.find_matches(docs, items.limit(0)).collect())
    assert decontaminate.find_matches(docs.limit(0), items).collect() == []


def test_a_changed_inserted_or_dropped_word_is_no_escape_at_any_length(spark):
    rng = random.Random(8)
    common, rare = ["the", "of", "and", "in", "to", "is"], iter(f"r{i}" for i in range(9999))
    items, docs, want = [], [], set()
    for m in range(5, 61):
        w = [rng.choice(common) if rng.random() < 0.6 else next(rare) for _ in range(m - 3)] + [next(rare) for _ in range(3)]
        items.append((m, " ".join(w[:-3]) + ". " + " ".join(w[-3:])))
        for at in sorted({0, 1, m // 2, m - 2, m - 1}):
            plants = [[*w[:at], "other", *w[at + 1:]], [*w[:at], *w[at + 1:]]] + ([[*w[:at], "other", *w[at:]]] if at else [])
            if m >= 10 and at == m // 2:  # two changes apart
                plants.append(["other" if i in (m // 4, m // 2) else x for i, x in enumerate(w)])
            for p in plants:
                want.add((len(docs), m))
                docs.append((len(docs), " ".join([f"own{rng.randrange(400)}" for _ in range(rng.randrange(200))] + p + ["end", "of", "it"])))
        if m >= 8:  # a third replaced is no leak
            docs.append((len(docs), " ".join("other" if i % 3 == 0 else x for i, x in enumerate(w))))
    got = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, x.item_id) for r in got.collect() for x in r.matches}
    assert want <= found and not {k for k, _ in found} - {k for k, _ in want}


def test_edits_match_the_table_of_all_alignments():
    rng = random.Random(9)
    for _ in range(300):
        part, passage = ([rng.choice("abcd") for _ in range(rng.randrange(lo, hi))] for lo, hi in ((1, 12), (0, 20)))
        row = [0] * (len(passage) + 1)
        for i, x in enumerate(part, 1):
            new = [i]
            for j, y in enumerate(passage, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.edits(part, passage) == min(row)


def test_each_shard_is_written_before_the_next_is_built(spark, monkeypatch):
    docs, items = (spark.createDataFrame(x, f"{k} long, text string") for x, k in zip(leak_rows(), ("doc_id", "item_id")))
    steps, build, write = [], decontaminate.build_shards, decontaminate.shared_table

    def found():
        rows = decontaminate.find_matches(docs, items).orderBy("doc_id").collect()
        return [(r.doc_id, r.text, [(m.item_id, round(m.score, 9)) for m in r.matches]) for r in rows]

    whole = found()

    def built(x):
        for shard in build(x, shard_bytes=900):
            steps.append("built")
            yield shard

    monkeypatch.setattr(decontaminate, "build_shards", built)
    monkeypatch.setattr(decontaminate, "shared_table", lambda df, name: (write(df, name), steps.append("written"))[0])
    assert found() == whole
    assert len(steps) > 4 and steps == ["built", "written"] * (len(steps) // 2)


def test_leaks_on_the_given_tables(spark):
    got = queries.QUERIES["op2_decontamination"](spark, SMALL).toPandas()
    docs, items = (pd.read_parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_matches(list(zip(docs["doc_id"], docs["text"])), list(zip(items["item_id"], items["text"])))
    assert set(zip(got["doc_id"], got["item_id"])) == want and len(want) > 0
