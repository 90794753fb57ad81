"""Operators on pairs against brute force: vectors, shingle sets, line runs, word spans."""

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from hourcast.llm import jaccard, linededup, queries, substring, vectordedup
from tests.oracle import duck, rows

SMALL = "/root/testdata/sf0.001"


def smallest_reachable(ids, linked):
    comp = {i: i for i in ids}
    change = True
    while change:
        change = False
        for a, b in linked:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                change = True
    return comp


# ---- vectors ----------------------------------------------------------------

def vector_rows(seed=1, n=400, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    out = []
    for i in range(n):
        out.append((i, [float(x) for x in base[i]], int(i % 3)))
        if i % 10 == 0:  # near copies around the threshold, and exact ones
            for e in (0.05, 0.15, 0.19, 0.21, 0.3):
                d = rng.normal(size=dim)
                v = base[i] + d / np.linalg.norm(d) * np.linalg.norm(base[i]) * e
                out.append((1000 + len(out), [float(x) for x in v], int(i % 3)))
            out.append((1000 + len(out), out[-6][1], int(i % 3)))
    return out


def brute_vectors(data):
    links = {k: set() for k, *_ in data}
    for i, (a, x, l) in enumerate(data):
        for b, y, m in data[:i]:
            if l == m and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b), links[b].add(a)
    comp = smallest_reachable(links, [(a, b) for a in links for b in links[a]])
    return {k: (len(links[k]), comp[k]) for k in links}


@pytest.mark.parametrize("block", [1500, 7])
def test_vectors_match_brute_force(spark, block):
    data = vector_rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    data = [(k, np.array(v, np.float32).astype(float), l) for k, v, l in data]
    got = vectordedup.near_duplicates(df, block=block).collect()
    want = brute_vectors(data)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want  # recall 1 here
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_index_recall_on_the_given_table(spark):
    got = queries.QUERIES["op1_vector_dedup"](spark, SMALL).toPandas()
    df = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    links = 0
    for _, g in df.groupby("label"):
        x = np.stack([np.asarray(v, float) for v in g["embedding"]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links += int((x @ x.T >= 0.98).sum() - len(g))
    assert len(got) == len(df) and got["n_links"].sum() >= 0.9 * links
    assert got["n_links"].sum() <= links


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, nan], 1), (4, [1.0, inf], 1), (5, [1.0, None], 1), (6, [], 1),
            (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1),
            (12, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS c", "2 AS n_links")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectordedup.near_duplicates(df).collect()}
    alone = {(k, 0, k, True) for k in (1, 2, 3, 4, 5, 6, 7, 8, 11, 12)}
    assert got == alone | {(9, 2, 9, True), (10, 2, 9, False), (None, 2, 9, False)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectordedup.near_duplicates(empty).collect() == []


# ---- shingle sets -----------------------------------------------------------

def near_texts(seed=5, groups=25, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocab) for _ in range(40)]  # shared by unlike documents
    out, k = [], 0
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(1, words))]
        if g % 3 == 0:
            base = passage + base
        for copy in range(rng.choice([1, 2, 4, 9])):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            k += 1
            out.append((k, rng.choice([" ", "\t", "\n "]).join(t)))
    out += [(k + 1, out[3][1].upper()), (k + 2, out[3][1]), (k + 3, ""), (k + 4, None), (k + 5, "  \n"), (k + 6, "Alone")]
    return out


def word_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_jaccard(data, n, percent):
    sets = {k: word_set(t, n) for k, t in data}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = smallest_reachable(sets, linked)
    return {k: (len(sets[k]), comp[k]) for k in sets}


@pytest.mark.parametrize("n,percent,chunk", [(4, 85, 2000), (5, 80, 3), (2, 50, 5)])
def test_jaccard_matches_brute_force(spark, n, percent, chunk):
    data = near_texts()
    got = jaccard.join(spark.createDataFrame(data, "doc_id long, text string"), n=n, percent=percent, chunk=chunk,
                       docs_per_batch=10).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(data, n, percent)


def test_linked_sets_share_enough_signatures():
    rng = np.random.default_rng(2)
    for percent in (50, 80, 85):
        tops = jaccard.size_classes(5000, percent)
        for size in [*range(1, 40), 100, 700]:
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            for drop in range(0, len(a) // 2 + 1, max(1, size // 25)):
                for add in (0, 1, size // 9):
                    b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
                    if len(b) and not np.array_equal(a, b) and jaccard.links(a, b, percent):
                        (sa, need_a), (sb, need_b) = jaccard.signatures(a, percent, tops), jaccard.signatures(b, percent, tops)
                        assert np.intersect1d(sa, sb).size >= max(need_a, need_b, 1)


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.append(b[8:], rng.integers(0, 1 << 63, 5, dtype=np.uint64))) for b in base]
    got = jaccard.spanning_links(sets, 85)
    assert sorted((min(p), max(p)) for p in got) == [(i, 40 + i) for i in range(40)]
    tree = jaccard.SignatureTree(sets)
    i, j = np.triu_indices(80, 1)
    assert tree.may_link(0, i, j, 85).sum() == 40


def test_jaccard_ties_nulls_repeats_and_clashing_columns(spark):
    t = "one two three four five"
    data = [(5, t), (5, t), (3, t), (None, t), (8, None), (9, ""), (10, "one two"), (11, "one  two")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS k", "'x' AS component_id", "2 AS digest")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, None), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10)], key=str)
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- line runs --------------------------------------------------------------

def brute_lines(data, gram=2, window=2):
    """Winnowing written out: selected grams, first occurrences, extension on both sides."""
    def name(s):
        return hashlib.md5(s.encode()).hexdigest()[:16]
    prints = []
    for k, t in sorted(data):
        lines = [(i, name(x)) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        grams = [name("".join(h for _, h in lines[p:p + gram])) for p in range(len(lines) - gram + 1)]
        if not grams:
            continue
        chosen = {min((g, p) for p, g in list(enumerate(grams))[w:w + window])[1]
                  for w in range(max(0, len(grams) - window) + 1)}
        prints += [(grams[p], k, p, lines) for p in sorted(chosen)]
    first = {}
    for g, k, p, lines in prints:
        if g not in first or (k, p) < first[g][:2]:
            first[g] = (k, p, lines)
    gone = {}
    for g, k, p, lines in prints:
        k0, p0, other = first[g]
        if (k, p) == (k0, p0):
            continue
        lo = hi = 0
        while lo < window and min(p, p0) - lo > 0 and lines[p - lo - 1][1] == other[p0 - lo - 1][1]:
            lo += 1
        while hi < window and p + gram + hi < len(lines) and p0 + gram + hi < len(other) \
                and lines[p + gram + hi][1] == other[p0 + gram + hi][1]:
            hi += 1
        gone.setdefault(k, set()).update(lines[q][0] for q in range(p - lo, p + gram + hi))
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in data}


def line_texts(seed=9):
    rng = random.Random(seed)
    block = [f"shared line {i}" for i in range(12)]
    out = []
    for k in range(40):
        lines = [f"own {k} {i}" for i in range(rng.randrange(0, 7))]
        if k % 2:
            at = rng.randrange(len(lines) + 1)
            lo = rng.randrange(8)
            lines[at:at] = block[lo:lo + rng.randrange(1, 5)]
        if k % 7 == 0:
            lines += ["same"] * rng.randrange(1, 9)
        if k % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "   ")
        out.append((k, "\n".join(lines)))
    return out


@pytest.mark.parametrize("gram,window", [(2, 2), (1, 3), (3, 4)])
def test_line_runs_match_brute_force(spark, gram, window):
    data = line_texts()
    got = linededup.remove_repeated_runs(spark.createDataFrame(data, "doc_id long, text string"), gram=gram, window=window)
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(data, gram, window)


def test_guaranteed_runs_are_cut(spark):
    run = [f"r{i}" for i in range(3)]  # gram + window - 1 lines
    data = [(1, "\n".join(["a", "b", *run, "c"])), (2, "\n".join(["x", *run, "y", "z"])), (3, "\n".join([*run, "q"]))]
    got = {r.doc_id: r.text for r in linededup.remove_repeated_runs(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1] == data[0][1] and not any("r1" in got[k] for k in (2, 3))


def run_lines(data, size):
    """Per document the numbers of its lines in runs of ``size`` that start earlier, and of all lines that do."""
    seen, lines_seen, runs, single = set(), set(), {}, {}
    for k, t in sorted(data):
        own = [(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        runs[k], single[k] = set(), set()
        for p in range(len(own)):
            run = tuple(x for _, x in own[p:p + size])
            if len(run) == size and run in seen:
                runs[k].update(i for i, _ in own[p:p + size])
            seen.add(run)
            if own[p][1] in lines_seen:
                single[k].add(own[p][0])
            lines_seen.add(own[p][1])
    return runs, single


@pytest.mark.parametrize("gram,window", [(2, 2), (2, 3), (1, 4)])
def test_every_line_of_a_run_that_starts_earlier_goes(spark, gram, window):
    rng = random.Random(11)  # few different lines: the first occurrence of a gram often has other neighbours
    data = [(k, "\n".join(f"line {rng.randrange(4)}" for _ in range(rng.randrange(1, 9)))) for k in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    left = {}
    for every in (False, True):
        got = {r.doc_id: r for r in linededup.remove_repeated_runs(df, gram=gram, window=window, every_run=every).collect()}
        runs, single = run_lines(data, gram + window - 1)
        left[every] = 0
        for k, t in data:
            own = t.split("\n")
            most = [x for i, x in enumerate(own) if i not in runs[k]]  # all that may stay
            least = [x for i, x in enumerate(own) if i not in single[k]]
            kept = got[k].text.split("\n") if got[k].n_removed < len(own) else []
            left[every] += sum((collections.Counter(kept) - collections.Counter(most)).values())
            assert not collections.Counter(least) - collections.Counter(kept)
    assert left[True] == 0 < left[False]


def test_line_query_equals_its_sql(spark):
    a = rows(queries.QUERIES["op7_line_dedup"](spark, SMALL).toPandas())
    assert a == rows(duck(SMALL).execute(queries.ORACLE["op7_line_dedup"]).fetchdf())


def test_lines_nulls_repeats_and_clashing_columns(spark):
    t = "p\nq\nr"
    data = [(1, t), (1, t), (None, t), (2, None), (3, ""), (4, "p\nq\nr\ns"), (5, "\n\n \n")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "7 AS n_lines", "'z' AS k", "8 AS gone")
    got = linededup.remove_repeated_runs(df)
    assert got.columns == ["doc_id", "text", "k", "gone", "n_lines", "n_removed"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert found == sorted([(None, t, 3, 0), (1, "", 3, 3), (1, "", 3, 3), (2, None, 0, 0), (3, "", 1, 0), (4, "s", 4, 3),
                            (5, "\n\n \n", 4, 0)], key=str)
    assert linededup.remove_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_line_dedup_is_native(spark):
    df = linededup.remove_repeated_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- word spans -------------------------------------------------------------

def brute_spans(data, k):
    first, words = {}, {i: (t or "").encode().split() for i, t in data}
    for i in sorted(words):
        for s in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][s:s + k]), (i, s))
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - k + 1) if first[tuple(w[s:s + k])] != (i, s) for p in range(s, s + k)}
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def span_texts(seed=11):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    shared = [rng.choice(vocab) for _ in range(90)]
    out = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            lo = rng.randrange(60)
            at = rng.randrange(len(w) + 1)
            w[at:at] = shared[lo:lo + rng.randrange(3, 45)]
        if k % 9 == 0:
            w += ["same"] * rng.randrange(1, 50)
        out.append((k, "  ".join(w)))
    return out + [(100, out[7][1]), (101, out[7][1]), (-4, out[8][1]), (102, None), (103, "")]


@pytest.mark.parametrize("k,batch", [(20, 700), (5, 500), (20, 1 << 20)])
def test_spans_match_brute_force(spark, k, batch):
    data = span_texts()
    got = substring.remove_repeated_spans(spark.createDataFrame(data, "doc_id long, text string"), k=k, batch_bytes=batch).collect()
    want = brute_spans(data, k)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    words = {i: (t or "").split() for i, t in data}
    for r in got:  # source coordinates name the same words
        for s in r.spans:
            assert words[r.doc_id][s.start:s.start + s.length] == words[s.source_id][s.source_start:s.source_start + s.length]
            assert (s.source_id, s.source_start) < (r.doc_id, s.start)


def test_span_query_equals_its_sql(spark):
    a = rows(queries.QUERIES["op8_substring_dedup"](spark, SMALL).toPandas())
    assert a == rows(duck(SMALL).execute(queries.ORACLE["op8_substring_dedup"]).fetchdf())


def test_spans_nulls_repeats_and_clashing_columns(spark):
    t = " ".join(f"x{i}" for i in range(25))
    data = [(1, t), (1, t), (2, t), (None, t)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS batch", "'a' AS k", "2 AS n_words")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeated_spans(df).collect()), key=str)
    assert got == sorted([(1, 25, 0), (1, 25, 0), (2, 25, 25), (None, 25, 25)], key=str)
    assert substring.remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
