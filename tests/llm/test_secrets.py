"""Secret scans against a plain Python scan of every window, and the query against its SQL."""

import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from hourcast.llm import queries, secrets
from tests.oracle import duck, rows

SMALL = "/root/testdata/sf0.001"
RULES = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def brute(text):
    text = text or ""
    found = [(m.start(), no, m.end(), kind) for no, (kind, p, g, least) in enumerate(RULES)
             for m in p.finditer(text) if len(m.group(g)) >= least]
    n = secrets.WINDOW
    for no, (kind, chars, level, fold) in enumerate([
            ("entropy_hex", "[0-9A-Fa-f]", 3.0, str.lower),
            ("entropy_base64", "[A-Za-z0-9+/_-]", 3.8, lambda x: x.replace("-", "+").replace("_", "/"))], 3):
        new = []
        for m in re.finditer(chars + "{20,}", text):
            hit = [i for i in range(m.end() - m.start() - n + 1) if entropy(fold(m[0][i:i + n])) >= level - 1e-7]
            for i in hit:
                if new and new[-1][0] >= m.start() and m.start() + i - (new[-1][2] - n) <= n:
                    new[-1] = (new[-1][0], no, m.start() + i + n, kind)
                else:
                    new.append((m.start() + i, no, m.start() + i + n, kind))
        found += [s for s in new if not any(re.search(a, text[s[0]:s[2]]) for a in secrets.ALLOW)
                  and not any(o[0] < s[2] and s[0] < o[2] for o in found)]
    return sorted(found)


def texts():
    rng = random.Random(4)
    b64 = string.ascii_letters + string.digits + "+/_-"
    parts = [" ", "é😀", "token = ", "PassWord:", "api_key='", "apikey=", "secret", "AKIA", "x", "example", "\n", "K", "ſecret=abcdefgh1"]
    out = [None, "", " ", "token=passwd: hunter2long", "TOKEN=secret=abcdefgh", "token==abcdefgh", "passwd = \"\"abcdefgh",
           "tokenabcdefgh=short", "AKIA0123456789A", "AKIA0123456789AB", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "0123456789abcdef" * 3,
           "eauaitionouierelleaux queelleaiierelletion", "a" * 100 + "Z9x8" * 30, "my_example_" + "q8Zt7Kp2Lm4Vx9Rw1Yc6" * 2,
           "https://mail7.example.com/thstorti/reoutionthhetionandthetionble/2024"]
    for _ in range(60):
        t = ""
        for _ in range(rng.randrange(1, 9)):
            t += rng.choice(parts) + "".join(rng.choice(rng.choice([b64, "0123456789abcdef", "0123456789ABCDEF", "etaoin"]))
                                             for _ in range(rng.choice([3, 12, 25, 45])))
            t += "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([0, 31, 32, 40])))
        out.append(t)
    return out


@pytest.mark.parametrize("piece", [secrets.PIECE, 7])
def test_spans_match_a_scan_of_every_window(spark, monkeypatch, piece):
    monkeypatch.setattr(secrets, "PIECE", piece)
    data = [(i if i % 7 else None, t) for i, t in enumerate(texts())]
    got = secrets.find_secrets(spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(data)], "i long, doc_id long, text string"))
    by = {r.i: [(s.start, s.no, s.end, s.kind) for s in r.spans] for r in got.collect()}
    assert by == {i: brute(t) for i, (_, t) in enumerate(data)}
    assert any(s[3] == "entropy_hex" for v in by.values() for s in v) and any(s[3] == "entropy_base64" for v in by.values() for s in v)


def test_long_text_with_many_matches_is_whole(spark):
    rng = random.Random(9)
    t = " ".join("token=%032x" % rng.getrandbits(128) for _ in range(2500)) + " " + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(20_000))
    spans = secrets.find_secrets(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().spans
    assert [(s.start, s.no, s.end, s.kind) for s in spans] == brute(t)
    assert all(t[s.start:s.end] == s.x for s in spans)


def test_running_values(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 4, 5, 6, 23)], "x array<long>")
    for r in df.select("x", secrets.running(F.col("x"), F.lit(0).cast("long"), lambda a, b: a + b, 5).alias("s")).collect():
        assert r.s == [sum(r.x[:i + 1]) for i in range(len(r.x))]


def test_nulls_empty_table_extra_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, "old", 1.5), (3, "token: abcdefgh", "old", 2.5)], "doc_id long, text string, spans string, more double")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert got[None].spans == [] and got[3].more == 2.5 and [(s.start, s.end) for s in got[3].spans] == [(0, 15)]
    assert secrets.find_secrets(df.limit(0)).columns == ["doc_id", "text", "more", "spans"]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_query_equals_its_sql_and_the_scan(spark):
    got = queries.QUERIES["op13_secrets"](spark, SMALL).toPandas()
    assert rows(got) == rows(duck(SMALL).execute(queries.ORACLE["op13_secrets"]).df())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in got.itertuples():
        found = brute(text[r.doc_id])
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
        base = ",".join(f"{k}:{s}:{e}" for s, no, e, k in found if no < 3)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.n_hex == sum(no == 2 for _, no, _, _ in found)
