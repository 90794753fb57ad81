"""Conversation repair against exhaustive search, and the query against its SQL."""

import hashlib
import itertools
import random
import re

import pytest

from hourcast.llm import queries, repair
from tests.oracle import duck, rows

SMALL = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def faults(conv):
    out, seen = [], set()
    for role, text in conv:
        if not text.strip(SPACE):
            out.append(1)
        elif (role, text) in seen:
            out.append(2)
        elif text.rstrip(SPACE)[-1] not in ".!?":
            out.append(3)
        else:
            out.append(0)
        seen.add((role, text))
    return out


def every_edit(conv, budget=2):
    """All (cost, letters, repaired) with at most ``budget`` inserts in a row."""
    bad = faults(conv)

    def go(i, cost, letters, kept, room):
        if i == len(conv):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
                yield cost, letters, kept
        else:
            role, text = conv[i]
            yield from go(i + 1, cost + 2, letters + "D", kept, budget)
            if bad[i] not in (1, 2):
                more = 5 if bad[i] == 3 else 0
                yield from go(i + 1, cost + more, letters + "K", kept + [(role, text)], budget)
                for new in ("user", "assistant"):
                    yield from go(i + 1, cost + more + 1, letters + "R", kept + [(new, text)], budget)
        if room:
            for new in ("user", "assistant"):
                yield from go(i, cost + 5, letters + "I", kept + [(new, "")], room - 1)

    return go(0, 0, "", [], budget)


def by_table(conv):
    """The least (cost, letters) by a full table over rows and states: independent of crossings and places."""
    best, bad = {"": (0, "", ())}, faults(conv)  # state: last initial, "" or s, u, a

    def inserted(found):
        out = dict(found)
        for _ in range(2):
            for s, (c, l, k) in list(out.items()):
                new = "a" if s == "u" else "u"
                way = (c + 5, l + "I", k + ((("user", "assistant")[new == "a"], ""),))
                out[new] = min(out.get(new, way), way, key=lambda w: w[:2])
        return out

    for (role, text), f in zip(conv, bad):
        after = {}
        for s, (c, l, k) in inserted(best).items():
            new = "a" if s == "u" else "u"
            ways = [(s, (c + 2, l + "D", k))]
            if f not in (1, 2):
                c += 5 if f == 3 else 0
                ways.append((new, (c + 1, l + "R", k + ((("user", "assistant")[new == "a"], text),))))
                if role[:1] == new or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], (c, l + "K", k + ((role, text),))))
            for t, way in ways:
                after[t] = min(after.get(t, way), way, key=lambda w: w[:2])
        best = after
    return min((w for s, w in inserted(best).items() if s in ("", "a")), key=lambda w: w[:2])


def some_conversation(rng, n):
    texts = ["Yes.", "No!", "Why?", "cut", " ", "", "end. \n", "a. b"]
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(n)]


def test_full_table_equals_exhaustive_search():
    rng = random.Random(2)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            conv = some_conversation(rng, n)
            cost, letters, kept = min(every_edit(conv), key=lambda w: w[:2])
            assert by_table(conv)[:2] == (cost, letters) and list(by_table(conv)[2]) == kept


def codes(conv):
    initial = {"s": 0, "u": 1, "a": 2}
    return bytes(repair.code_of(initial.get(r[:1], 3), f) for (r, _), f in zip(conv, faults(conv)))


def letters_of(seq, parts):
    end, cost = repair.last_state(seq)
    borders = repair.crossings(seq, 0, end)
    out = ""
    for part, a, b in zip(parts, borders, borders[1:]):
        states = repair.crossings(repair.Rows(part), a, b)
        out += "".join(repair.EDITS[c][x][y][1] for c, x, y in zip(part, states, states[1:]))
    return cost, out + repair.TAIL[end]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_divide_and_conquer_over_rows_and_blocks(size):
    rng = random.Random(size)
    for n in [1, 2, 3, 5, 8, 13, 40, 90] * 6:
        conv = some_conversation(rng, n)
        c = codes(conv)
        parts = [c[i:i + size] for i in range(0, n, size)]
        want = by_table(conv)[:2]
        assert letters_of(repair.Blocks([repair.summary(p) for p in parts]), parts) == want
        assert letters_of(repair.Rows(c), [bytes([x]) for x in c]) == want


def test_every_row_of_codes_has_its_cheapest_edits():
    assert repair.EDITS[repair.code_of(0, 0)][0] == [(2, "D"), (0, "K"), (1, "R"), (6, "IR")]
    assert repair.EDITS[repair.code_of(2, 3)][1] == [None, (2, "D"), (6, "R"), (10, "IK")]
    assert repair.EDITS[repair.code_of(1, repair.BLANK)][3] == [None, None, (7, "ID"), (2, "D")]


def digest(conv_rows):
    """The contract's columns of one conversation's (turn, role, text) after damage."""
    conv = [(r, t) for _, r, t in conv_rows]
    f = faults(conv)
    turns = [t for t, _, _ in conv_rows if t is not None]
    cost, audit, kept = by_table(conv)
    ini = [r[:1] for r, _ in conv]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count(1), f.count(2), f.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(ini)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def ordered(table):
    convs = {}
    for k, turn, role, text in table:
        convs.setdefault(k, []).append((turn, role, text))
    def place(r):
        return r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()
    return {k: sorted(v, key=place) for k, v in convs.items()}


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_of_tables_with_nulls_ties_and_one_large_conversation(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    table = [(9, t // 2 if t % 50 else None, r, x) for t, (r, x) in enumerate(some_conversation(rng, 700))]
    table += [(9, 5, "user", "Same.")] * 90
    for k in [None, *range(20, 60)]:
        table += [(k, t, r, x) for t, (r, x) in enumerate(some_conversation(rng, rng.randrange(1, 9)))]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(7)
    ids = spark.createDataFrame([(k,) for k, *_ in table] + [(1000,), (1000,)], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in queries.repair_digests(repair.repair(df, conversations=ids)).collect()}
    want = {k: digest(v) for k, v in ordered(table).items()}
    want[1000] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want


def test_edit_rows_hold_the_repaired_conversation(spark):
    table = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "There?"), (1, 4, "assistant", "Yes.")]
    df = spark.createDataFrame([r + (1.0,) for r in table], "conv_id long, turn long, role string, text string, step double")
    got = [(r.step, r.edit, r.fault, r.role, r.text) for r in repair.repair(df).orderBy("step").collect()]
    assert got == [(0, "K", 0, "system", "Be kind."), (1, "D", 0, "user", "Hi."), (2, "D", 2, "user", "Hi."), (3, "K", 0, "user", "There?"),
                   (4, "K", 0, "assistant", "Yes.")]


def test_null_role_and_text_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(1, None, None, "Well."), (1, 2, "user", None), (1, 3, None, None)], schema)
    got = [(r.edit, r.fault) for r in repair.repair(df).orderBy("step").collect()]
    assert sorted(got) == [("D", 0), ("D", 1), ("D", 1)]
    assert repair.repair(df.limit(0)).count() == 0
    assert queries.repair_digests(repair.repair(df.limit(0))).count() == 0


def test_damage_follows_the_lots(spark):
    import zlib
    table = [(k, t, "assistant", "One. Two! three?") for k in range(30) for t in range(8)] + [(None, None, None, None), (3, None, "user", None)]
    got = sorted(map(tuple, queries.damaged(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for k, t, r, x in table:
        lot = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if lot == 1 else re.sub("[.!?]", "", x) if lot == 2 else x
        want += [(k, t, "user" if lot == 4 else r, x)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    assert got == sorted(want, key=repr)


def test_query_equals_its_sql_and_the_full_table(spark):
    got = queries.QUERIES["op11_conversation_repair"](spark, SMALL).toPandas()
    assert rows(got) == rows(duck(SMALL).execute(queries.ORACLE["op11_conversation_repair"]).df())
    after = ordered(map(tuple, queries.damaged(spark.read.parquet(f"{SMALL}/conversations.parquet")).collect()))
    for r in got.itertuples(index=False):
        assert tuple(r)[1:] == digest(after.get(r.conv_id, []))
