"""Secret scans by patterns and by sliding-window entropy, in DataFrame functions only.

Three base kinds are found by pattern (``BASE``), leftmost and non-overlapping
per kind.  The method adds strings that no pattern names: every run of a
character class (``CLASSES``) of at least ``window`` characters is a candidate;
a window slides over it one character at a time, and a window whose Shannon
entropy reaches the class's level is a hit.  Hits at most a window apart are
one span.

The entropy is kept by increments.  With counts c of a window of n characters
it is log2(n) - sum(c log2 c) / n, so a step changes two counts and two terms.
The counts are a string with one letter per symbol of the class, the terms are
whole numbers (``terms``), so no rounding adds up and the level is one
comparison.  Candidates are scanned in pieces of ``PIECE`` windows.

A span is dropped if its characters match the allow list (placeholders,
alphabets in order, words without a digit), or if it overlaps a base span or a
span of a class listed before.

One document is one row and all its work is done in that row: no shuffle, no
Python, nothing that depends on other documents.  Work is linear in the text
(running values over many matches are folded in blocks).

Defined cases: null text is empty text; empty texts have no spans; equal rows
get equal results; an empty table gives no rows; other columns pass through,
and one named ``spans`` is replaced by the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_case(word: str) -> str:
    """A pattern for the ASCII word in either case, alike in every regex engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The words before an assigned secret.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = ("(?=[" + "".join(sorted({c for w in ASSIGN_WORDS for c in (w[0], w[0].upper())})) + "])(" + "|".join(either_case(w) for w in ASSIGN_WORDS)
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: kind -> (pattern, group whose length counts, least length).  The runs of the
#: last two are whole runs, so that their least length may stand in the pattern.
BASE = {"assign": (ASSIGN, 2, 8), "access": (r"AKIA[A-Z0-9]{12,}", 0, 16), "hex": (r"[0-9a-f]{32,}", 0, 32)}

#: class -> (its symbols, symbols that stand for one of these, entropy level in bits)
CLASSES = {"entropy_hex": ("0123456789abcdef", "ABCDEF", 3.0),
           "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "-_", 3.8)}
KINDS = (*BASE, *CLASSES)
WINDOW = 20
PIECE = 4096
SCALE = 1_000_000

#: A span that matches one of these is no secret.
ALLOW = (r"^[^0-9]*$", either_case("example"), either_case("changeme"), either_case("placeholder"),
         r"0123456789|1234567890", either_case("abcdefgh"), "[xX]{6}")


def terms(window: int) -> list[int]:
    """c log2 c in millionths, for c = 0 .. window."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def most_sum(window: int, level: float) -> int:
    """The largest sum of ``terms`` at which a window's entropy reaches ``level``."""
    return math.floor((math.log2(window) - level) * window * SCALE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(xs: Column, zero: Column, op: Callable[[Column, Column], Column], block: int = 1000) -> Column:
    """``op`` of all elements up to each one, in time linear in the array.

    A plain fold copies its result at every step; here it does so within blocks
    that start from the total of the blocks before.
    """
    def inside(blocks, totals):
        return F.flatten(F.transform(blocks, lambda b, i: F.slice(F.aggregate(
            b, F.array(F.aggregate(F.slice(totals, 1, i), zero, op)),
            lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))), F.lit(2), F.size(b))))

    return let(xs, lambda v: let(
        F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / block).cast("int")),
                    lambda i: F.slice(v, i * block + 1, F.lit(block))),
        lambda blocks: let(F.transform(blocks, lambda b: F.aggregate(b, zero, op)),
                           lambda totals: inside(blocks, totals))))


def located(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``array<struct<start, end, x>>`` of all matches whose group has ``least`` characters; ends exclusive.

    The characters between the matches give the positions: gap and match
    lengths add up to the ends.  A text without a match is searched once.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,x:string>>")
    measured = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    matches = F.zip_with(F.arrays_zip(found.alias("x"), measured.alias("m")), gaps, lambda f, g: F.struct(
        f["x"].alias("x"), F.length(f["x"]).cast("long").alias("n"), F.length(f["m"]).alias("m"),
        F.length(g).cast("long").alias("gap")))
    placed = let(matches, lambda ms: F.zip_with(
        ms, running(F.transform(ms, lambda m: m["gap"] + m["n"]), F.lit(0).cast("long"), lambda a, b: a + b),
        lambda m, end: F.struct((end - m["n"]).alias("start"), end.alias("end"), m["x"].alias("x"), m["m"].alias("m"))))
    return F.when(~text.rlike(pattern), nothing).otherwise(F.transform(
        F.filter(placed, lambda m: m["m"] >= least),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["x"].alias("x"))))


def window_hits(x: Column, symbols: str, window: int, level: float) -> Column:
    """A string with 1 for each window of ``x`` (as wide as ``window``) that reaches the level, else 0."""
    f = F.array(*[F.lit(v).cast("long") for v in terms(window)])
    slots = F.transform(F.split(x, ""), lambda c: F.position(c, F.lit(symbols)))
    steps = let(slots, lambda s: F.zip_with(
        s, F.concat(F.array_repeat(F.lit(0), window), F.slice(s, F.lit(1), F.size(s) - window)),
        lambda new, old: F.struct(new.alias("new"), old.alias("old"))))

    def count(counts, slot):
        return F.ascii(F.substring(counts, slot, F.lit(1))) - 65

    def change(state, slot, by):
        """``state`` with ``by`` more of the symbol."""
        return let(count(state["counts"], slot), lambda n: F.struct(
            F.overlay(state["counts"], F.char(n + 65 + by), slot, F.lit(1)).alias("counts"),
            (state["sum"] + f[n + by] - f[n]).alias("sum"), state["hits"].alias("hits"), state["i"].alias("i")))

    def step(state, x):
        left = F.when(x["old"] > 0, change(state, x["old"], -1)).otherwise(state)
        return let(let(left, lambda s: change(s, x["new"], 1)), lambda s: F.struct(
            s["counts"].alias("counts"), s["sum"].alias("sum"),
            F.when(s["i"] + 1 < window, s["hits"]).otherwise(F.concat(s["hits"], F.when(
                s["sum"] <= most_sum(window, level), "1").otherwise("0"))).alias("hits"),
            (s["i"] + 1).alias("i")))

    start = F.struct(F.lit("A" * len(symbols)).alias("counts"), F.lit(0).cast("long").alias("sum"),
                     F.lit("").alias("hits"), F.lit(0).alias("i"))
    return F.aggregate(steps, start, step, lambda s: s["hits"])


def entropy_spans(text: Column, kind: str, window: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> Column:
    """The spans of one character class, without those on the allow list."""
    symbols, others, level = CLASSES[kind]
    candidates = located(text, "[" + "".join(c if c.isalnum() else "\\" + c for c in symbols + others) + f"]{{{window},}}")
    known = F.lower if symbols == symbols.lower() else lambda c: F.translate(c, others, symbols[-len(others):])

    def hits(x):
        pieces = F.sequence(F.lit(0), F.floor((F.length(x) - window) / PIECE).cast("int"))
        return F.array_join(F.transform(pieces, lambda p: window_hits(
            F.substring(x, p * PIECE + 1, F.lit(PIECE + window - 1)), symbols, window, level)), "")

    def spans(c):
        runs = located(hits(known(c["x"])), f"1[01]*?(?=0{{{window}}}|0*$)")
        return F.transform(runs, lambda r: F.struct(
            (c["start"] + r["start"]).alias("start"), (c["start"] + r["end"] + window - 1).alias("end"),
            F.substring(c["x"], (r["start"] + 1).cast("int"), (r["end"] - r["start"] + window - 1).cast("int")).alias("x")))

    return F.filter(F.flatten(F.transform(candidates, spans)),
                    lambda s: ~reduce(lambda a, b: a | b, [s["x"].rlike(p) for p in allow], F.lit(False)))


def tagged(spans: Column, kind: str) -> Column:
    """``array<struct<start, no, end, kind, x>>``: sorts by start, then kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"),
                                                 s["end"].alias("end"), F.lit(kind).alias("kind"), s["x"].alias("x")))


def clear_of(spans: Column, taken: Column) -> Column:
    """The ``spans`` that overlap none of ``taken`` (tagged spans, spans of one kind apart from each other)."""
    far = F.lit(1 << 62).cast("long")
    none = F.lit(-1).cast("long")
    marked = F.array_sort(F.concat(
        F.transform(taken, lambda s: F.struct(s["start"].alias("at"), F.lit(0).alias("new"), s["end"].alias("e"), s.alias("s"))),
        F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("new"), s["end"].alias("e"), s.alias("s")))))

    def kept(m):
        before = running(F.transform(m, lambda s: F.when(s["new"] == 0, s["e"]).otherwise(none)), none, lambda a, b: F.greatest(a, b))
        after = F.reverse(running(F.reverse(F.transform(m, lambda s: F.when(s["new"] == 0, s["at"]).otherwise(far))),
                                  far, lambda a, b: F.least(a, b)))
        both = F.zip_with(m, F.arrays_zip(before.alias("before"), after.alias("after")), lambda s, b: F.struct(
            s.alias("m"), b["before"].alias("before"), b["after"].alias("after")))
        return F.transform(F.filter(both, lambda b: (b["m"]["new"] == 1) & (b["before"] <= b["m"]["at"])
                                    & (b["after"] >= b["m"]["e"])), lambda b: b["m"]["s"])

    return let(marked, kept)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, text: str = "text", window: int = WINDOW,
                 allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``spans``: ``array<struct<start, no, end, kind, x>>`` in order, x being the characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__spans", F.concat(*[tagged(located(t, *rule), kind) for kind, rule in BASE.items()]))
    for kind in CLASSES:
        rows = rows.withColumn("__spans", F.concat("__spans", clear_of(
            tagged(entropy_spans(t, kind, window, allow), kind), F.col("__spans"))))
    return (rows.withColumn("spans", F.array_sort("__spans"))
            .select(*[c for c in docs.columns if c != "spans"], "spans"))
