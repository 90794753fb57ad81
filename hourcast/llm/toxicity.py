"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to classes: targets, negations, reporting verbs and seeds
of threat words are fixed lists; insults are learned with a weight each, and so
are the weights of threat words.  A clause's class string runs through a
composition of deterministic transducers that mark insults and threats as aimed
at a target, negated, or reported.  It runs forwards and, for what follows its
object ("an idiot you are not", "you fool, he said"), a second composition runs
over the reversed clause; a match is negated or reported if either run says so,
an insult is aimed if either does, a threat if its target follows it.

Each mark has a factor on the matched weight: bare 1, aimed more, negated and
reported less.  A document's sum of weighted matches goes through a logistic
layer that never falls with it.  Factors and layer are fitted on the same bounded
sample (``train_rows`` labelled documents), the factors within ranges that keep
this order; so a clause that is negated or reported always scores below the bare
one, and one that is aimed above it.

Defined cases: null, empty and wordless texts match nothing and get the base
score; without labelled rows, or with labels of one kind only, the score is the
known share of toxic rows (0 if there are none); rows with a null label teach
nothing; repeated rows are scored one by one; ties between factors go to the
first of the range; other columns pass through, and one named like the score is
replaced by it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import bounded_sample, shared_table

# Word classes of the grammar (English, German, French, Spanish).
TARGETS = ("you your you're he she they them his her their these those people everyone "
           "du dich dir ihr euch er sie ihnen tu te toi vous il elle ils elles tú usted ustedes él ella ellos").split()
NEGATIONS = ("not no never don't isn't aren't wasn't weren't doesn't nobody without "
             "nicht kein keine nie niemals ne pas jamais aucun sin nunca jamás").split()
REPORTS = ("said says say told reported claimed wrote writes quoted called alleged "
           "sagte sagt schrieb berichtete dit disait écrit rapporté dijo dice escribió").split()
THREATS = ("kill hurt destroy beat shoot attack burn hang stab töten schlagen zerstören "
           "tuer frapper détruire matar golpear destruir").split()

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")
MARKS = "iIxqtT"  # insult: bare, aimed, negated, reported; threat: bare, aimed
_PIECE = 1 << 20


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol out); a symbol without a rule is copied."""
    start: str
    rules: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    rest: dict[str, str] = field(default_factory=dict)  # state that an unlisted symbol leads to

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.rules.get((state, symbol)) or (self.rest.get(state, state), symbol)


def scope(trigger: str, changes: dict[str, str], reach: int | None) -> Transducer:
    """Rewrites ``changes`` up to ``reach`` symbols after a trigger (None: to the clause's end)."""
    t = Transducer("0")
    states = ["on"] if reach is None else [f"{k}" for k in range(1, reach + 1)]
    for s in ["0", *states]:
        t.rules[s, trigger] = (states[-1], trigger)
    for s in states:
        after = s if reach is None else f"{int(s) - 1}"
        t.rest[s] = after
        for a, b in changes.items():
            t.rules[s, a] = (after, b)
    return t


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The machine that feeds the first one's output to the second, as far as it can be reached."""
    out = Transducer(f"{first.start},{second.start}")
    todo, seen = [(first.start, second.start)], {(first.start, second.start)}
    while todo:
        a, b = todo.pop()
        for x in alphabet:
            a2, y = first.step(a, x)
            b2, z = second.step(b, y)
            out.rules[f"{a},{b}", x] = (f"{a2},{b2}", z)
            if (a2, b2) not in seen:
                seen.add((a2, b2)), todo.append((a2, b2))
    return out


def grammar() -> Transducer:
    """Targets, negations and reported speech, composed; input alphabet: o i t g n r and the marks."""
    alphabet = "oitgnr" + MARKS
    aimed = scope("g", {"i": "I", "t": "T"}, 6)
    negated = scope("n", {"i": "x", "I": "x", "t": "o", "T": "o"}, 3)
    reported = scope("r", {"i": "q", "I": "q", "x": "o", "t": "o", "T": "q"}, None)
    both = compose(aimed, negated, alphabet)
    return compose(both, reported, alphabet)


def opening(trigger: str, changes: dict[str, str], lead: str) -> Transducer:
    """Rewrites ``changes`` to the end if the trigger comes first, or second after a ``lead``."""
    t = Transducer("0")
    for state, others in (("0", "off"), ("1", "off")):
        t.rules[state, trigger] = ("on", trigger)
        t.rest[state] = others
    t.rules["0", lead] = ("1", lead)
    t.rules.update({("on", a): ("on", b) for a, b in changes.items()})
    return t


def backward_grammar() -> Transducer:
    """The same three over a reversed clause: targets and negations that follow, a report that closes it."""
    alphabet = "oitgnr" + MARKS
    aimed = scope("g", {"i": "I", "t": "T"}, 3)
    negated = scope("n", {"i": "x", "I": "x"}, 4)
    reported = opening("r", {"i": "q", "I": "q", "x": "o", "t": "o", "T": "q"}, "g")
    return compose(compose(aimed, negated, alphabet), reported, alphabet)


#: Ranges of the factors that are fitted; a bare match has factor 1.
AIMED, LESS = (1.1, 1.3, 1.6, 2.0, 3.0), (0.02, 0.1, 0.3, 0.6, 0.9)


@dataclass
class ToxicityModel:
    insults: dict[str, float]
    coefficients: np.ndarray | None = None  # bias and weight of the sum of matches
    base: float = 0.0
    threats: dict[str, float] = field(default_factory=dict)
    factors: tuple[float, float, float] = (AIMED[2], LESS[2], LESS[2])  # aimed, negated, reported

    def __post_init__(self):
        self.classes = {w: c for words, c in ((TARGETS, "g"), (NEGATIONS, "n"), (REPORTS, "r"), (THREATS, "t"))
                        for w in words}
        self.classes.update({w: "i" for w in self.insults})
        self.hits = {w for w, c in self.classes.items() if c in "it"}
        self.machine, self.mirror = grammar(), backward_grammar()

    def factor(self) -> np.ndarray:
        """The factor of each mark."""
        aimed, negated, reported = self.factors
        return np.array([1, aimed, negated, reported, 1, aimed])

    def run(self, machine: Transducer, classes: list[str]) -> list[str]:
        out, state = [], machine.start
        for c in classes:
            state, mark = machine.step(state, c)
            out.append(mark)
        return out

    def matches(self, tokens: list[str]) -> np.ndarray:
        """Weights per mark of one clause, read both ways."""
        got = np.zeros(len(MARKS))
        classes = [self.classes.get(w, "o") for w in tokens]
        there, back = self.run(self.machine, classes), self.run(self.mirror, classes[::-1])[::-1]
        for w, c, a, b in zip(tokens, classes, there, back):
            if c not in "it":
                continue
            told = {a, b}
            if "o" in told or {"x", "q"} <= told:  # a threat that is negated or reported, a negated insult that is reported
                continue
            if c == "t" and b != "T":  # who stands before a threat utters or does it
                told.discard("T")
                told.add("t")
            mark = next(m for m in "xqITit" if m in told)
            got[MARKS.index(mark)] += self.insults.get(w) or self.threats.get(w, 1.0)
        return got

    def clause(self, tokens: list[str]) -> np.ndarray:
        """Weights per mark of one clause."""
        got, state = np.zeros(len(MARKS)), self.machine.start
        for w in tokens:
            state, mark = self.machine.step(state, self.classes.get(w, "o"))
            if mark in MARKS:
                got[MARKS.index(mark)] += self.insults.get(w, 1.0)
        return got

    def features(self, text: str | None) -> np.ndarray:
        """Weights per mark of all clauses."""
        total = np.zeros(len(MARKS))
        for piece in pieces(text or ""):
            tokens = _TOKEN.findall(piece.lower())
            if self.hits.isdisjoint(tokens):
                continue
            own: list[str] = []
            for w in [*tokens, "."]:
                if w not in _ENDS:
                    own.append(w)
                    continue
                if not self.hits.isdisjoint(own):
                    total += self.matches(own)
                own = []
        return total

    def score(self, text: str | None) -> float:
        if self.coefficients is None:
            return self.base
        z = self.coefficients[0] + np.log1p(self.features(text) @ self.factor()) * self.coefficients[1]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def pieces(text: str):
    """The text whole, or in parts of about a million letters cut at white space."""
    at = 0
    while len(text) - at > _PIECE:
        cut = max(text.rfind(" ", at, at + _PIECE), text.rfind("\n", at, at + _PIECE))
        cut = at + _PIECE if cut <= at else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients (bias first) of a ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_words(rows: DataFrame, n_toxic: int, n_clean: int, least: int = 3, level: float = 1.5) -> tuple[dict, dict]:
    """(insults, threats): weights of words whose log odds in toxic documents exceed ``level`` with two standard
    errors to spare; a threat word of the fixed list that falls short has weight 1.

    One aggregate over the sample's distinct words; Spark keeps those above the
    level.  Their number is bounded by the sample's.
    """
    def distinct(series):
        return series.map(lambda t: sorted({w for p in pieces(t) for w in _TOKEN.findall(p.lower())} - _ENDS))

    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n_toxic - F.col("a") + 0.5)) - F.log(b / (n_clean - F.col("b") + 0.5))
    found = (rows.select("y", F.explode(F.pandas_udf("array<string>")(distinct)("t")).alias("w"))
             .groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
             .filter(F.col("a") >= least).withColumn("odds", odds)
             .filter(F.col("odds") - 2 * F.sqrt(1 / a + 1 / b) > level))
    learned = {r["w"]: float(r["odds"]) for r in found.collect()}
    fixed = {*TARGETS, *NEGATIONS, *REPORTS, *THREATS}
    return {w: x for w, x in learned.items() if w not in fixed}, {w: learned.get(w, 1.0) for w in THREATS}


def fit_factors(marks: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float, float], np.ndarray]:
    """The factors of likelihood and their logistic layer, one factor after the other until none changes."""
    def layer(factors):
        aimed, negated, reported = factors
        x = np.log1p(marks @ np.array([1, aimed, negated, reported, 1, aimed]))
        w = logistic(x[:, None], y)
        w[1] = max(w[1], 1e-3)
        z = np.clip(w[0] + x * w[1], -30, 30)
        return float((np.logaddexp(0, z) - y * z).sum()), w

    best = [AIMED[2], LESS[2], LESS[2]]
    while True:
        before = list(best)
        for k, choices in enumerate((AIMED, LESS, LESS)):
            best[k] = min(choices, key=lambda c: layer([*best[:k], c, *best[k + 1:]])[0])
        if best == before:
            return tuple(best), layer(best)[1]


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
        train_rows: int = 12000) -> ToxicityModel:
    """Lexicon, factors and logistic layer from a bounded hash sample of labelled rows."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("long").alias("y"))
    sample = shared_table(bounded_sample(rows, "k", train_rows, by=("k", "t")), "labelled")
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == n:
        return ToxicityModel({}, None, float(toxic / n) if n else 0.0)
    insults, threats = learn_words(sample, toxic, n - toxic)
    model = ToxicityModel(insults, threats=threats)

    def describe(batches):
        for pdf in batches:
            yield pdf[["y"]].assign(x=[model.features(t).tolist() for t in pdf["t"]])

    got = sample.select("t", "y").mapInPandas(describe, "y long, x array<double>").toPandas()
    model.factors, model.coefficients = fit_factors(np.stack(got["x"].to_list()), got["y"].to_numpy(float))
    model.base = toxic / n
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` plus the toxicity score of every whole text."""
    @F.pandas_udf("double")
    def of(series):
        return series.map(model.score)

    return docs.withColumn(column, of(F.coalesce(F.col(text), F.lit(""))))
