"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees statistics of the whole text alone (letters, symbols,
repetition, line and word shapes); the metadata view sees the other columns
alone (source, language, stated length).  Each is a ridge logistic regression.
Over ``rounds`` each view labels the unlabelled rows it is surest of, in the
proportion of the labels, and hands them to the other.  A held-back fifth of
the labelled rows calibrates both views (Platt) and their combination, which
then scores every document.  Both pools are bounded hash samples
(``train_rows`` labelled, ``pool_rows`` unlabelled documents).

Defined cases: null text counts as empty; nulls in metadata are a value of
their own; without labels of both kinds every score is the known share of good
rows (0.5 if there is none); repeated rows are scored one by one; other columns
pass through, and one named like a result (``prefix`` + name) is replaced by it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import bounded_sample, shared_table
from hourcast.llm.toxicity import logistic

_KIND = np.full(256, 5, np.int64)  # 0 lower, 1 upper, 2 digit, 3 space, 4 sentence marks, 5 symbols, 6 beyond ASCII
_KIND[[*range(97, 123)]] = 0
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[128:] = 6
TEXT_SIZE, META_SIZE = 17, 44


def text_features(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    kinds = np.bincount(_KIND[raw], minlength=7) / n
    same = float((raw[1:] == raw[:-1]).mean()) if len(raw) > 1 else 0.0
    words = (text or "").split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = (text or "").count("\n") + 1
    repeats = sum(a == b for a, b in zip(words, words[1:])) / m
    plain = sum(map(str.isalpha, words)) / m
    return np.array([*kinds, same, np.log1p(len(words)), len(set(words)) / m ** 0.9, repeats, plain,
                     lengths.mean() / 10, lengths.std() / 10, np.log1p(len(words) / lines),
                     (text or "").count("!") / m, (text or "").count("|") / m])


def meta_features(source, lang, n_chars) -> np.ndarray:
    x = np.zeros(META_SIZE)
    x[zlib.crc32(str(source).encode()) % 32] = 1
    x[32 + zlib.crc32(str(lang).encode()) % 8] = 1
    missing = n_chars is None or n_chars != n_chars
    size = 0.0 if missing else np.log1p(max(0.0, float(n_chars)))
    x[40:44] = [float(missing), size / 10, size * size / 100, float(size < 5)]
    return x


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    platt: tuple[float, float] = (0.0, 1.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:], -30, 30)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.platt[0] + self.platt[1] * self.logit(x)


@dataclass
class QualityModel:
    text: View | None = None
    meta: View | None = None
    combine: np.ndarray | None = None
    base: float = 0.5

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the text view, of the metadata view, and of both."""
        if self.combine is None:
            same = np.full(len(xt), self.base)
            return same, same, same
        a, b = self.text.calibrated(xt), self.meta.calibrated(xm)
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.column_stack([np.ones(len(a)), a, b]) @ self.combine)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return View(mean, scale, logistic((x - mean) / scale, y, ridge=2.0))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    w = logistic(z[:, None], y, ridge=0.1)
    return float(w[0]), float(max(w[1], 0.0))


def co_train(xt, xm, y, pool_t, pool_m, rounds: int = 5, share: float = 0.05, sure: float = 0.9) -> QualityModel:
    """Views that exchange their surest pseudo-labels, then calibration and combination."""
    n = len(y)
    held = np.arange(n) % 5 == 0
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held = np.zeros(n, bool)
    cal = held if held.any() else ~held
    good = y[~held].mean()
    sets = {v: [x[~held], y[~held], np.zeros(0, int), np.zeros(0)] for v, x in (("t", xt), ("m", xm))}
    pools = {"t": pool_t, "m": pool_m}
    quota = max(1, int(share * len(pool_t)))
    views = {}
    for _ in range(rounds):
        for v, (x, lab, rows, pseudo) in sets.items():
            views[v] = _view(np.vstack([x, pools[v][rows]]), np.concatenate([lab, pseudo]))
        if not len(pool_t):
            break
        for v, other in (("t", "m"), ("m", "t")):
            p = _sigmoid(views[v].logit(pools[v]))
            free = np.setdiff1d(np.arange(len(p)), sets[other][2])
            best = free[np.argsort(-p[free], kind="stable")][:max(1, int(quota * good))]
            worst = free[np.argsort(p[free], kind="stable")][:max(1, int(quota * (1 - good)))]
            best, worst = best[p[best] >= sure], worst[p[worst] <= 1 - sure]
            sets[other][2] = np.concatenate([sets[other][2], best, worst])
            sets[other][3] = np.concatenate([sets[other][3], np.ones(len(best)), np.zeros(len(worst))])
    t, m = views["t"], views["m"]
    t.platt, m.platt = _platt(t.logit(xt[cal]), y[cal]), _platt(m.logit(xm[cal]), y[cal])
    both = np.column_stack([t.calibrated(xt[cal]), m.calibrated(xm[cal])])
    return QualityModel(t, m, logistic(both, y[cal], ridge=0.1), float(y.mean()))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
        train_rows: int = 6000, pool_rows: int = 6000) -> QualityModel:
    """Co-train on bounded samples of the labelled and the unlabelled documents."""
    named = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("lk"), F.col(label).cast("long").alias("y"))
    rows = docs.select(F.col(key).alias("k"), "text", "source", "lang", "n_chars")
    some = shared_table(bounded_sample(named, "lk", train_rows), "labels")  # small by its file: the texts stay where they are

    def describe(batches):
        for pdf in batches:
            yield pdf[["k", "y"]].assign(
                t=[text_features(v).tolist() for v in pdf["text"]],
                m=[meta_features(*v).tolist() for v in zip(pdf["source"], pdf["lang"], pdf["n_chars"])])

    schema = f"k {rows.schema['k'].dataType.simpleString()}, y double, t array<double>, m array<double>"
    own = rows.join(some, rows["k"] == some["lk"]).drop("lk").mapInPandas(describe, schema).toPandas()
    if own["y"].nunique() < 2:
        return QualityModel(base=float(own["y"].mean()) if len(own) else 0.5)
    # the labelled share of the sample goes again, so the pool is drawn somewhat larger
    drawn = bounded_sample(rows.filter("k IS NOT NULL"), "k", 2 * pool_rows)
    pool = (drawn.join(named.select("lk"), drawn["k"] == named["lk"], "left_anti")
            .withColumn("y", F.lit(None).cast("double")).mapInPandas(describe, schema).toPandas())
    own, pool = (f.assign(o=f["k"].astype(str)).sort_values("o", kind="stable") for f in (own, pool))
    stack = lambda s, n: np.stack(s.to_list()) if len(s) else np.zeros((0, n))
    return co_train(stack(own["t"], TEXT_SIZE), stack(own["m"], META_SIZE), own["y"].to_numpy(float),
                    stack(pool["t"], TEXT_SIZE), stack(pool["m"], META_SIZE))


def score(docs: DataFrame, model: QualityModel, prefix: str = "") -> DataFrame:
    """``docs`` plus ``text_score``, ``meta_score`` and ``score`` of every whole document."""
    names = ["text_score", "meta_score", "score"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def of(text, source, lang, n_chars):
        import pandas as pd
        xt = np.stack([text_features(t) for t in text]) if len(text) else np.zeros((0, TEXT_SIZE))
        xm = np.stack([meta_features(*v) for v in zip(source, lang, n_chars)]) if len(text) else np.zeros((0, META_SIZE))
        return pd.DataFrame(dict(zip(names, model.scores(xt, xm))))

    got = docs.withColumn(f"{prefix}__quality", of("text", "source", "lang", "n_chars"))
    new = {prefix + n: F.col(f"{prefix}__quality.{n}").alias(prefix + n) for n in names}
    return got.select(*[c for c in docs.columns if c not in new], *new.values())
