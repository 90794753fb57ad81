"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's byte 2-grams and 3-grams (ASCII lower case; white space and digits
folded to one blank) are hashed into ``buckets``; the document vector is the
mean of the buckets' embeddings, and a softmax over a linear map of it gives
the language.  Embeddings and map are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows (``train_rows``); a fifth of it is
kept for calibration: a temperature, then a rejection level, the ``tail``
quantile of the right answers' log-odds (with under 20 right answers nothing
with a letter is rejected).  A few hundred answers do not reach that far down,
so the level is the lower of the sample's quantile and Weissman's estimate of
it, which carries the lowest tenth on as a power law.

At scoring time the two linear layers fold into one (buckets x languages)
table of a few hundred KB, so a partition needs one table lookup per n-gram.

Defined cases: null text, or text without a letter -> ``und``, score 0,
rejected; nothing to learn from -> every row ``und``; repeated ids and rows are
scored one by one; other columns pass through, and one named like a result
(``prefix`` + name) is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.llm.common import bounded_sample

LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(32 if c in b"\t\n\r\x0b\x0c 0123456789" else c for c in range(256))
_CHUNK = 1 << 20  # bytes hashed at a time: bounds memory for very long texts


def has_letter(text: str) -> bool:
    return LETTER.search(text) is not None


def gram_counts(text: str, buckets: int) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams of the whole text."""
    raw = b" " + text.encode("utf-8", "replace").lower().translate(_FOLD) + b" "
    out = np.zeros(buckets, np.float64)
    for at in range(0, len(raw), _CHUNK):
        b = np.frombuffer(raw[at:at + _CHUNK + 2], np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:]
        last = len(raw) <= at + _CHUNK + 2
        if not last:  # the overlap belongs to the next chunk
            two, three = two[:_CHUNK], three[:_CHUNK]
        for g, salt in ((two, 2654435761), (three, 2246822519)):
            h = ((g * np.uint32(salt)) >> np.uint32(8)) % np.uint32(buckets)
            out += np.bincount(h, minlength=buckets)
        if last:
            break
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times the linear map
    bias: np.ndarray
    temperature: float
    reject_below: float  # log-odds: they tell texts apart where probabilities round to 1

    def logits(self, counts: np.ndarray) -> np.ndarray:
        x = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
        return (x @ self.table + self.bias) / self.temperature

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(counts))


def log_odds(z: np.ndarray) -> np.ndarray:
    """Log-odds of each row's largest logit against the others (infinite if there are none)."""
    z = np.sort(z, axis=-1)
    return z[..., -1] - np.logaddexp.reduce(z[..., :-1], axis=-1)


def rejection_level(right: np.ndarray, tail: float) -> float:
    """The ``tail`` quantile of the right answers' log-odds: the sample's or Weissman's, whichever is lower."""
    if len(right) < 20 or not np.isfinite(right).all():  # too few to reject anything, or one language only
        return -np.inf
    level, tenth = np.quantile(right, [tail, 0.1])
    low = right[right < tenth]
    if tenth <= 0 or not len(low):
        return float(level)
    power = np.log(tenth / np.maximum(low, tenth / 100)).mean()
    return float(min(level, tenth * (tail / 0.1) ** power))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(x: np.ndarray, labels: list[str], dim: int = 16, epochs: int = 30,
          rate: float = 20.0, batch: int = 16, tail: float = 0.001, seed: int = 7) -> LanguageModel:
    """SGD on the cross-entropy of the averaged embeddings (rows of ``x`` sum to 1), then calibration."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[:len(y) // 5], order[len(y) // 5:]
    emb = rng.normal(0, 0.1, (x.shape[1], dim)).astype(np.float32)
    lin = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            h = x[part] @ emb
            g = _softmax(h @ lin + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            grad_h = g @ lin.T
            lin -= 0.05 * step * (h.T @ g)
            bias -= 0.002 * step * g.sum(axis=0)
            emb -= step * (x[part].T @ grad_h)
    table, bias = (emb @ lin).astype(np.float64), bias.astype(np.float64)
    z = x[held] @ table + bias if len(held) else np.zeros((0, len(languages)))
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() if len(held) else 0
            for t in grid]
    temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0
    right = log_odds(z / temperature)[z.argmax(axis=1) == y[held]] if len(held) else np.array([])
    return LanguageModel(languages, table, bias, temperature, rejection_level(right, tail))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        buckets: int = 4096, train_rows: int = 3000) -> LanguageModel | None:
    """Fit on a bounded hash sample of rows with text and language (None if there is none)."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))

    def features(batches):
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["t"]]]
            yield pdf.assign(x=[gram_counts(t, buckets).astype(np.float32).tobytes() for t in pdf["t"]])[["k", "l", "x"]]

    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("l", T.StringType()),
                           T.StructField("x", T.BinaryType())])
    got = bounded_sample(rows, "k", train_rows).mapInPandas(features, schema).toPandas()
    if not len(got):
        return None
    got = got.assign(o=got["k"].astype(str)).sort_values(["o", "l"], kind="stable")
    labels = got["l"].astype(str).tolist()
    x = np.empty((len(got), buckets), np.float32)
    for i, v in enumerate(got.pop("x")):
        x[i] = np.frombuffer(v, np.float32)
    del got  # the driver keeps one copy of the sample
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    return train(x, labels)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text",
             prefix: str = "") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``rejected`` for every whole text."""
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])

    @F.pandas_udf(result)
    def predict(series):
        import pandas as pd
        names, scores, out = [], [], []
        for t in series:
            if model is None or t is None or not has_letter(t):
                names.append("und"), scores.append(0.0), out.append(True)
                continue
            z = model.logits(gram_counts(t, len(model.table)))
            p = _softmax(z)
            k = int(p.argmax())
            names.append(model.languages[k]), scores.append(float(p[k])), out.append(bool(log_odds(z) < model.reject_below))
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": out})

    held = f"{prefix}__language"
    got = docs.withColumn(held, predict(F.col(text)))
    new = {prefix + f: F.col(f"{held}.{f}").alias(prefix + f) for f in result.fieldNames()}
    return got.select(*[c for c in docs.columns if c not in new], *new.values())


