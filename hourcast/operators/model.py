"""Model preparation, fitting and recursive forecasting.

* Statistics (A83) and standardisation (A84) are aggregates joined back.
* A per-counter ridge model is fitted from additive moments: one aggregate
  pass builds Σx, Σxxᵀ, Σxy per counter (map-side combined); the small
  d×d system of each counter is then solved by numpy inside ``mapInPandas``
  over the moments table (one row per counter, never raw data).
* The recursive forecast (A32) is a SQL ``aggregate`` fold per counter: the
  state holds only the last ``max(ar, mm·roll)`` values (P17) and the
  predictions; each step builds the lag/mean features from the buffer (A31),
  applies the coefficients and appends.  No Python runs per step.

A counter has at most one row per hour, so its horizon is bounded by the
calendar (≤ 2,190 steps for a quarter of a year); the fold never holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed_columns(df: DataFrame, exclude: list[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and text feature columns from the schema; booleans,
    timestamps and other types are left out, as the reference's column
    transformer has no remainder."""
    num, txt = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            txt.append(f.name)
    return num, txt


def history_gate(train: DataFrame, keys: list[str], target: str, nb_ar: int, nb_mm: int,
                 roll: int) -> DataFrame:
    """Per key, the non-null history length against ``max(ar, mm·roll)``;
    keys below it are rejected with a reason instead of forecasting."""
    required = max(nb_ar, nb_mm * roll)
    g = train.groupBy(*keys).agg(F.count(target).alias("n_history"))
    return g.withColumns({
        "required": F.lit(required).cast("bigint"),
        "reject_reason": F.when(F.col("n_history") < required, F.lit("insufficient_history"))})


def feature_stats(df: DataFrame, keys: list[str], numeric: list[str],
                  categorical: list[str]) -> DataFrame:
    """Mean and **population** std per numeric feature, sorted category
    sets per categorical feature (MLlib's scaler uses the sample std)."""
    aggs = []
    for c in numeric:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    for c in categorical:
        aggs.append(F.array_sort(F.collect_set(c)).alias(f"{c}__levels"))
    return df.groupBy(*keys).agg(*aggs)


def standardize(df: DataFrame, stats: DataFrame, keys: list[str], numeric: list[str]) -> DataFrame:
    """``(x - mean) / std`` with a zero std replaced by 1."""
    j = df.join(stats, keys, "left")
    cols = {c: (F.col(c) - F.col(f"{c}__mean"))
            / F.coalesce(F.nullif(F.col(f"{c}__std"), F.lit(0.0)), F.lit(1.0)) for c in numeric}
    return j.withColumns(cols).drop(*[f"{c}__{s}" for c in numeric for s in ("mean", "std")])


def one_hot(df: DataFrame, col: str, levels: list[str], prefix: str | None = None) -> DataFrame:
    """One indicator per known level; an unseen level gives all zeros."""
    p = prefix or col
    return df.withColumns({f"{p}_{lv}": (F.col(col) == F.lit(lv)).cast("double") for lv in levels})


# ---------------------------------------------------------------- ridge fit

def moments(df: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Count, means and population (co)variances per key, as one aggregate.

    Spark merges centred moments, so large counts do not cancel digits."""
    d, y = len(features), F.col(target).cast("double")
    xs = [F.col(f).cast("double") for f in features]
    aggs = [F.count(F.lit(1)).alias("m_n"), F.avg(y).alias("m_y")]
    for i in range(d):
        aggs += [F.avg(xs[i]).alias(f"m_x{i}"), F.covar_pop(xs[i], y).alias(f"m_xy{i}")]
        aggs += [F.covar_pop(xs[i], xs[j]).alias(f"m_xx{i}_{j}") for j in range(i, d)]
    return df.groupBy(*keys).agg(*aggs)


def _solve(pdf: pd.DataFrame, d: int, lam: float) -> pd.DataFrame:
    """Ridge coefficients of all rows of moments in one batched solve."""
    n = pdf["m_n"].to_numpy(float)
    mean = pdf[[f"m_x{i}" for i in range(d)]].to_numpy(float)
    cov = np.empty((len(pdf), d, d))
    for i in range(d):
        for j in range(i, d):
            cov[:, i, j] = cov[:, j, i] = pdf[f"m_xx{i}_{j}"].to_numpy(float)
    std = np.sqrt(np.clip(np.einsum("kii->ki", cov), 0.0, None))
    std[std == 0] = 1.0                                   # A84: zero variance -> scale 1
    corr = cov / (std[:, :, None] * std[:, None, :])
    cxy = pdf[[f"m_xy{i}" for i in range(d)]].to_numpy(float) / std
    beta = np.linalg.solve(corr + (lam / n)[:, None, None] * np.eye(d), cxy[:, :, None])[:, :, 0] / std
    out = pdf[[k for k in pdf.columns if not k.startswith("m_")]].copy()
    out["intercept"] = pdf["m_y"].to_numpy(float) - (beta * mean).sum(axis=1)
    out["coef"] = list(beta)
    out["n_train"] = n.astype(np.int64)
    return out


def fit_ridge(df: DataFrame, keys: list[str], features: list[str], target: str,
              lam: float = 1.0) -> DataFrame:
    """A86 (linear): ridge on standardised features per key, returned on the
    raw scale as ``intercept`` + ``coef`` array (feature order kept)."""
    m = moments(df, keys, features, target)
    d = len(features)
    key_fields = [f for f in m.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [
        T.StructField("intercept", T.DoubleType()),
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("n_train", T.LongType())])

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield _solve(pdf, d, lam)

    return m.mapInPandas(solve, schema)


def ols_ar1(df: DataFrame, keys: list[str], x: str, y: str, lam: float = 0.0) -> DataFrame:
    """Closed-form (ridge) AR(1): ``b = Sxy / (Sxx + λ)``, ``a = ȳ - b x̄``
    from centred moments – pure SQL aggregates, so a DuckDB twin exists."""
    n = F.count(F.col(x))
    sx, sy = F.sum(x), F.sum(F.when(F.col(x).isNotNull(), F.col(y)))
    sxx = F.var_pop(F.col(x)) * n
    sxy = F.covar_pop(F.col(x), F.col(y)) * n
    g = df.groupBy(*keys).agg(n.alias("n_fit"), sx.alias("_sx"), sy.alias("_sy"),
                              (sxy / (sxx + F.lit(lam))).alias("b"))
    return g.withColumn("a", (F.col("_sy") - F.col("b") * F.col("_sx")) / F.col("n_fit")).drop("_sx", "_sy")


# ---------------------------------------------------------- recursive fold

def fold_steps(buffer: Column, horizon: Column, keep: int, predict) -> Column:
    """Generic recursive fold: ``predict(buf, i)`` gives step i's value from
    the buffer (last ``keep`` values); the value is appended and the buffer
    trimmed.  Returns the array of the ``horizon`` predictions."""
    def step(acc, i):
        pred = predict(acc["buf"], i)
        new_buf = F.slice(F.concat(acc["buf"], F.array(pred)), -keep, keep)
        return F.struct(new_buf.alias("buf"), F.concat(acc["preds"], F.array(pred)).alias("preds"))

    init = F.struct(F.slice(buffer.cast("array<double>"), -keep, keep).alias("buf"),
                    F.array().cast("array<double>").alias("preds"))
    steps = F.when(horizon >= 1, F.sequence(F.lit(1), horizon.cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(steps, init, step, lambda acc: acc["preds"])


def buffer_features(buf: Column, nb_ar: int, nb_mm: int, roll: int) -> list[Column]:
    """Lag and trailing-mean features of the next step from the buffer."""
    feats = [F.element_at(buf, -k) for k in range(1, nb_ar + 1)]
    for k in range(1, nb_mm + 1):
        w = k * roll
        feats.append(F.aggregate(F.slice(buf, -w, w), F.lit(0.0), lambda s, v: s + v) / F.lit(float(w)))
    return feats


def recursive_fold(buffer: Column, horizon: Column, intercept: Column, ar_coef: Column,
                   nb_ar: int, mm_coef: Column | None = None, nb_mm: int = 0, roll: int = 1,
                   exog: Column | None = None, exog_coef: Column | None = None) -> Column:
    """A31 + A32: ``horizon`` recursive one-step forecasts as an array.

    ``buffer`` is the known history (oldest first, at least
    ``max(nb_ar, nb_mm*roll)`` values, A33); ``exog`` an array (one entry per
    step) of exogenous feature arrays matched by ``exog_coef``.  Each step:
    ``pred = intercept + Σ ar_k·buf[-k] + Σ mm_k·mean(buf[-k·roll:]) + exog·β``;
    the buffer keeps only its last ``max(nb_ar, nb_mm·roll)`` values.
    """
    keep = max(nb_ar, nb_mm * roll, 1)
    zero = F.lit(0.0)

    def step(acc, i):
        buf = acc["buf"]
        pred = intercept
        for k in range(1, nb_ar + 1):
            pred = pred + F.element_at(ar_coef, k) * F.element_at(buf, -k)
        for k in range(1, nb_mm + 1):
            w = k * roll
            window = F.slice(buf, -w, w)
            mean = F.aggregate(window, zero, lambda s, v: s + v) / F.lit(float(w))
            pred = pred + F.element_at(mm_coef, k) * mean
        if exog is not None:
            row = F.element_at(exog, i)
            pred = pred + F.aggregate(F.arrays_zip(row.alias("x"), exog_coef.alias("c")), zero,
                                      lambda s, z: s + z["x"] * z["c"])
        new_buf = F.slice(F.concat(buf, F.array(pred)), -keep, keep)
        return F.struct(new_buf.alias("buf"), F.concat(acc["preds"], F.array(pred)).alias("preds"))

    init = F.struct(F.slice(buffer.cast("array<double>"), -keep, keep).alias("buf"),
                    F.array().cast("array<double>").alias("preds"))
    steps = F.when(horizon >= 1, F.sequence(F.lit(1), horizon.cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(steps, init, step, lambda acc: acc["preds"])


def tail_values(df: DataFrame, keys: list[str], order: str, value: str, k: int) -> DataFrame:
    """Last ``k`` values of each key, oldest first (bounded: ``k`` per key)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    last = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return last.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                          F.col(value).cast("double").alias("v")))),
                    lambda s: s["v"]).alias("buffer"))


# ------------------------------------------------------- tree ensembles

def tree_arrays(tree) -> dict:
    """Pre-order node arrays of a fitted MLlib regression tree (bounded by
    ``2^(depth+1)`` nodes): feature index, threshold, children, leaf flag and
    leaf value.  Binary categorical splits become ``x <= 0.5`` tests."""
    feat, thr, left, right, leaf, val = [], [], [], [], [], []

    def visit(node) -> int:
        i = len(feat)
        feat.append(0), thr.append(0.0), left.append(0), right.append(0)
        leaf.append(True), val.append(float(node.prediction()))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            leaf[i] = False
            feat[i] = int(split.featureIndex())
            kind = split.getClass().getSimpleName()
            lo, hi = visit(node.leftChild()), visit(node.rightChild())
            if kind == "ContinuousSplit":
                thr[i], left[i], right[i] = float(split.threshold()), lo, hi
            else:
                cats = sorted(float(c) for c in split.leftCategories())
                if cats == [0.0]:
                    thr[i], left[i], right[i] = 0.5, lo, hi
                elif cats == [1.0]:
                    thr[i], left[i], right[i] = 0.5, hi, lo
                else:
                    raise ValueError(f"unsupported categorical split {cats}")
        return i

    visit(tree._java_obj.rootNode())
    return {"feat": feat, "thr": thr, "left": left, "right": right, "leaf": leaf, "val": val}


def _descend(x, feat, thr, left, right, leaf):
    """One level of a tree walk: a leaf keeps its index, otherwise go to the
    child chosen by ``x[feature] <= threshold``."""
    def down(node, _):
        i = node + 1
        go_left = F.element_at(x, F.element_at(feat, i) + 1) <= F.element_at(thr, i)
        return F.when(F.element_at(leaf, i), node).when(go_left, F.element_at(left, i)) \
            .otherwise(F.element_at(right, i))
    return down


def ensemble_predict(x: Column, trees: list[dict], weights: list[float], max_depth: int) -> Column:
    """Σ wₜ·treeₜ(x) as a JVM expression: each tree walks ``max_depth`` levels
    over literal node arrays (a leaf keeps its index)."""
    total = F.lit(0.0)
    for t, w in zip(trees, weights):
        feat = F.array(*[F.lit(v) for v in t["feat"]])
        thr = F.array(*[F.lit(v) for v in t["thr"]])
        left = F.array(*[F.lit(v) for v in t["left"]])
        right = F.array(*[F.lit(v) for v in t["right"]])
        leaf = F.array(*[F.lit(v) for v in t["leaf"]])
        val = F.array(*[F.lit(v) for v in t["val"]])

        down = _descend(x, feat, thr, left, right, leaf)
        end = F.aggregate(F.sequence(F.lit(1), F.lit(max_depth)), F.lit(0), down)
        total = total + F.lit(float(w)) * F.element_at(val, end + 1)
    return total
