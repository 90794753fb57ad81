"""Boosting of many models at once against a plain re-computation model by model."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourcast.operators import boosting as B
from hourcast.sources import sinks as SK

PARAMS = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.4, "gamma": 0.02, "reg_alpha": 0.05, "reg_lambda": 0.7, "min_child_weight": 2}


def plain_boost(bins, y, train, p, n_features):
    """(predictions in millionths of all rows, splits {(tree, node): (feature, cut)}) of one model."""
    def soft(g):
        return max(abs(g / 1e6) - p["reg_alpha"], 0.0)

    def score(g, h):
        return soft(g) * soft(g) / (h + p["reg_lambda"])

    pred = np.full(len(y), int(y[train].sum()) * 1_000_000 // int(train.sum()), np.int64)
    splits = {}
    for t in range(int(p["n_estimators"])):
        node = np.ones(len(y), int)
        grad = pred - y * 1_000_000
        for level in range(int(p["max_depth"])):
            for n in range(1 << level, 2 << level):
                here = (node == n) & train
                g, h = int(grad[here].sum()), int(here.sum())
                ways = []
                for f in range(1, n_features + 1):
                    for b in sorted(set(bins[here, f - 1].tolist())):
                        left = here & (bins[:, f - 1] <= b)
                        gl, hl = int(grad[left].sum()), int(left.sum())
                        gain = 0.5 * (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) - p["gamma"]
                        if hl >= p["min_child_weight"] and h - hl >= p["min_child_weight"] and gain > 0:
                            ways.append((-gain, f, b))
                if ways:
                    _, f, b = min(ways)
                    splits[t, n] = f, b
                    at = node == n
                    node[at] = 2 * n + (bins[at, f - 1] > b)
        for n in set(node.tolist()):
            here = (node == n) & train
            if here.any():
                g, h = int(grad[here].sum()), int(here.sum())
                s = math.copysign(soft(g), g) if g else 0.0
                pred[node == n] += math.floor(-p["learning_rate"] * s / (h + p["reg_lambda"]) * 1e6 + 0.5)
    return pred, splits


def data(seed=5, keys=3, n=90, d=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(keys):
        x = rng.normal(size=(n, d))
        y = np.round(5 + 3 * x[:, 0] * (x[:, 1] > 0) + rng.normal(size=n)).clip(0).astype(int)
        out += [(f"c{k}", i + 1, int(y[i]), *[float(v) for v in x[i]]) for i in range(n)]
    return out


def binned(spark, rows, upto):
    names = [f"x{i}" for i in range(len(rows[0]) - 3)]
    df = spark.createDataFrame(rows, "counter_id string, pos int, y long, " + ", ".join(f"{c} double" for c in names))
    ranges = B.bin_ranges(df.filter(F.col("pos") <= upto), ["counter_id"], names)
    return df.join(ranges, "counter_id").select("counter_id", "pos", "y", B.bins_of(names).alias("bins")), names


def arrays(rows):
    got = sorted(rows, key=lambda r: r.pos)
    return np.array([r.bins for r in got]), np.array([r.y for r in got])


@pytest.mark.parametrize("change", [{}, {"max_depth": 1, "reg_alpha": 0.8}, {"n_estimators": 5, "gamma": 0.5}, {"min_child_weight": 12}])
def test_models_of_draws_and_folds_equal_plain_boosting(spark, change):
    rows, names = binned(spark, data(), 90)
    params = PARAMS | change
    draws = spark.createDataFrame([(f"c{k}", d) for k in range(3) for d in range(2)], "counter_id string, draw int").withColumns(
        {k: F.lit(float(v)) + (F.col("draw") * 0.1 if k == "learning_rate" else 0.0) for k, v in params.items()})
    sizes = rows.groupBy("counter_id").agg(F.count("*").alias("n"))
    models = B.fold_models(sizes, draws, ["counter_id"], 3)
    trees, state = B.fit(rows, models, ["counter_id"], len(names))
    found = {}
    for r in trees.collect():
        for i, f in enumerate(r.feature):
            if f:
                found.setdefault((r.counter_id, r.model), {})[r.tree, i + 1] = (f, r.cut[i])
    by = {}
    for r in state.collect():
        by.setdefault((r.counter_id, r.model), {})[r.pos] = r.pred
    scores = {(r.counter_id, r.draw): (r.score, r.n_folds) for r in B.fold_scores(state, models, ["counter_id"]).collect()}
    everything = rows.collect()
    for key in ("c0", "c1", "c2"):
        bins, y = arrays([r for r in everything if r.counter_id == key])
        for draw in (0, 1):
            errors = []
            for fold in range(3):
                until = 90 - (2 - fold) * (90 // 4)
                upto = until - 90 // 4
                pred, splits = plain_boost(bins[:until], y[:until], np.arange(until) < upto,
                                           params | {"learning_rate": params["learning_rate"] + draw * 0.1}, len(names))
                assert found.get((key, draw * 3 + fold), {}) == splits
                assert [by[key, draw * 3 + fold][i + 1] for i in range(until)] == pred.tolist()
                errors.append(-np.mean((pred[upto:] / 1e6 - y[upto:until]) ** 2))
            score, folds = scores[key, draw]
            assert folds == 3 and abs(score - np.mean(errors)) < 1e-9


def whole_models(spark, rows, **params):
    return rows.groupBy("counter_id").agg(F.max("pos").alias("upto")).withColumns(
        {"until": F.col("upto"), "model": F.lit(0), **{k: F.lit(v) for k, v in params.items()}})


def test_trees_do_not_depend_on_partitions_and_predict_what_was_fitted(spark):
    rows, names = binned(spark, data(9), 90)
    out = []
    for n in (1, 7):
        params = PARAMS | {"subsample": 0.8, "colsample_bytree": 0.7}
        trees, state = B.fit(rows.repartition(n), whole_models(spark, rows, **params), ["counter_id"], len(names))
        out.append(sorted(map(tuple, trees.collect()), key=repr))
        again = B.predict(rows, trees, ["counter_id"], 3).join(state.select("counter_id", "pos", F.col("pred").alias("p")), ["counter_id", "pos"])
        assert again.count() == 270 and again.filter("pred <> p").count() == 0
    assert out[0] == out[1]
    used = {f for r in out[0] for f in r[4] if f}
    assert used and all(len({f for f in r[4] if f}) <= 2 for r in out[0])  # 0.7 of three features


def test_fits_better_with_more_trees_and_never_past_its_rounds(spark):
    rows, names = binned(spark, data(11), 90)
    both = whole_models(spark, rows, **PARAMS).unionByName(
        whole_models(spark, rows, **(PARAMS | {"n_estimators": 8})).withColumn("model", F.lit(1)))
    trees, state = B.fit(rows, both, ["counter_id"], len(names))
    assert {(r.model, r["n"]) for r in trees.groupBy("model", "counter_id").agg(F.countDistinct("tree").alias("n")).collect()} == {(0, 3), (1, 8)}
    mse = {r.model: r.m for r in state.groupBy("model").agg(F.avg(F.pow(F.col("pred") / 1e6 - F.col("y"), 2)).alias("m")).collect()}
    assert mse[1] < mse[0]


def test_constant_null_and_outside_values(spark):
    rows = [("a", i, i % 3, 1.0, None if i % 4 == 0 else float(i)) for i in range(1, 21)] + [("a", 21, 1, 9.0, 500.0), ("a", 22, 1, -9.0, -500.0)]
    got, names = binned(spark, rows, 20)
    bins = {r.pos: r.bins for r in got.collect()}
    assert bins[4] == [0, -1] and bins[21] == [0, B.N_BINS - 1] and bins[22] == [0, 0] and bins[1][1] == 0
    trees, _ = B.fit(got.filter("pos <= 20"), whole_models(spark, got.filter("pos <= 20"), **PARAMS), ["counter_id"], 2)
    assert trees.count() == 3
    assert B.predict(got, trees, ["counter_id"], 3).count() == 22


def test_no_rows_and_no_rounds(spark):
    rows, names = binned(spark, data(), 90)
    trees, state = B.fit(rows.limit(0), whole_models(spark, rows.limit(0), **PARAMS), ["counter_id"], len(names))
    assert trees.count() == 0 and state.count() == 0
    trees, state = B.fit(rows, whole_models(spark, rows, **(PARAMS | {"n_estimators": 0})), ["counter_id"], len(names))
    means = {r.counter_id: r.m for r in rows.groupBy("counter_id").agg(F.avg("y").alias("m")).collect()}
    assert all(abs(r.pred / 1e6 - means[r.counter_id]) < 1e-6 for r in state.collect())


def test_saved_versions_are_found_and_unfinished_ones_are_not(spark, scratch):
    path = os.path.join(scratch, "model")
    assert SK.latest_version(spark, path) is None
    with pytest.raises(ValueError):
        SK.load_model(spark, path)
    for v in (1, 2):
        assert SK.save_model(path, {"trees": spark.range(v), "params": spark.range(10 * v)}) == v
    spark.range(99).write.parquet(f"{path}/version=3/trees")  # a run that was lost before its marker
    assert SK.load_model(spark, path)["trees"].count() == 2
    assert {k: v.count() for k, v in SK.load_model(spark, path, 1).items()} == {"trees": 1, "params": 10}
    assert SK.save_model(path, {"trees": spark.range(3)}) == 3 and SK.load_model(spark, path)["trees"].count() == 3
    with pytest.raises(ValueError):
        SK.load_model(spark, path, 7)
