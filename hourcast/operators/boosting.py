"""Histogram boosting of many small models at once.

One model is one (key, model) pair, for example a counter, a draw of the search
space and a fold.  All models grow together: every level of a tree is one
aggregate of (gradient, rows) per (model, node, feature, bin), one running sum
over the bins and one maximum per node.  The rows of all models are hash
partitioned and sorted by (key, model) once per tree, and the join with the
growing trees, the aggregate, the running sum and the maximum all keep that
partitioning, so a level moves no rows.  The driver only counts levels.

Gradients are whole millionths: sums do not depend on the order of rows or
partitions, every engine and every rerun grows the same trees, and ties go to
the smaller feature and bin.  With squared loss, gradient sums G and row counts
H, soft(G) = sign(G) max(|G| - reg_alpha, 0):

* score(G, H) = soft(G)^2 / (H + reg_lambda)
* gain = (score(left) + score(right) - score(node)) / 2 - gamma, above 0, with
  at least ``min_child_weight`` rows on each side
* leaf = -learning_rate soft(G) / (H + reg_lambda)

Features are cut into ``N_BINS`` equal parts of the key's training range; a
value outside goes to the nearest part, a null to bin -1, which is always left.
A model takes ``subsample`` of the rows and ``colsample_bytree`` of the features
of each tree by hash.

Trees are rows: arrays over heap-numbered nodes (root 1, children 2n, 2n + 1)
with feature (0: leaf), bin and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.operators.search import unit_draw
from hourcast.sources.tables import materialize

N_BINS = 32
MICRO = 1_000_000
#: Defaults of the parameters that a models table may leave out.
DEFAULTS = {"n_estimators": 4.0, "max_depth": 3.0, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0,
            "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 1.0, "min_child_weight": 1.0}


def bin_ranges(train: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``(keys, lows, highs)``: the range of each feature over the training rows of a key."""
    xs = [F.col(f).cast("double") for f in features]
    return train.groupBy(*keys).agg(F.array(*[F.min(x) for x in xs]).alias("lows"),
                                    F.array(*[F.max(x) for x in xs]).alias("highs"))


def bins_of(features: list[str], lows: str = "lows", highs: str = "highs") -> Column:
    """The bin of each feature's value, as an array."""
    out = []
    for i, f in enumerate(features, 1):
        x, lo, hi = F.col(f).cast("double"), F.element_at(lows, i), F.element_at(highs, i)
        part = F.floor((x - lo) / (hi - lo) * N_BINS).cast("int")
        out.append(F.when(x.isNull(), -1).when((hi > lo) & (x >= hi), N_BINS - 1).when((hi > lo) & (x > lo), part).otherwise(0))
    return F.array(*out)


def score(g: Column, h: Column) -> Column:
    """``soft(G)^2 / (H + reg_lambda)`` with G in millionths."""
    s = F.greatest(F.abs(g / MICRO) - F.col("reg_alpha"), F.lit(0.0))
    return s * s / (h + F.col("reg_lambda"))


def leaf_value(g: Column, h: Column, p) -> Column:
    """The leaf's step in millionths (0 for a node without rows)."""
    s = F.signum(g / MICRO) * F.greatest(F.abs(g / MICRO) - p["reg_alpha"], F.lit(0.0))
    return F.when(h > 0, F.floor(-p["learning_rate"] * s / (h + p["reg_lambda"]) * MICRO + 0.5).cast("long")).otherwise(
        F.lit(0).cast("long"))


def walk(bins: Column, feature: Column, cut: Column, levels: int | Column) -> Column:
    """The node that a row reaches in at most ``levels`` steps from the root."""
    def down(n, _):
        f = F.get(feature, n - 1)
        return F.when(F.coalesce(f, F.lit(0)) == 0, n).otherwise(
            2 * n + F.when(F.element_at(bins, f) > F.element_at(cut, n), 1).otherwise(0))
    steps = F.sequence(F.lit(1), levels) if isinstance(levels, Column) else F.array(*[F.lit(i) for i in range(levels)])
    return F.aggregate(steps, F.lit(1), down)


def with_defaults(models: DataFrame) -> DataFrame:
    return models.withColumns({k: F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in models.columns else F.lit(v)
                               for k, v in DEFAULTS.items()})


def start(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of all models: ``(keys, model, pos, y, bins, train, pred)``.

    ``models(keys, model, upto, until)``: positions up to ``upto`` are trained on,
    those after it up to ``until`` are only predicted.  Predictions start from
    the mean of the training rows.
    """
    own = rows.join(models.select(*keys, "model", "upto", "until"), keys).filter("pos <= until")
    own = own.withColumn("train", F.col("pos") <= F.col("upto"))
    of_model = Window.partitionBy(*keys, "model")
    seen = F.sum(F.when(F.col("train"), F.col("y"))).over(of_model) * MICRO
    n = F.sum(F.when(F.col("train"), 1)).over(of_model)
    return own.select(*keys, "model", "pos", "y", "bins", "train", seen.alias("s"), n.alias("n")).selectExpr(
        *keys, "model", "pos", "y", "bins", "train", "coalesce(s div n, 0L) AS pred")


def grow_tree(state: DataFrame, models: DataFrame, keys: list[str], n_features: int, tree: int, depth: int,
              seed: int = 1) -> DataFrame:
    """``(keys, model, parameters, feature, cut, value)``: one tree of every model still growing."""
    by = [*keys, "model"]
    lots = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n_features)),
                                    lambda f: F.struct(unit_draw(F.lit(seed), *[F.col(k) for k in by], F.lit(tree), F.lit("feature"), f).alias("lot"),
                                                       f.alias("f"))))
    taken = F.greatest(F.floor(F.col("colsample_bytree") * n_features), F.lit(1)).cast("int")
    empty_long = F.array(F.lit(None).cast("long"))
    grown = models.filter(F.col("n_estimators") > tree).select(
        *by, *DEFAULTS, F.transform(F.slice(lots, F.lit(1), taken), lambda x: x["f"]).alias("allowed"),
        F.array().cast("array<int>").alias("feature"), F.array().cast("array<int>").alias("cut"),
        empty_long.alias("g"), empty_long.alias("h"))
    sampled = state.filter(F.col("train") & ((F.col("__subsample") >= 1.0) | (
        unit_draw(F.lit(seed), *[F.col(k) for k in by], F.lit(tree), F.col("pos")) < F.col("__subsample"))))
    for level in range(depth):
        lo, hi = 1 << level, (1 << (level + 1)) - 1
        at = sampled.join(grown.drop("subsample"), by).filter(F.col("max_depth") > level)
        at = at.withColumn("node", walk(F.col("bins"), F.col("feature"), F.col("cut"), level)).filter(F.col("node") >= lo)
        cells = at.select(*by, "node", (F.col("pred") - F.col("y") * MICRO).alias("grad"), *DEFAULTS.keys() - {"subsample"},
                          F.explode(F.transform("allowed", lambda f: F.struct(
                              f.alias("f"), F.element_at(F.col("bins"), f).alias("b")))).alias("x"))
        params = [F.first(c).alias(c) for c in ("gamma", "reg_alpha", "reg_lambda", "min_child_weight")]
        cells = cells.groupBy(*by, "node", F.col("x.f").alias("f"), F.col("x.b").alias("b")).agg(
            F.sum("grad").alias("cg"), F.count(F.lit(1)).alias("ch"), *params)
        line = Window.partitionBy(*by, "node", "f")
        upto = line.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumns({"gl": F.sum("cg").over(upto), "hl": F.sum("ch").over(upto),
                                   "g": F.sum("cg").over(line), "h": F.sum("ch").over(line)})
        gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
        gain = 0.5 * (score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("g"), F.col("h"))) - F.col("gamma")
        fits = (F.col("hl") >= F.col("min_child_weight")) & (hr >= F.col("min_child_weight")) & (gain > 0)
        best = cells.groupBy(*by, "node").agg(
            F.max(F.when(fits, F.struct(gain.alias("gain"), (-F.col("f")).alias("nf"), (-F.col("b")).alias("nb"),
                                        F.col("gl").alias("gl"), F.col("hl").alias("hl")))).alias("split"),
            F.first("g").alias("g"), F.first("h").alias("h"))
        found = best.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(
            "node", F.struct("split", "g", "h")))).alias("nodes"))  # at most 2^level entries
        grown = grown.join(found, by, "left")
        here = F.sequence(F.lit(lo), F.lit(hi))

        def value(n, field):
            return F.get(F.transform(F.array(F.element_at(F.col("nodes"), n)), lambda e: e["split"][field]), 0)

        def children(part, total):
            return F.flatten(F.transform(here, lambda n: F.array(value(n, part), F.element_at(F.col("nodes"), n)[total] - value(n, part))))

        root = level == 0
        grown = materialize(grown.select(
            *by, *DEFAULTS, "allowed",
            F.concat("feature", F.transform(here, lambda n: F.coalesce(-value(n, "nf"), F.lit(0)))).alias("feature"),
            F.concat("cut", F.transform(here, lambda n: F.coalesce(-value(n, "nb"), F.lit(0)))).alias("cut"),
            F.concat(F.array(F.element_at(F.col("nodes"), 1)["g"]) if root else F.col("g"), children("gl", "g")).alias("g"),
            F.concat(F.array(F.element_at(F.col("nodes"), 1)["h"]) if root else F.col("h"), children("hl", "h")).alias("h")))
        if not grown.filter(F.exists(F.slice("feature", lo, hi), lambda f: f > 0)).limit(1).count():
            break
    one = F.array(F.lit(0).cast("long"))
    nodes = F.arrays_zip(F.col("g").alias("g"), F.col("h").alias("h"), F.col("feature").alias("f")) if depth else one
    values = F.transform(nodes, lambda e: F.when(F.coalesce(e["f"], F.lit(0)) > 0, F.lit(0).cast("long")).otherwise(
        leaf_value(e["g"], F.coalesce(e["h"], F.lit(0).cast("long")), {c: F.col(c) for c in DEFAULTS}))) if depth else one
    return grown.select(*by, "feature", "cut", values.alias("value"))


def fit(rows: DataFrame, models: DataFrame, keys: list[str], n_features: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Boost all ``models`` on ``rows(keys, pos, y, bins)``: (trees, predicted rows).

    Trees are ``(keys, model, tree, base, feature, cut, value)``; the predicted rows
    hold ``pred`` in millionths for the trained and the following positions.
    """
    by = [*keys, "model"]
    models = materialize(with_defaults(models))
    limits = models.agg(F.max("n_estimators"), F.max("max_depth")).first()
    rounds, depth = int(limits[0] or 0), int(limits[1] or 0)
    state = start(rows, models, keys).join(models.select(*by, F.col("subsample").alias("__subsample")), by)

    def settled(df: DataFrame) -> DataFrame:
        return materialize(df.repartition(*by).sortWithinPartitions(*by))

    state = settled(state)
    bases = state.groupBy(*by).agg(F.first("pred").alias("base"))
    trees = None
    for t in range(rounds):
        tree = materialize(grow_tree(state, models, keys, n_features, t, depth, seed))
        end = F.element_at(F.col("value"), walk(F.col("bins"), F.col("feature"), F.col("cut"), depth))
        state = settled(state.join(tree, by, "left").withColumn("pred", F.col("pred") + F.coalesce(end, F.lit(0).cast("long")))
                        .drop("feature", "cut", "value"))
        tree = tree.withColumn("tree", F.lit(t))
        trees = tree if trees is None else trees.unionByName(tree)
    if trees is None:
        trees = models.select(*by, *[F.array().cast(t).alias(c) for c, t in (("feature", "array<int>"), ("cut", "array<int>"),
                                                                             ("value", "array<bigint>"))], F.lit(0).alias("tree"))
    return trees.join(bases, by).select(*by, "tree", "base", "feature", "cut", "value"), state.drop("__subsample")


def predict(rows: DataFrame, trees: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """``rows(keys, bins, ...)`` with ``model`` and ``pred`` (millionths) of every model of their key.

    A model's trees are one bounded row (``n_estimators`` times 2^(depth + 1) nodes).
    """
    whole = trees.groupBy(*keys, "model", "base").agg(F.collect_list(F.struct("feature", "cut", "value")).alias("trees"))
    total = F.aggregate("trees", F.col("base"), lambda s, t: s + F.element_at(t["value"], walk(F.col("bins"), t["feature"], t["cut"], depth)))
    return rows.join(whole, keys).withColumn("pred", total).drop("trees", "base")


def fold_models(sizes: DataFrame, draws: DataFrame, keys: list[str], n_splits: int = 5) -> DataFrame:
    """One model per (key, draw, expanding fold): ``sizes(keys, n)`` rows, the draws' parameters."""
    width = F.floor(F.col("n") / (n_splits + 1))
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    return (draws.join(sizes, keys).withColumn("fold", fold)
            .withColumn("until", F.col("n") - (n_splits - 1 - F.col("fold")) * width).withColumn("upto", F.col("until") - width)
            .withColumn("model", (F.col("draw") * n_splits + F.col("fold")).cast("int")))


def fold_scores(state: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, draw, score, n_folds)``: mean over the folds of the negative mean squared error."""
    e = (F.col("pred") - F.col("y") * MICRO) / float(MICRO)
    each = state.filter(~F.col("train")).join(models.select(*keys, "model", "draw", "fold"), [*keys, "model"]).groupBy(
        *keys, "draw", "fold").agg((-F.avg(e * e)).alias("s"))
    return each.groupBy(*keys, "draw").agg(F.avg("s").alias("score"), F.count(F.lit(1)).alias("n_folds"))
