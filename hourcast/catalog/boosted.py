"""Boosted-tree queries: fitted trees, scored search draws, saved models and their scores."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.functions.numeric import round_scaled
from hourcast.operators import boosting as B
from hourcast.operators import search as SE
from hourcast.operators import sequence as seq
from hourcast.session import ensure_checkpoint_dir
from hourcast.sources import sinks as SK
from hourcast.sources.tables import counts, materialize, with_views

FAM = "model"
KEYS = ["counter_id"]
NB_AR, NB_MM, ROLL = 3, 1, 4
FEATURES = [f"target_ar_{k}" for k in range(1, NB_AR + 1)] + [f"target_mm_{ROLL}_1"]
RATIO = 0.25
#: One model per counter: two trees of two levels.
SMALL_MODEL = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3, "gamma": 0.05, "reg_alpha": 0.1, "reg_lambda": 1.0,
               "min_child_weight": 2}
#: The search scores this many draws per counter, with a two-hundredth of the drawn trees.
SEARCH_DRAWS, TREE_SHARE = 4, 200


def binned(spark, sf_dir):
    """Complete rows of every counter with their bins (training ranges) and, for the training rows, their position."""
    c = seq.add_ar_features(seq.time_split(counts(spark, sf_dir), RATIO), NB_AR, NB_MM, ROLL)
    whole = materialize(seq.complete_case(c, FEATURES))  # read for the ranges and the bins
    ranges = B.bin_ranges(whole.filter(~F.col("is_test")), KEYS, FEATURES)
    rows = whole.join(ranges, KEYS).select("counter_id", "ts_utc", "is_test", F.row_number().over(seq.series_window()).alias("pos"),
                                           F.col("hourly_count").alias("y"), B.bins_of(FEATURES).alias("bins"))
    return materialize(rows), ranges


def sizes(rows):
    return rows.filter(~F.col("is_test")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def fit_small(rows):
    models = sizes(rows).select(*KEYS, F.lit(0).alias("model"), F.col("n").alias("upto"), F.col("n").alias("until"),
                                *[F.lit(v).alias(k) for k, v in SMALL_MODEL.items()])
    return B.fit(rows.filter(~F.col("is_test")), models, KEYS, len(FEATURES))


def _soft(g: str) -> str:
    return f"greatest(abs(CAST({g} AS DOUBLE) / 1000000::DOUBLE) - {SMALL_MODEL['reg_alpha']}::DOUBLE, 0::DOUBLE)"


def _score(g: str, h: str) -> str:
    return f"({_soft(g)} * {_soft(g)} / ({h} + {SMALL_MODEL['reg_lambda']}::DOUBLE))"


def _trees_sql() -> str:
    """The CTEs of the small model: rows, splits per level, leaves, and all rows walked down each tree."""
    series = "OVER (PARTITION BY counter_id ORDER BY ts_utc)"
    frame = f"OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN {ROLL} PRECEDING AND 1 PRECEDING)"
    lows = ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FEATURES)
    bins = ", ".join(
        f"CASE WHEN hi_{f} > lo_{f} AND {f} >= hi_{f} THEN {B.N_BINS - 1} WHEN hi_{f} > lo_{f} AND {f} > lo_{f} "
        f"THEN CAST(floor(({f} - lo_{f}) / (hi_{f} - lo_{f}) * {B.N_BINS}) AS INT) ELSE 0 END" for f in FEATURES)
    out = f""",
f0 AS (
  SELECT *, row_number() {series} AS rn, count(*) OVER (PARTITION BY counter_id) AS n,
    {", ".join(f"CAST(lag(hourly_count, {k}) {series} AS DOUBLE) AS target_ar_{k}" for k in range(1, NB_AR + 1))},
    CASE WHEN count(*) {frame} = {ROLL} THEN avg(hourly_count) {frame} END AS target_mm_{ROLL}_1 FROM counts),
f1 AS (
  SELECT *, rn > n - CAST(floor(CAST(n AS DOUBLE) * {RATIO}) AS BIGINT) AS is_test FROM f0
  WHERE {" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)}),
ranges AS (SELECT counter_id, {lows} FROM f1 WHERE NOT is_test GROUP BY counter_id),
binned AS (SELECT counter_id, ts_utc, is_test, hourly_count AS y, [{bins}] AS bins FROM f1 JOIN ranges USING (counter_id)),
bases AS (SELECT counter_id, CAST(sum(y) * 1000000 // count(*) AS BIGINT) AS base FROM binned WHERE NOT is_test GROUP BY counter_id),
p0 AS (SELECT *, base AS pred FROM binned JOIN bases USING (counter_id))"""
    for t in range(SMALL_MODEL["n_estimators"]):
        out += f",\nn{t}_0 AS (SELECT *, 1 AS node FROM p{t})"
        for level in range(SMALL_MODEL["max_depth"]):
            left, whole = "PARTITION BY counter_id, node, f ORDER BY b", "PARTITION BY counter_id, node, f"
            out += f""",
c{t}_{level} AS (
  SELECT counter_id, node, f, bins[f] AS b, sum(pred - y * 1000000) AS cg, count(*) AS ch
  FROM (SELECT *, unnest(range(1, {len(FEATURES) + 1})) AS f FROM n{t}_{level} WHERE NOT is_test AND node >= {1 << level}) GROUP BY ALL),
g{t}_{level} AS (
  SELECT counter_id, node, f, b, sum(cg) OVER ({left}) AS gl, sum(ch) OVER ({left}) AS hl, sum(cg) OVER ({whole}) AS g, sum(ch) OVER ({whole}) AS h
  FROM c{t}_{level}),
s{t}_{level} AS (
  SELECT counter_id, node, f, b FROM (
    SELECT *, row_number() OVER (PARTITION BY counter_id, node ORDER BY gain DESC, f, b) AS place FROM (
      SELECT *, 0.5::DOUBLE * ({_score("gl", "hl")} + {_score("(g - gl)", "(h - hl)")} - {_score("g", "h")}) - {SMALL_MODEL["gamma"]}::DOUBLE AS gain
      FROM g{t}_{level} WHERE hl >= {SMALL_MODEL["min_child_weight"]} AND h - hl >= {SMALL_MODEL["min_child_weight"]}) WHERE gain > 0)
  WHERE place = 1),
n{t}_{level + 1} AS (
  SELECT n.* EXCLUDE node, CASE WHEN s.f IS NULL THEN n.node ELSE 2 * n.node + CASE WHEN n.bins[s.f] > s.b THEN 1 ELSE 0 END END AS node
  FROM n{t}_{level} n LEFT JOIN s{t}_{level} s ON s.counter_id = n.counter_id AND s.node = n.node)"""
        end = f"n{t}_{SMALL_MODEL['max_depth']}"
        out += f""",
l{t} AS (
  SELECT counter_id, node, CAST(floor(-{SMALL_MODEL["learning_rate"]}::DOUBLE * (sign(g) * {_soft("g")}) / (h + {SMALL_MODEL["reg_lambda"]}::DOUBLE) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS value
  FROM (SELECT counter_id, node, sum(pred - y * 1000000) AS g, count(*) AS h FROM {end} WHERE NOT is_test GROUP BY ALL)),
p{t + 1} AS (SELECT n.* EXCLUDE (node, pred), n.pred + coalesce(value, 0) AS pred FROM {end} n LEFT JOIN l{t} USING (counter_id, node))"""
    return out


TREES_SQL = with_views("counts") + _trees_sql()


@query("boosted_trees", TREES_SQL + "\n" + "\nUNION ALL ".join(
    f"SELECT counter_id, {t} AS tree, node, CAST(f AS INT) AS feature, CAST(b AS INT) AS cut, 0::BIGINT AS value FROM s{t}_{level}"
    for t in range(SMALL_MODEL["n_estimators"]) for level in range(SMALL_MODEL["max_depth"])) + "".join(
    f"\nUNION ALL SELECT counter_id, {t}, node, 0, 0, value FROM l{t} WHERE value <> 0" for t in range(SMALL_MODEL["n_estimators"])), FAM)
def boosted_trees(spark, sf_dir):
    """One boosted model per counter, all grown together; its splits and leaves as rows."""
    rows, _ = binned(spark, sf_dir)
    trees, _ = fit_small(rows)
    nodes = trees.select("counter_id", "tree", F.posexplode(F.arrays_zip("feature", "cut", "value")).alias("i", "x"))
    return nodes.filter("coalesce(x.feature, 0) > 0 OR x.value <> 0").select(
        "counter_id", "tree", (F.col("i") + 1).alias("node"), F.coalesce("x.feature", F.lit(0)).alias("feature"),
        F.coalesce("x.cut", F.lit(0)).alias("cut"), "x.value")


@query("boosted_scores", TREES_SQL + f"""
SELECT counter_id, ts_utc, is_test, y AS y_true, round(pred / 1000000::DOUBLE, 6) AS y_pred FROM p{SMALL_MODEL["n_estimators"]}""", FAM)
def boosted_scores(spark, sf_dir):
    """A95 + A90: the fitted models saved as versioned tables with parameters
    and metrics, loaded again by path, and all rows scored by what was loaded."""
    rows, ranges = binned(spark, sf_dir)
    trees, fitted = fit_small(rows)
    e = (F.col("pred") - F.col("y") * B.MICRO) / float(B.MICRO)
    metrics = fitted.groupBy(*KEYS).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    metrics = metrics.unpivot(KEYS, ["rmse", "mae"], "metric", "value")
    params = sizes(rows).select(*KEYS, F.explode(F.create_map(*[x for k, v in SMALL_MODEL.items() for x in (F.lit(k), F.lit(float(v)))]))
                                .alias("parameter", "value"))
    path = os.path.join(ensure_checkpoint_dir(spark), f"models-{uuid.uuid4().hex}")
    SK.save_model(path, {"trees": trees, "ranges": ranges, "params": params, "metrics": metrics})
    saved = SK.load_model(spark, path)
    c = seq.add_ar_features(seq.time_split(counts(spark, sf_dir), RATIO), NB_AR, NB_MM, ROLL)
    new = seq.complete_case(c, FEATURES).join(saved["ranges"], KEYS).select(
        "counter_id", "ts_utc", "is_test", F.col("hourly_count").alias("y_true"), B.bins_of(FEATURES).alias("bins"))
    scored = B.predict(new, saved["trees"], KEYS, SMALL_MODEL["max_depth"])
    return scored.select("counter_id", "ts_utc", "is_test", "y_true", round_scaled(F.col("pred") / float(B.MICRO), 6).alias("y_pred"))


def _lot_sql(*parts: str) -> str:
    text = ", ".join(["'1'", "counter_id", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT) / 4294967296::DOUBLE"


def _search_sql() -> str:
    """All models of the search, tree by tree and level by level."""
    from hourcast.catalog.models import _draw_sql
    rounds, depth = (int(next(p[3] for p in SE.SEARCH_SPACE if p[0] == name)) for name in ("n_estimators", "max_depth"))
    rounds //= TREE_SHARE
    soft = "greatest(abs(CAST({g} AS DOUBLE) / 1000000::DOUBLE) - reg_alpha, 0::DOUBLE)"

    def score(g, h):
        return f"({soft.format(g=g)} * {soft.format(g=g)} / ({h} + reg_lambda))"

    params = "gamma, reg_alpha, reg_lambda, min_child_weight"
    out = TREES_SQL[:TREES_SQL.index(",\nbases AS (")] + f""",
train AS MATERIALIZED (SELECT counter_id, y, bins, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS pos FROM binned WHERE NOT is_test),
d AS (SELECT counter_id, draw, {", ".join(_draw_sql(*p) for p in SE.SEARCH_SPACE)}
      FROM (SELECT counter_id, unnest(range(0, {SEARCH_DRAWS})) AS draw FROM (SELECT DISTINCT counter_id FROM train))),
models AS MATERIALIZED (
  SELECT d.* EXCLUDE n_estimators, floor(n_estimators / {TREE_SHARE}) AS n_estimators, fold, CAST(draw * 5 + fold AS INT) AS model,
         n - (4 - fold) * (n // 6) AS until, n - (5 - fold) * (n // 6) AS upto
  FROM d JOIN (SELECT counter_id, count(*) AS n FROM train GROUP BY 1) USING (counter_id), range(0, 5) AS t(fold)),
p0 AS MATERIALIZED (
  SELECT *, CAST(coalesce(sum(CASE WHEN train THEN y END) OVER m * 1000000 // sum(CASE WHEN train THEN 1 END) OVER m, 0) AS BIGINT) AS pred
  FROM (SELECT counter_id, model, pos, y, bins, pos <= upto AS train FROM train JOIN models USING (counter_id) WHERE pos <= until)
  WINDOW m AS (PARTITION BY counter_id, model))"""
    for t in range(rounds):
        out += f""",
a{t} AS MATERIALIZED (
  SELECT counter_id, model, f, max_depth, {params} FROM (
    SELECT *, row_number() OVER (PARTITION BY counter_id, model ORDER BY {_lot_sql("model", str(t), "'feature'", "f")}, f) AS place
    FROM models, range(1, {len(FEATURES) + 1}) AS g(f) WHERE n_estimators > {t})
  WHERE place <= greatest(floor(colsample_bytree * {len(FEATURES)}), 1)),
n{t}_0 AS MATERIALIZED (
  SELECT p.*, 1 AS node, train AND (subsample >= 1 OR {_lot_sql("model", str(t), "pos")} < subsample) AS used
  FROM p{t} p JOIN models USING (counter_id, model))"""
        for level in range(depth):
            left, whole = "PARTITION BY counter_id, model, node, f ORDER BY b", "PARTITION BY counter_id, model, node, f"
            out += f""",
s{t}_{level} AS MATERIALIZED (
  WITH c AS (
    SELECT n.counter_id, n.model, node, f, bins[f] AS b, {params}, sum(pred - y * 1000000) AS cg, count(*) AS ch
    FROM n{t}_{level} n JOIN a{t} a ON a.counter_id = n.counter_id AND a.model = n.model
    WHERE used AND node >= {1 << level} AND max_depth > {level} GROUP BY ALL),
  g AS (SELECT *, sum(cg) OVER ({left}) AS gl, sum(ch) OVER ({left}) AS hl, sum(cg) OVER ({whole}) AS g, sum(ch) OVER ({whole}) AS h FROM c)
  SELECT counter_id, model, node, f, b FROM (
    SELECT *, row_number() OVER (PARTITION BY counter_id, model, node ORDER BY gain DESC, f, b) AS place FROM (
      SELECT *, 0.5::DOUBLE * ({score("gl", "hl")} + {score("(g - gl)", "(h - hl)")} - {score("g", "h")}) - gamma AS gain
      FROM g WHERE hl >= min_child_weight AND h - hl >= min_child_weight) WHERE gain > 0) WHERE place = 1),
n{t}_{level + 1} AS MATERIALIZED (
  SELECT n.* EXCLUDE node, CASE WHEN s.f IS NULL THEN n.node ELSE 2 * n.node + CASE WHEN n.bins[s.f] > s.b THEN 1 ELSE 0 END END AS node
  FROM n{t}_{level} n LEFT JOIN s{t}_{level} s ON s.counter_id = n.counter_id AND s.model = n.model AND s.node = n.node)"""
        out += f""",
l{t} AS MATERIALIZED (
  SELECT counter_id, model, node,
         CAST(floor(-learning_rate * (sign(g) * {soft.format(g="g")}) / (h + reg_lambda) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS value
  FROM (SELECT counter_id, model, node, sum(pred - y * 1000000) AS g, count(*) AS h FROM n{t}_{depth} WHERE used GROUP BY ALL)
  JOIN models USING (counter_id, model) WHERE n_estimators > {t}),
p{t + 1} AS MATERIALIZED (
  SELECT n.* EXCLUDE (node, pred, used), n.pred + coalesce(value, 0) AS pred FROM n{t}_{depth} n LEFT JOIN l{t} USING (counter_id, model, node))"""
    e = "(CAST(pred - y * 1000000 AS DOUBLE) / 1000000::DOUBLE)"
    return out + f""",
folds AS (SELECT counter_id, draw, fold, -avg({e} * {e}) AS s FROM p{rounds} JOIN models USING (counter_id, model) WHERE NOT train GROUP BY 1, 2, 3),
scores AS (SELECT counter_id, draw, avg(s) AS score, count(*) AS n_folds FROM folds GROUP BY 1, 2)
SELECT counter_id, CAST(draw AS INT) AS draw, n_folds, {", ".join(
    f"floor(n_estimators / {TREE_SHARE}) AS n_estimators" if p[0] == "n_estimators" else f"round({p[0]}, 6) AS {p[0]}" for p in SE.SEARCH_SPACE)},
  round(score, 6) AS score, row_number() OVER (PARTITION BY counter_id ORDER BY score DESC, draw) = 1 AS best
FROM scores JOIN d USING (counter_id, draw)"""


@query("boosted_search", _search_sql(), FAM)
def boosted_search(spark, sf_dir):
    """A88 over A87: every seeded draw of the nine ranges boosted on the five
    expanding folds of its counter and scored by negative mean squared error;
    ``best`` marks the counter's best draw (ties to the smaller number)."""
    rows, _ = binned(spark, sf_dir)
    train = rows.filter(~F.col("is_test"))
    n = materialize(sizes(rows))
    draws = SE.draws(n.select(*KEYS), "counter_id", SEARCH_DRAWS).withColumn(
        "n_estimators", F.floor(F.col("n_estimators") / TREE_SHARE).cast("double"))
    models = materialize(B.fold_models(n, draws, KEYS))
    _, predicted = B.fit(train, models, KEYS, len(FEATURES))
    scores = B.fold_scores(predicted, models, KEYS).join(draws, [*KEYS, "draw"])
    best = F.max(F.struct("score", (-F.col("draw")).alias("last"))).over(seq.whole(seq.series_window(order=["draw"])))
    return scores.select(*KEYS, "draw", "n_folds", *[round_scaled(F.col(p[0]), 6).alias(p[0]) for p in SE.SEARCH_SPACE],
                         round_scaled(F.col("score"), 6).alias("score"), (F.col("draw") == -best["last"]).alias("best"))
