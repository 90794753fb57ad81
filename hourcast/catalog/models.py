"""Model queries: statistics, search, linear fits and recursive forecasts
(A83–A91, A31–A33, A61–A63, A94)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.catalog.registry import query
from hourcast.functions.numeric import round_scaled
from hourcast.functions.calendar import add_calendar, to_local
from hourcast.operators import model as MD
from hourcast.operators import search as SE
from hourcast.operators import sequence as seq
from hourcast.operators.evaluate import metric_aggs, round_doubles
from hourcast.sources.tables import counts, materialize, with_views

FAM = "model"
RIDGE_LAMBDA = 1.0
TEST_RATIO = 0.25


def _split(spark, sf_dir):
    c = counts(spark, sf_dir)
    w = seq.series_window()
    s = c.withColumns({"rn": F.row_number().over(w).cast("bigint"),
                       "n": F.count(F.lit(1)).over(seq.whole(w)),
                       "x": F.lag(F.col("hourly_count").cast("double"), 1).over(w)})
    return s.withColumn("n_train", F.col("n") - seq.n_test(F.col("n"), TEST_RATIO))


def y_full_linear_df(spark, sf_dir):
    s = materialize(_split(spark, sf_dir))  # read by fit, buffer, test and fitted branches
    train = s.filter((F.col("rn") <= F.col("n_train")) & F.col("x").isNotNull())  # A20 complete case
    coef = MD.ols_ar1(train.withColumn("y", F.col("hourly_count").cast("double")),
                      ["counter_id"], "x", "y", lam=RIDGE_LAMBDA)
    # buffer = last training value; horizon = test length (A33: need >= 1 value)
    last = (s.filter(F.col("rn") == F.col("n_train"))
            .select("counter_id", F.array(F.col("hourly_count").cast("double")).alias("buffer"),
                    (F.col("n") - F.col("n_train")).alias("horizon")))
    plan = last.join(coef, "counter_id")
    preds = plan.select("counter_id", MD.recursive_fold(F.col("buffer"), F.col("horizon"), F.col("a"),
                                                        F.array(F.col("b")), nb_ar=1).alias("preds"))
    steps = preds.select("counter_id", F.posexplode("preds").alias("step0", "y_pred"))
    test = (s.filter(F.col("rn") > F.col("n_train"))
            .withColumn("step0", F.col("rn") - F.col("n_train") - 1)
            .join(steps, ["counter_id", "step0"], "left")
            .select("counter_id", "ts_utc", "hourly_count", "y_pred", F.lit(True).alias("forecast_mode")))
    fitted = (train.join(coef, "counter_id")
              .select("counter_id", "ts_utc", "hourly_count", (F.col("a") + F.col("b") * F.col("x")).alias("y_pred"),
                      F.lit(False).alias("forecast_mode")))
    full = seq.union_missing(fitted, test)  # A63: train and test rows tagged by mode
    return full.select("counter_id", to_local("ts_utc").alias("ts_local"), "ts_utc",
                       F.col("hourly_count").alias("y_true"), "y_pred", "forecast_mode")


Y_FULL_SQL = "WITH RECURSIVE " + with_views("counts")[len("WITH "):] + f""",
r AS (SELECT counter_id, ts_utc, hourly_count AS y,
        row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n,
        CAST(lag(hourly_count) OVER (PARTITION BY counter_id ORDER BY ts_utc) AS DOUBLE) AS x FROM counts),
s AS (SELECT *, n - CAST(floor(CAST(n AS DOUBLE) * {TEST_RATIO}) AS BIGINT) AS n_train FROM r),
tr AS (SELECT * FROM s WHERE rn <= n_train AND x IS NOT NULL),
g AS (SELECT counter_id, count(x) AS n_fit, sum(x) AS sx, sum(y) AS sy,
        (sum(x * y) - sum(x) * sum(y) / count(x)) / (sum(x * x) - sum(x) * sum(x) / count(x) + {RIDGE_LAMBDA}) AS b
      FROM tr GROUP BY 1),
c AS (SELECT counter_id, b, (sy - b * sx) / n_fit AS a FROM g),
l AS (SELECT counter_id, CAST(y AS DOUBLE) AS y0, n - n_train AS horizon FROM s WHERE rn = n_train),
rec(counter_id, step, pred) AS (
  SELECT c.counter_id, 1, c.a + c.b * l.y0 FROM c JOIN l ON c.counter_id = l.counter_id WHERE l.horizon >= 1
  UNION ALL
  SELECT rec.counter_id, rec.step + 1, c.a + c.b * rec.pred
  FROM rec JOIN c ON rec.counter_id = c.counter_id JOIN l ON rec.counter_id = l.counter_id
  WHERE rec.step < l.horizon),
yf AS (
  SELECT tr.counter_id, tr.ts_utc, tr.y AS y_true, c.a + c.b * tr.x AS y_pred, false AS forecast_mode
  FROM tr JOIN c ON tr.counter_id = c.counter_id
  UNION ALL
  SELECT s.counter_id, s.ts_utc, s.y, rec.pred, true FROM s
  LEFT JOIN rec ON s.counter_id = rec.counter_id AND rec.step = s.rn - s.n_train
  WHERE s.rn > s.n_train)
"""


@query("y_full_linear", Y_FULL_SQL + """
SELECT counter_id, timezone('Europe/Paris', timezone('UTC', ts_utc)) AS ts_local, ts_utc, y_true,
       round(y_pred, 6) AS y_pred, forecast_mode FROM yf""", FAM)
def y_full_linear(spark, sf_dir):
    """A91 (linear variant) for all counters in one plan: time split, lag,
    complete case, ridge AR(1) from SQL sums, in-sample fit on train rows and
    the recursive forecast over the whole test horizon, assembled as y_full."""
    return round_doubles(y_full_linear_df(spark, sf_dir))


_OUT_SQL = "SELECT '{name}' AS output, counter_id, count(*) AS n_rows, round(sum({value}), 4) AS total FROM e {where} GROUP BY counter_id"


@query("evaluation_outputs", Y_FULL_SQL + """,
e AS (SELECT yf.counter_id, y_true, y_pred, forecast_mode, hour(timezone('Europe/Paris', timezone('UTC', ts_utc))) AS hour_local, x AS lag_1
      FROM yf JOIN (SELECT counter_id, ts_utc, x FROM s) USING (counter_id, ts_utc))
""" + "\nUNION ALL ".join(_OUT_SQL.format(name=name, where="" if split is None else f"WHERE {'NOT ' if split == 'train' else ''}forecast_mode", value={
    "features": "hour_local + lag_1" if split == "train" else "hour_local", "dates": "hour_local", "truth": "CAST(y_true AS DOUBLE)",
    "prediction": "y_pred", "full": "CAST(y_true AS DOUBLE) + y_pred"}[kind]) for name, split, kind in (
        ("X_train", "train", "features"), ("X_test", "test", "features"), ("X_train_dates", "train", "dates"), ("X_test_dates", "test", "dates"),
        ("y_train", "train", "truth"), ("y_test", "test", "truth"), ("y_train_pred", "train", "prediction"),
        ("y_test_pred", "test", "prediction"), ("y_full", None, "full"))), FAM)
def evaluation_outputs(spark, sf_dir):
    """The nine evaluation outputs written as CSV by counter and read back: rows and sums of each."""
    import os
    import uuid

    from hourcast.session import ensure_checkpoint_dir
    from hourcast.sources import sinks as SK
    lagged = _split(spark, sf_dir).select("counter_id", "ts_utc", F.col("x").alias("lag_1"))
    full = materialize(y_full_linear_df(spark, sf_dir).join(lagged, ["counter_id", "ts_utc"])
                       .withColumn("hour_local", F.hour("ts_local")))
    path = os.path.join(ensure_checkpoint_dir(spark), f"outputs-{uuid.uuid4().hex}")
    SK.write_outputs(full, path, ["hour_local", "lag_1"], ["hour_local"])
    values = {"features": ("hour_local double, lag_1 double", F.col("hour_local") + F.col("lag_1")), "dates": ("ts_local timestamp_ntz", F.hour("ts_local")),
              "truth": ("y_true double", F.col("y_true")), "prediction": ("comptage_horaire_predit double", F.col("comptage_horaire_predit")),
              "full": ("ts_local timestamp_ntz, y_true double, y_pred double, forecast_mode boolean", F.col("y_true") + F.col("y_pred"))}
    out = None
    for name, split, kind in SK.OUTPUTS:
        schema, value = ("hour_local double", F.col("hour_local")) if name == "X_test" else values[kind]
        got = spark.read.option("header", True).schema(f"row long, {schema}, counter_id string").csv(f"{path}/{name}").groupBy("counter_id").agg(
            F.count(F.lit(1)).alias("n_rows"), round_scaled(F.sum(value.cast("double")), 4).alias("total"))
        got = got.select(F.lit(name).alias("output"), "*")
        out = got if out is None else out.unionByName(got)
    return out


# Coefficients of a given model: seven lags, a 24-row trailing mean, two calendar inputs.
AR7 = [0.12, 0.09, 0.07, 0.05, 0.04, 0.03, 0.02]
MEAN24, WEEKEND, HOUR, INTERCEPT = 0.45, -0.6, 0.3, 0.25


@query("forecast_ar7", "WITH RECURSIVE " + with_views("counts")[len("WITH "):] + f""",
r AS (SELECT counter_id, ts_utc, CAST(hourly_count AS DOUBLE) AS y, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts),
s AS (SELECT *, n - CAST(floor(CAST(n AS DOUBLE) * {TEST_RATIO}) AS BIGINT) AS n_train FROM r),
t AS (SELECT counter_id, ts_utc, y, rn - n_train AS step,
        {WEEKEND} * CASE WHEN isodow(ts_utc) >= 6 THEN 1.0 ELSE 0.0 END + {HOUR} * hour(ts_utc) / 24.0 AS calendar FROM s WHERE rn > n_train),
b AS (SELECT counter_id, list(y ORDER BY rn) AS buf FROM s WHERE rn <= n_train AND rn > n_train - 24 GROUP BY 1 HAVING count(*) = 24),
rec(counter_id, step, buf) AS (
  SELECT counter_id, CAST(0 AS BIGINT), buf FROM b
  UNION ALL
  SELECT rec.counter_id, rec.step + 1, list_append(rec.buf[2:24], {INTERCEPT} + {" + ".join(f"{c} * rec.buf[{24 - k}]" for k, c in enumerate(AR7))}
    + {MEAN24} * list_sum(rec.buf) / 24 + t.calendar)
  FROM rec JOIN t ON t.counter_id = rec.counter_id AND t.step = rec.step + 1)
SELECT t.counter_id, t.ts_utc, t.y AS y_true, round(rec.buf[24], 6) AS y_pred
FROM t LEFT JOIN rec ON rec.counter_id = t.counter_id AND rec.step = t.step""", FAM)
def forecast_ar7(spark, sf_dir):
    """A31 + A32 with exogenous inputs: a given linear model of 7 lags, a 24-row
    mean and calendar terms, forecast recursively over every counter's whole
    test horizon in one plan; a counter with under 24 train rows has none (A33)."""
    s = materialize(_split(spark, sf_dir))
    train = s.filter(F.col("rn") <= F.col("n_train"))
    buffers = MD.tail_values(train, ["counter_id"], "rn", "hourly_count", 24).filter(F.size("buffer") == 24)
    test = s.filter(F.col("rn") > F.col("n_train")).withColumn("step0", F.col("rn") - F.col("n_train") - 1)
    exog = F.array(F.when(F.weekday("ts_utc") >= 5, 1.0).otherwise(0.0), F.hour("ts_utc") / 24.0)
    # one row per counter and test hour: bounded by the calendar
    steps = test.groupBy("counter_id").agg(F.count(F.lit(1)).alias("horizon"), F.transform(
        F.array_sort(F.collect_list(F.struct("step0", exog.alias("x")))), lambda z: z["x"]).alias("exog"))
    as_array = lambda values: F.array(*[F.lit(v) for v in values])
    preds = buffers.join(steps, "counter_id").select("counter_id", F.posexplode(MD.recursive_fold(
        F.col("buffer"), F.col("horizon"), F.lit(INTERCEPT), as_array(AR7), 7, as_array([MEAN24]), 1, 24,
        F.col("exog"), as_array([WEEKEND, HOUR]))).alias("step0", "y_pred"))
    return round_doubles(test.join(preds, ["counter_id", "step0"], "left").select(
        "counter_id", "ts_utc", F.col("hourly_count").cast("double").alias("y_true"), "y_pred"))


@query("eval_linear", Y_FULL_SQL + """
SELECT counter_id, forecast_mode, count(y_true - y_pred) AS n_obs,
  round(sqrt(sum((y_true - y_pred) * (y_true - y_pred)) / count(y_true - y_pred)), 6) AS rmse,
  round(avg(abs(y_true - y_pred)), 6) AS mae,
  round(avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-6)) * 100, 6) AS mape,
  round(1.0 - sum((y_true - y_pred) * (y_true - y_pred))
    / nullif(var_pop(CASE WHEN y_pred IS NOT NULL THEN y_true END) * count(y_true - y_pred), 0.0), 6) AS r2,
  round(1.0 - sum((y_true - y_pred) * (y_true - y_pred))
    / nullif(var_pop(CASE WHEN y_true IS NOT NULL THEN y_pred END) * count(y_true - y_pred), 0.0), 3) AS r2_ref
FROM yf GROUP BY 1, 2""", FAM)
def eval_linear(spark, sf_dir):
    """A77 + A78 on the linear y_full: train (fitted) and test (recursive)."""
    yf = y_full_linear_df(spark, sf_dir)
    out = yf.groupBy("counter_id", "forecast_mode").agg(*metric_aggs("y_true", "y_pred"))
    # relative to the predictions' variance, which is close to zero late in a recursion: three digits are stable
    return round_doubles(out.withColumn("r2_ref", round_scaled(F.col("r2_ref"), 3)))


@query("feature_stats", with_views("counts") + """,
f AS (SELECT site, orientation, hourly_count, hour(ts_utc) AS hour_utc,
        row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts)
SELECT site, round(avg(hourly_count), 6) AS hourly_count__mean, round(stddev_pop(hourly_count), 6) AS hourly_count__std,
  round(avg(hour_utc), 6) AS hour_utc__mean, round(stddev_pop(hour_utc), 6) AS hour_utc__std,
  string_agg(DISTINCT orientation, ',' ORDER BY orientation) AS orientation__levels
FROM f WHERE rn <= n - CAST(floor(CAST(n AS DOUBLE) * 0.25) AS BIGINT) GROUP BY site""", FAM)
def feature_stats(spark, sf_dir):
    """Per-site scaling statistics (population std) and category levels
    over the training split."""
    s = seq.time_split(counts(spark, sf_dir), TEST_RATIO).filter(~F.col("is_test"))
    s = s.withColumn("hour_utc", F.hour("ts_utc"))
    st = MD.feature_stats(s, ["site"], ["hourly_count", "hour_utc"], ["orientation"])
    return round_doubles(st.withColumn("orientation__levels", F.array_join("orientation__levels", ",")))


def _draw_sql(name, kind, low, high):
    u = f"CAST(('0x' || substr(md5(concat_ws('|', '0', counter_id, CAST(draw AS VARCHAR), '{name}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
    if kind == "integer":
        return f"CAST(floor(({u}) * {high - low + 1}) + {low} AS DOUBLE) AS {name}"
    if kind == "uniform":
        return f"{float(low)} + ({u}) * ({float(high)} - {float(low)}) AS {name}"
    return f"{float(low)} * pow({float(high)}::DOUBLE / {float(low)}::DOUBLE, {u}) AS {name}"


DRAWS = 20
DRAWS_SQL = with_views("counts") + f""",
c AS (SELECT counter_id, unnest(range(0, {DRAWS})) AS draw FROM (SELECT DISTINCT counter_id FROM counts)),
d AS (SELECT counter_id, draw, {", ".join(_draw_sql(*p) for p in SE.SEARCH_SPACE)} FROM c)
"""


@query("search_draws", DRAWS_SQL + f"""
SELECT counter_id, CAST(draw AS INTEGER) AS draw, {", ".join(f"round({p[0]}, 6) AS {p[0]}" for p in SE.SEARCH_SPACE)} FROM d""", FAM)
def search_draws(spark, sf_dir):
    """Seeded candidates of every counter over the nine parameter ranges."""
    keys = counts(spark, sf_dir).select("counter_id").distinct()
    return round_doubles(SE.draws(keys, "counter_id", DRAWS))


@query("search_ranges", DRAWS_SQL + f""",
l AS (UNPIVOT d ON {", ".join(p[0] for p in SE.SEARCH_SPACE)} INTO NAME parameter VALUE value),
space(parameter, low, high) AS (VALUES {", ".join(f"('{n}', {float(lo)}::DOUBLE, {float(hi)}::DOUBLE)" for n, _, lo, hi in SE.SEARCH_SPACE)})
SELECT counter_id, parameter, low, high, round(min(value), 6) AS drawn_low, round(max(value), 6) AS drawn_high
FROM l JOIN space USING (parameter) GROUP BY 1, 2, 3, 4""", FAM)
def search_ranges(spark, sf_dir):
    """Each parameter's bounds in the search space, and the range of a
    counter's candidates inside them."""
    keys = counts(spark, sf_dir).select("counter_id").distinct()
    return round_doubles(SE.range_summary(SE.draws(keys, "counter_id", DRAWS), ["counter_id"]))


CANDIDATES = [1, 2, 3, 6, 12, 24, 48]


def _cand_sql(w):
    frame = f"OVER (PARTITION BY counter_id ORDER BY ts_utc ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(*) {frame} = {w} THEN avg(hourly_count) {frame} END AS p{w}"


@query("cv_search", with_views("counts") + f""",
r AS (SELECT counter_id, ts_utc, hourly_count, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n, {", ".join(_cand_sql(w) for w in CANDIDATES)} FROM counts),
u AS (UNPIVOT r ON {", ".join(f"p{w}" for w in CANDIDATES)} INTO NAME cand VALUE pred),
x AS (SELECT u.*, CAST(substr(cand, 2) AS INTEGER) AS window_rows, fold FROM u CROSS JOIN range(0, 5) t(fold)),
t AS (SELECT * FROM x WHERE rn > n - (5 - fold) * (n // 6) AND rn <= n - (4 - fold) * (n // 6)),
m AS (SELECT counter_id, window_rows, fold, avg((hourly_count - pred) * (hourly_count - pred)) AS mse FROM t GROUP BY 1, 2, 3),
sc AS (SELECT counter_id, window_rows, -avg(mse) AS score, count(*) AS n_folds FROM m GROUP BY 1, 2)
SELECT counter_id, arg_max(window_rows, (score, -window_rows)) AS best_window, round(max(score), 6) AS best_score,
  count(*) AS n_candidates, min(window_rows) AS min_window, max(window_rows) AS max_window
FROM sc GROUP BY 1""", FAM)
def cv_search(spark, sf_dir):
    """A87 + A88 + A89: candidate rolling-mean windows scored by negative MSE
    over 5 expanding folds; best candidate and the searched range."""
    c = counts(spark, sf_dir)
    w = seq.series_window()
    y = F.col("hourly_count").cast("double")
    preds = {}
    for k in CANDIDATES:
        frame = w.rowsBetween(-k, -1)
        preds[f"p{k}"] = F.when(F.count(F.lit(1)).over(frame) == k, F.avg(y).over(frame))
    r = c.withColumns({"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(seq.whole(w)), **preds})
    long = r.unpivot(["counter_id", "hourly_count", "rn", "n"], [f"p{k}" for k in CANDIDATES], "cand", "pred")
    long = long.withColumn("window_rows", F.substring("cand", 2, 10).cast("int"))
    size = F.floor(F.col("n") / 6)  # a row is tested in one fold at most: no copies per fold
    fold = F.floor((F.col("rn") - 1 - (F.col("n") - 5 * size)) / F.nullif(size, F.lit(0)))
    x = long.withColumn("fold", fold).filter("fold >= 0")
    e = F.col("hourly_count") - F.col("pred")
    m = x.groupBy("counter_id", "window_rows", "fold").agg(F.avg(e * e).alias("mse"))
    sc = m.groupBy("counter_id", "window_rows").agg((-F.avg("mse")).alias("score"))
    best = sc.groupBy("counter_id").agg(
        F.max_by("window_rows", F.struct("score", -F.col("window_rows"))).alias("best_window"),
        F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_candidates"),
        F.min("window_rows").alias("min_window"), F.max("window_rows").alias("max_window"))
    return round_doubles(best)


NB_AR, NB_MM, ROLL = 7, 1, 24
EXOG = ["ts_sin_hour", "ts_cos_hour", "ts_sin_day_of_week", "ts_cos_day_of_week"]


@query("history_gate", with_views("counts") + f""",
r AS (SELECT counter_id, hourly_count, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts)
SELECT counter_id, count(hourly_count) AS n_history, CAST({max(NB_AR, NB_MM * ROLL)} AS BIGINT) AS required,
  CASE WHEN count(hourly_count) < {max(NB_AR, NB_MM * ROLL)} THEN 'insufficient_history' END AS reject_reason
FROM r WHERE rn <= n - CAST(floor(CAST(n AS DOUBLE) * {TEST_RATIO}) AS BIGINT) GROUP BY 1""", FAM)
def history_gate(spark, sf_dir):
    """Training history of each counter against ``max(ar, mm·roll)``;
    a counter below it is rejected instead of forecast."""
    s = seq.time_split(counts(spark, sf_dir), TEST_RATIO).filter(~F.col("is_test"))
    return MD.history_gate(s, ["counter_id"], "hourly_count", NB_AR, NB_MM, ROLL)


def _sufficient(spark, sf_dir):
    return history_gate(spark, sf_dir).filter(F.col("reject_reason").isNull()).select("counter_id")


def ridge_forecast_df(spark, sf_dir):
    return ridge_recursive_forecast(counts(spark, sf_dir), ["counter_id"])


@query("ridge_forecast", None, FAM)
def ridge_forecast(spark, sf_dir):
    """A84 + A86 + A32: per-counter ridge on 7 lags, a 24-row mean and
    Paris hour/weekday cycles, fitted from moments; recursive forecast of the
    whole test split by the SQL fold (checked against a numpy loop in tests)."""
    return round_doubles(ridge_forecast_df(spark, sf_dir))


def _gbt_fit(spark, sf_dir):
    """A85 + A86: one global gradient-boosted model (seed 1) over all
    counters' complete-case training rows; counter and orientation are one-hot
    encoded (an unseen level gives all zeros)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    c = add_calendar(counts(spark, sf_dir), "ts_utc", prefix="ts")
    s = seq.add_ar_features(seq.time_split(c, TEST_RATIO), NB_AR, NB_MM, ROLL)
    feats = [f"target_ar_{k}" for k in range(1, NB_AR + 1)] + [f"target_mm_{ROLL}_1"] + EXOG
    idx = StringIndexer(inputCols=["counter_id", "orientation"], outputCols=["_cid", "_ori"],
                        handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=["_cid", "_ori"], outputCols=["_cid_v", "_ori_v"], dropLast=True,
                        handleInvalid="keep")
    vec = VectorAssembler(inputCols=feats + ["_cid_v", "_ori_v"], outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(labelCol="label", featuresCol="features", seed=1, maxIter=20, maxDepth=5)
    data = materialize(s.withColumn("label", F.col("hourly_count").cast("double")))
    train = seq.complete_case(data.filter(~F.col("is_test")), feats)
    model = Pipeline(stages=[idx, ohe, vec, gbt]).fit(train)
    return model, data, feats


@query("gbt_scoring", None, FAM)
def gbt_scoring(spark, sf_dir):
    """A86 + A90: the global GBT model scoring the test rows one step ahead
    (lags from observed values)."""
    model, data, feats = _gbt_fit(spark, sf_dir)
    test = seq.complete_case(data.filter(F.col("is_test")), feats)
    scored = model.transform(test)
    return round_doubles(scored.select("counter_id", "ts_utc", F.col("hourly_count").alias("y_true"),
                                       F.col("prediction").alias("y_pred")))


def gbt_forecast_df(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    model, data, feats = _gbt_fit(spark, sf_dir)
    gbt = model.stages[-1]
    trees = [MD.tree_arrays(t) for t in gbt.trees]          # bounded: maxIter x 2^(depth+1)
    weights = list(gbt.treeWeights)
    n_lag = NB_AR + NB_MM
    test = data.filter(F.col("is_test")).fillna(0.0, subset=feats[:n_lag])
    rows = (model.transform(test).withColumn("_f", vector_to_array("features"))
            .select("counter_id", "rn", "ts_utc", "hourly_count",   # exogenous + one-hot part, whole
                    F.slice("_f", F.lit(n_lag + 1), F.size("_f") - n_lag).alias("tail")))
    plan = rows.groupBy("counter_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "tail"))), lambda z: z["tail"]).alias("exog"),
        F.count(F.lit(1)).alias("horizon"), F.min("rn").alias("first_rn"))
    keep = max(NB_AR, NB_MM * ROLL)
    buf = MD.tail_values(data.filter(~F.col("is_test")), ["counter_id"], "rn", "hourly_count", keep)
    plan = plan.join(buf, "counter_id").join(_sufficient(spark, sf_dir), "counter_id", "left_semi")

    def predict(b, i):
        x = F.concat(F.array(*MD.buffer_features(b, NB_AR, NB_MM, ROLL)), F.element_at(F.col("exog"), i))
        return MD.ensemble_predict(x, trees, weights, gbt.getMaxDepth())

    fold = MD.fold_steps(F.col("buffer"), F.col("horizon"), keep, predict)
    preds = plan.select("counter_id", "first_rn", F.posexplode(fold).alias("step0", "y_pred"))
    preds = preds.withColumn("rn", F.col("first_rn") + F.col("step0")).drop("first_rn", "step0")
    return (rows.join(preds, ["counter_id", "rn"], "left")
            .select("counter_id", "ts_utc", F.col("hourly_count").alias("y_true"), "y_pred"))


@query("gbt_forecast", None, FAM)
def gbt_forecast(spark, sf_dir):
    """A32 + A91 (tree variant): recursive multi-step forecast with the GBT
    model – the fitted trees become bounded node arrays and the ensemble is
    evaluated inside the per-counter SQL fold (no Python per step)."""
    return round_doubles(gbt_forecast_df(spark, sf_dir))


def ridge_recursive_forecast(series, keys: list[str], order: str = "ts_utc", ratio: float = TEST_RATIO,
                             nb_ar: int = NB_AR, nb_mm: int = NB_MM, roll: int = ROLL, lam: float = RIDGE_LAMBDA):
    """A25 + A29 + A30 + A20 + A33 + A84/A86 + A32 for every key at once:
    chronological split, AR features on the training rows, complete case,
    ridge fit from moments, history gate and the recursive test forecast.
    Returns the test rows with ``y_pred`` (keys, order, y_true, y_pred)."""
    w_keys = keys
    c = add_calendar(series, order, prefix="ts")
    s = materialize(seq.time_split(c, ratio, key=w_keys, order=[order]))  # read by five branches
    train = seq.add_ar_features(s.filter(~F.col("is_test")), nb_ar, nb_mm, roll, key=w_keys, order=[order])
    feats = [f"target_ar_{k}" for k in range(1, nb_ar + 1)] + [f"target_mm_{roll}_{k}" for k in range(1, nb_mm + 1)] + EXOG
    train = seq.complete_case(train, feats)
    model = MD.fit_ridge(train, w_keys, feats, "hourly_count", lam=lam)
    keep = max(nb_ar, nb_mm * roll)
    gate = (MD.history_gate(s.filter(~F.col("is_test")), w_keys, "hourly_count", nb_ar, nb_mm, roll)
            .filter(F.col("reject_reason").isNull()).select(*w_keys))
    buf = MD.tail_values(s.filter(~F.col("is_test")), w_keys, "rn", "hourly_count", keep)
    test = s.filter(F.col("is_test"))
    exog = test.groupBy(*w_keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", F.array(*[F.col(e) for e in EXOG]).alias("x")))),
                    lambda z: z["x"]).alias("exog"),
        F.count(F.lit(1)).alias("horizon"), F.min("rn").alias("first_rn"))
    plan = model.join(buf, w_keys).join(exog, w_keys).join(gate, w_keys, "left_semi")
    coef = F.col("coef")
    fold = MD.recursive_fold(F.col("buffer"), F.col("horizon"), F.col("intercept"),
                             F.slice(coef, 1, nb_ar), nb_ar, F.slice(coef, nb_ar + 1, nb_mm), nb_mm, roll,
                             exog=F.col("exog"), exog_coef=F.slice(coef, nb_ar + nb_mm + 1, len(EXOG)))
    preds = plan.select(*w_keys, "first_rn", F.posexplode(fold).alias("step0", "y_pred"))
    preds = preds.withColumn("rn", F.col("first_rn") + F.col("step0")).drop("first_rn", "step0")
    return (test.join(preds, [*w_keys, "rn"], "left")
            .select(*w_keys, order, F.col("hourly_count").alias("y_true"), "y_pred"))


@query("scenario_forecast", None, FAM)
def scenario_forecast(spark, sf_dir):
    """A9 + A24 + A91: the end-to-end scenarios (0–15 %, 0.5–15.5 %, 1–15 %
    slices; ar 7, mm 1, roll 24; test ratio 0.25) for every counter in one
    plan – slice, features, ridge fit, recursive forecast and test metrics
    per (scenario, counter)."""
    from hourcast.plans.scenarios import scenario_array
    numbered = seq.number_rows(counts(spark, sf_dir))
    fanned = numbered.withColumn("sc", F.explode(scenario_array())).select("*", "sc.*")
    keep = seq.percent_slice_filter(F.col("rn"), F.col("n"), F.col("start_pct"), F.col("end_pct"))
    sliced = fanned.filter(keep).select("scenario", "counter_id", "ts_utc", "hourly_count")
    out = ridge_recursive_forecast(sliced, ["scenario", "counter_id"])
    return round_doubles(out.groupBy("scenario", "counter_id").agg(*metric_aggs("y_true", "y_pred")))


@query("standardized_features", with_views("counts") + """,
r AS (SELECT *, hour(ts_utc) AS hour_utc, row_number() OVER (PARTITION BY counter_id ORDER BY ts_utc) AS rn,
        count(*) OVER (PARTITION BY counter_id) AS n FROM counts),
tr AS (SELECT * FROM r WHERE rn <= n - CAST(floor(CAST(n AS DOUBLE) * 0.25) AS BIGINT)),
st AS (SELECT site, avg(hourly_count) AS m1, stddev_pop(hourly_count) AS s1, avg(hour_utc) AS m2, stddev_pop(hour_utc) AS s2
       FROM tr GROUP BY site),
lv AS (SELECT DISTINCT orientation FROM tr)
SELECT r.counter_id, r.ts_utc,
  round((r.hourly_count - st.m1) / coalesce(nullif(st.s1, 0), 1), 6) AS hourly_count,
  round((r.hour_utc - st.m2) / coalesce(nullif(st.s2, 0), 1), 6) AS hour_utc,
  CASE WHEN 'N-S' IN (SELECT orientation FROM lv) AND r.orientation = 'N-S' THEN 1.0 ELSE 0.0 END AS "orientation_N-S",
  CASE WHEN 'S-N' IN (SELECT orientation FROM lv) AND r.orientation = 'S-N' THEN 1.0 ELSE 0.0 END AS "orientation_S-N"
FROM r JOIN st ON r.site = st.site""", FAM)
def standardized_features(spark, sf_dir):
    """A83 + A84 + A85: numeric features scaled with the training split's mean
    and population std (zero std -> 1), orientation one-hot with the levels
    seen in training (an unseen level gives all zeros)."""
    c = counts(spark, sf_dir).withColumn("hour_utc", F.hour("ts_utc"))
    s = materialize(seq.time_split(c, TEST_RATIO))  # read by stats, levels and scaling
    train = s.filter(~F.col("is_test"))
    stats = MD.feature_stats(train, ["site"], ["hourly_count", "hour_utc"], [])
    z = MD.standardize(s.withColumns({"hourly_count": F.col("hourly_count").cast("double"),
                                      "hour_utc": F.col("hour_utc").cast("double")}),
                       stats, ["site"], ["hourly_count", "hour_utc"])
    # fixed category set of the contract; a level absent from training stays all-zero
    seen = train.agg(F.collect_set("orientation").alias("lv"))
    z = z.withColumn("_lv", seen.select("lv").scalar())
    z = MD.one_hot(z, "orientation", ["N-S", "S-N"])
    for lv in ["N-S", "S-N"]:
        z = z.withColumn(f"orientation_{lv}",
                         F.when(F.array_contains("_lv", lv), F.col(f"orientation_{lv}")).otherwise(F.lit(0.0)))
    return round_doubles(z.select("counter_id", "ts_utc", "hourly_count", "hour_utc",
                                  "orientation_N-S", "orientation_S-N"))
