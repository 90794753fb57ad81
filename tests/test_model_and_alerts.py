"""Iterative operators against brute force on small fixtures: the recursive
forecast fold, the ridge fit, alert throttling and the bucketed helpers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourcast.catalog.alerting import alert_events, REPEAT_SECONDS
from hourcast.catalog.models import EXOG, NB_AR, ROLL, ridge_forecast_df
from hourcast.operators import alerts as A
from hourcast.operators import model as MD
from hourcast.operators.asof import asof_join
from hourcast.operators.bucketed import bucketed_lag, running_sum
from tests.conftest import MEDIUM, SMALL


def test_fold_equals_python_loop(spark):
    buf = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    exog = [[0.1, 0.2], [0.3, -0.4], [0.0, 1.0], [2.0, 0.5]]
    ar, mm, ex, b0 = [0.5, -0.2], [0.3], [1.5, -2.0], 0.7
    df = spark.createDataFrame([(buf, exog)], "buf array<double>, exog array<array<double>>")
    fold = MD.recursive_fold(F.col("buf"), F.lit(4), F.lit(b0), F.array(*map(F.lit, ar)), 2,
                             F.array(*map(F.lit, mm)), 1, 3, exog=F.col("exog"),
                             exog_coef=F.array(*map(F.lit, ex)))
    got = df.select(fold.alias("p")).collect()[0].p
    hist, exp = list(buf), []
    for step in range(4):
        p = b0 + ar[0] * hist[-1] + ar[1] * hist[-2] + mm[0] * np.mean(hist[-3:]) + np.dot(exog[step], ex)
        exp.append(p)
        hist.append(p)
    assert np.allclose(got, exp, rtol=1e-12)


def test_fit_ridge_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = 2.0 + x @ np.array([1.0, -3.0, 0.5]) + rng.normal(scale=0.1, size=200)
    pdf = pd.DataFrame({"k": "a", "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": y})
    m = MD.fit_ridge(spark.createDataFrame(pdf), ["k"], ["x0", "x1", "x2"], "y", lam=0.0).collect()[0]
    beta, *_ = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)
    assert abs(m.intercept - beta[0]) < 1e-8
    assert np.allclose(m.coef, beta[1:], atol=1e-8)


def test_ridge_forecast_recursion_matches_loop(spark):
    out = ridge_forecast_df(spark, SMALL).toPandas()
    assert out["y_pred"].notna().all()
    # rebuild one counter with numpy from the same coefficients and buffer
    from hourcast.functions.calendar import add_calendar
    from hourcast.operators import sequence as seq
    from hourcast.sources.tables import counts
    c = add_calendar(counts(spark, SMALL), "ts_utc", prefix="ts")
    s = seq.time_split(c, 0.25).toPandas().sort_values(["counter_id", "rn"])
    cid = sorted(out.counter_id.unique())[0]
    g = s[s.counter_id == cid]
    tr, te = g[~g.is_test], g[g.is_test]
    y = tr.hourly_count.astype(float).to_numpy()
    feats = pd.DataFrame({f"target_ar_{k}": pd.Series(y).shift(k) for k in range(1, NB_AR + 1)})
    feats[f"target_mm_{ROLL}_1"] = pd.Series(y).shift(1).rolling(ROLL).mean()
    for e in EXOG:
        feats[e] = tr[e].to_numpy()
    ok = feats.notna().all(axis=1).to_numpy()
    X, Y = feats[ok].to_numpy(), y[ok]
    mu, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1
    Z = (X - mu) / sd
    n = len(Y)
    corr = np.cov(Z.T, bias=True)
    b_std = np.linalg.solve(corr + 1.0 / n * np.eye(X.shape[1]), ((Z - Z.mean(0)) * (Y - Y.mean())[:, None]).mean(0))
    beta = b_std / sd
    a = Y.mean() - beta @ mu
    hist, preds = list(y), []
    for _, row in te.iterrows():
        x = [hist[-k] for k in range(1, NB_AR + 1)] + [np.mean(hist[-ROLL:])] + [row[e] for e in EXOG]
        p = a + float(np.dot(beta, x))
        preds.append(p)
        hist.append(p)
    got = out[out.counter_id == cid].sort_values("ts_utc").y_pred.to_numpy()
    assert np.allclose(got, preds, rtol=1e-6, atol=1e-6)


def _throttle_brute(ts_ids, repeat_us):
    out, nxt = [], None
    for t, i in sorted(ts_ids):
        if nxt is None or t >= nxt:
            out.append(i)
            nxt = t + repeat_us
    return out


def test_throttle_matches_sequential_fold(spark):
    ev = alert_events(spark, SMALL)
    pdf = ev.toPandas()
    for sev, sec in REPEAT_SECONDS.items():
        part = pdf[pdf.severity.isna()] if sev is None else pdf[pdf.severity == sev]
        sdf = ev.filter(F.col("severity").isNull() if sev is None else F.col("severity") == sev)
        got = A.throttle(spark, sdf, ["alertname"], "ts", "alert_id", F.lit(sec * 1_000_000))
        got_ids = set(r.eid for r in got.collect())
        exp = set()
        for _, g in part.groupby("alertname"):
            us = g.ts.astype("datetime64[us]").astype("int64")
            exp |= set(_throttle_brute(list(zip(us, g.alert_id)), sec * 1_000_000))
        assert got_ids == exp


def test_bucketed_helpers_match_plain_windows(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 400), "t": rng.permutation(400), "v": rng.integers(0, 10, 400)})
    pdf["b"] = pdf.t // 37
    df = spark.createDataFrame(pdf)
    lag = bucketed_lag(df, ["k"], ["t"], "b", "v", "p").toPandas().sort_values(["k", "t"])
    lead = bucketed_lag(df, ["k"], ["t"], "b", "v", "n", reverse=True).toPandas().sort_values(["k", "t"])
    rs = running_sum(df, ["k"], ["t"], "b", "v", "s").toPandas().sort_values(["k", "t"])
    rm = running_sum(df, ["k"], ["t"], "b", "v", "m", agg="max", exclusive=True).toPandas().sort_values(["k", "t"])
    ref = pdf.sort_values(["k", "t"])
    g = ref.groupby("k").v
    assert lag.p.fillna(-1).tolist() == g.shift(1).fillna(-1).astype(int).tolist()
    assert lead.n.fillna(-1).tolist() == g.shift(-1).fillna(-1).astype(int).tolist()
    assert rs.s.tolist() == g.cumsum().tolist()
    assert rm.m.fillna(-1).tolist() == g.transform(lambda s: s.shift(1).cummax()).fillna(-1).astype(int).tolist()


def test_asof_join_matches_merge_asof(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.integers(0, 2, 300),
                         "t_left": pd.to_datetime(rng.integers(0, 10_000, 300) * 1_000_000, unit="us")})
    right = pd.DataFrame({"k": rng.integers(0, 2, 80),
                          "t_right": pd.to_datetime(rng.choice(10_000, 80, replace=False) * 1_000_000, unit="us"),
                          "val": rng.normal(size=80)})
    l_df = spark.createDataFrame(left).withColumn("t_left", F.col("t_left").cast("timestamp_ntz"))
    r_df = spark.createDataFrame(right).withColumn("t_right", F.col("t_right").cast("timestamp_ntz"))
    got = asof_join(l_df, r_df, ["k"], "t_left", "t_right", ["val"], bucket_us=500 * 1_000_000).toPandas()
    exp = pd.merge_asof(left.sort_values("t_left"), right.sort_values("t_right"),
                        left_on="t_left", right_on="t_right", by="k", direction="backward")
    a = sorted(zip(got.k, got.t_left, got.val.fillna(99).round(9)))
    b = sorted(zip(exp.k, exp.t_left, exp.val.fillna(99).round(9)))
    assert a == b


def test_tree_ensemble_in_sql_matches_mllib_and_recursion_runs(spark):
    from pyspark.ml.functions import vector_to_array

    from hourcast.catalog import models as CM
    from hourcast.operators import sequence as seq
    model, data, feats = CM._gbt_fit(spark, SMALL)
    gbt = model.stages[-1]
    trees = [MD.tree_arrays(t) for t in gbt.trees]
    test = seq.complete_case(data.filter(F.col("is_test")), feats)
    sc = model.transform(test).select("prediction", vector_to_array("features").alias("x"))
    mine = MD.ensemble_predict(F.col("x"), trees, list(gbt.treeWeights), gbt.getMaxDepth())
    diff = sc.select(F.max(F.abs(F.col("prediction") - mine))).first()[0]
    assert diff < 1e-9
    out = CM.gbt_forecast_df(spark, SMALL)
    n_test = data.filter(F.col("is_test")).count()
    assert out.count() == n_test
    assert out.filter(F.col("y_pred").isNull()).count() == 0


def test_scenario_forecast_matches_loop_for_one_pair(spark):
    """The (scenario, counter)-keyed plan equals a numpy re-run of one slice."""
    from hourcast.catalog import models as CM
    from hourcast.functions.calendar import add_calendar
    from hourcast.operators import sequence as seq
    from hourcast.plans.scenarios import scenario_array
    from hourcast.sources.tables import counts
    numbered = seq.number_rows(counts(spark, MEDIUM))  # slices long enough for the history gate
    fanned = numbered.withColumn("sc", F.explode(scenario_array())).select("*", "sc.*")
    keep = seq.percent_slice_filter(F.col("rn"), F.col("n"), F.col("start_pct"), F.col("end_pct"))
    sliced = fanned.filter(keep).select("scenario", "counter_id", "ts_utc", "hourly_count")
    got = CM.ridge_recursive_forecast(sliced, ["scenario", "counter_id"]).toPandas()
    pair = got[["scenario", "counter_id"]].drop_duplicates().sort_values(["scenario", "counter_id"]).iloc[0]
    one = sliced.filter((F.col("scenario") == pair.scenario) & (F.col("counter_id") == pair.counter_id))
    expect = CM.ridge_recursive_forecast(one.drop("scenario"), ["counter_id"]).toPandas().sort_values("ts_utc")
    mine = got[(got.scenario == pair.scenario) & (got.counter_id == pair.counter_id)].sort_values("ts_utc")
    assert len(mine) == len(expect) > 0
    assert mine.y_pred.notna().all()
    assert np.allclose(mine.y_pred.to_numpy(), expect.y_pred.to_numpy(), rtol=1e-9, atol=1e-9)
    # and the single-key path is the numpy-checked one (test_ridge_forecast_recursion_matches_loop)
    c = add_calendar(one.drop("scenario"), "ts_utc", prefix="ts")
    assert c.count() == one.count()
