"""Exact ridge, sign constraints, additive attributions, text formats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions.columns import draft_capital_weight
from fieldcast.operators import explain as E
from fieldcast.operators import training as T


def _data(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.3]
    y = 2.0 * x[:, 0] - 0.5 * x[:, 1] + 0.1 * x[:, 2] + rng.normal(scale=0.5, size=n) + 7
    rows = [(i, float(a), float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double")


def test_ridge_matches_closed_form(spark):
    df = _data(spark)
    m = T.fit_linear(df, ["a", "b", "c"], "y", alpha=1.0)
    pdf = np.array([[r["a"], r["b"], r["c"], r["y"]] for r in df.collect()])
    x, y = pdf[:, :3], pdf[:, 3]
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    bz = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.coef, bz / sd, atol=1e-9)


def test_ridge_matches_mllib_normal_solver(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = _data(spark)
    m = T.fit_linear(df, ["a", "b", "c"], "y", alpha=1.0)
    n = df.count()
    sy = df.agg(F.stddev_pop("y")).first()[0]
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    # MLlib scales the penalty by 1/n and by the label's std: alpha / n * std_pop(y).
    fit = LinearRegression(featuresCol="f", labelCol="y", regParam=1.0 / n * sy, elasticNetParam=0.0,
                           standardization=True, solver="normal").fit(vec)
    assert np.allclose(fit.coefficients.toArray(), m.coef, atol=1e-5)


def test_sign_constraints_hold(spark):
    df = _data(spark)
    m = T.fit_linear(df, ["a", "b", "c"], "y", directions={"a": -1, "b": 1})
    assert m.coef[0] <= 0 and m.coef[1] >= 0


def test_monotone_audit_has_no_violations(spark):
    df = _data(spark)
    m = T.fit_linear(df, ["a", "b", "c"], "y", directions={"b": 1})
    out = T.monotone_audit(df.select("id", "a", "b", "c"), ["id"], "b", -10, 10, 11,
                           lambda d: d.withColumn("prediction", m.predict()), direction=1)
    assert out.agg(F.sum("violations")).first()[0] == 0


def test_attribution_is_additive_and_ordered(spark):
    df = _data(spark)
    m = T.fit_linear(df, ["a", "b", "c"], "y")
    long = E.attribution(df, m, ["id"])
    chk = long.groupBy("id").agg((F.first("baseline") + F.sum("contribution") - F.first("projection")).alias("d"))
    assert chk.agg(F.max(F.abs("d"))).first()[0] < 1e-9
    top = E.top_drivers(long, ["id"], 2).where("id = 0").orderBy("rank").collect()
    assert len(top) == 2 and abs(top[0]["contribution"]) >= abs(top[1]["contribution"])
    with pytest.raises(ValueError):
        E.top_drivers(long, ["id"], 21)


def test_heuristic_models_refuse_attribution(spark):
    class Heur:
        framework, version = "heuristic", "preseason_heuristic_v0"
    with pytest.raises(E.ExplainUnsupported):
        E.attribution(_data(spark), Heur(), ["id"])


def test_driver_formats(spark):
    df = spark.createDataFrame([("prior_target_share", 0.705, 1.25), ("is_rookie", 1.0, -0.5),
                                ("prior_games", 16.0, 0.3), ("career_weighted_ppg", 17.84, 2.0)],
                               "feature string, value double, contribution double")
    out = {r["feature"]: r for r in E.driver_text(df).collect()}
    assert out["prior_target_share"]["formatted"] == "70%"
    assert out["is_rookie"]["formatted"] == "yes"
    assert out["prior_games"]["formatted"] == "16"
    assert out["career_weighted_ppg"]["text"] == "career scoring rate (17.8) raises the projection by 2.0"
    h = E.headline(df.withColumn("k", F.lit(1)), ["k"]).first()["headline"]
    assert h == "career scoring rate 17.8; held back by rookie yes"


def test_draft_decay_weights(spark):
    r = spark.range(1).select(draft_capital_weight(F.lit(0.0)).alias("a"), draft_capital_weight(F.lit(16.0)).alias("b"),
                              draft_capital_weight(F.lit(44.0)).alias("c"),
                              draft_capital_weight(F.lit(None).cast("double")).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (1.0, 0.5, 0.0, 1.0)


def test_metrics_and_bake_off(spark):
    df = spark.createDataFrame([(1.0, 1.5, 1.0), (2.0, 2.5, 3.0), (3.0, 2.0, 3.0)], "y double, p double, q double")
    m = T.regression_metrics(df, "y", "p").first()
    assert m["n_valid"] == 3 and m["rmse"] == round(float(np.sqrt((0.25 + 0.25 + 1) / 3)), 4)
    res = spark.createDataFrame([("pre", "naive", "none", 4.0, 3.0, True), ("pre", "m1", "x", 3.0, 2.0, False),
                                 ("pre", "m2", "x", 2.8, 2.1, False)],
                                "kind string, model string, framework string, rmse double, mae double, "
                                "is_baseline boolean")
    out = {r["model"]: r for r in T.bake_off(res).collect()}
    assert out["m2"]["winner"] and not out["naive"]["winner"] and out["m2"]["lift_pct"] == 30.0


def test_training_gate(spark):
    assert not T.training_source_gate(spark.range(499))
    assert T.training_source_gate(spark.range(800))


def test_gram_is_centred_at_large_means(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 2)) + [1e6, -3e6]
    y = 3.0 * (x[:, 0] - 1e6) - 2.0 * (x[:, 1] + 3e6) + 1e5 + rng.normal(scale=0.1, size=5000)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double").repartition(9)
    g = T.gram(df, ["a", "b"], "y", collected=2)
    centred = x - x.mean(0)
    assert g["n"] == 5000 and np.allclose(g["mean"], x.mean(0), rtol=1e-14)
    assert np.allclose(g["scatter"], centred.T @ centred, rtol=1e-9, atol=1e-5)   # of about 5000 on the diagonal
    assert np.allclose(g["cross"], centred.T @ (y - y.mean()), rtol=1e-9, atol=1e-4)
    m = T.fit_linear(df, ["a", "b"], "y", alpha=1e-9)
    assert np.allclose(m.coef, [3.0, -2.0], atol=1e-2)


def test_gram_of_nulls_empty_and_merged_parts(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, 3.0), (4.0, None)], "a double, y double")
    g = T.gram(df, ["a"], "y")
    assert (g["n"], g["mean"].tolist(), g["label_mean"]) == (2.0, [1.0], 2.0)
    assert g["scatter"].tolist() == [[2.0]] and g["cross"].tolist() == [2.0]
    assert T.gram(df.limit(0), ["a"], "y")["n"] == 0
    with pytest.raises(ValueError):
        T.fit_linear(df.limit(0), ["a"], "y")


def test_constrained_fit_says_when_it_has_not_converged():
    a = np.array([[1.0, 0.9999], [0.9999, 1.0]])
    with pytest.raises(RuntimeError):
        T._constrained_solve(a, np.array([1.0, -1.0]), np.zeros(2), iters=3)


def test_audits_of_every_feature_find_a_reversal(spark):
    df = _data(spark).select("id", "a", "b", "c")
    m = T.fit_linear(_data(spark), ["a", "b", "c"], "y")          # free: b falls
    got = {r["feature"]: r for r in T.monotone_audits(df, ["id"], {"a": 1, "b": 1, "c": 1}, 5, m.score).collect()}
    assert set(got) == {"a", "b", "c"} and {r["rows"] for r in got.values()} == {400}
    assert got["a"]["violations"] == 0 and got["b"]["violations"] == 4 * 400 and got["b"]["largest"] > 0
    held = T.fit_linear(_data(spark), ["a", "b", "c"], "y", directions={"a": 1, "b": 1, "c": 1})
    assert T.monotone_audits(df, ["id"], {"a": 1, "b": 1, "c": 1}, 5, held.score).agg(F.sum("violations")).first()[0] == 0


def test_model_store(spark):
    import tempfile

    from fieldcast.operators import models as store
    from fieldcast.operators import scoring as M

    root = tempfile.mkdtemp(prefix="fc-models-")
    df = _data(spark).withColumn("is_valid", F.col("id") % 4 == 0)
    names, told = ["a", "b", "c"], {"residual_std": 0.5, "rmse": 0.6, "mae": 0.4, "r2": 0.9, "n_valid": 100}
    ridge = T.fit_linear(df, names, "y", version="ridge_x")
    trees = store.TreeModel(names, T.train_gbt(df, names, "y", max_iter=3), "gbt_x")
    for model in (ridge, trees, ridge):                           # saved again: replaced
        store.save_model(spark, root, model, "preseason", told)
    found = {r["version"]: r for r in store.registry(spark, root).collect()}
    assert set(found) == {"ridge_x", "gbt_x"} and found["gbt_x"]["framework"] == "gbt" and found["ridge_x"]["feature_order"] == "a,b,c"
    for model in (ridge, trees):
        again = store.load_model(spark, root, model.version, names)
        one = model.score(df).select("id", "prediction").collect()
        two = again.score(df).select("id", "prediction").collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    stored = M.scored_as_stored(store.load_model(spark, root, "ridge_x"), df)
    assert stored.columns == [*df.columns, "prediction", "model_version"] and stored.first()["model_version"] == "ridge_x"
    with pytest.raises(KeyError):
        store.load_model(spark, root, "ridge_y")
    with pytest.raises(ValueError):
        store.load_model(spark, root, "ridge_x", ["c", "b", "a"])
