import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wxspark.operators import ensemble as E
from wxspark.operators import features, forest, fuzzy
from wxspark.operators.fuzzy import FuzzyConfig
from wxspark.plans import forecast, pipeline
from wxspark.session import scratch
from wxspark.sources.stores import load_model, save_model

FEATURES = ["humidity", "pressure", "wind_speed", "cloud_cover"]


def test_five_fuzzy_sets(full):
    cfg = FuzzyConfig(sets=5)
    sets = fuzzy.fz_sets(fuzzy.fz_universe(full, cfg), cfg).filter("station = 'a'")
    assert [r["label"] for r in sets.orderBy("set_no").collect()] == fuzzy.TERMS[:5]
    assert FuzzyConfig(sets=9).terms[0] == "A1"


def test_fuzzy_interval_and_multi_step(full):
    rows = fuzzy.fz_interval(full).collect()
    assert len(rows) == 2 and all(r["lower"] <= r["prediction"] <= r["upper"] for r in rows)
    one = {r["station"]: r["prediction"] for r in fuzzy.fz_multi_step(full, 3).filter("step = 1").collect()}
    assert one == pytest.approx({r["station"]: r["prediction"] for r in rows})


def test_second_order_rules(full):
    m = fuzzy.fz_backtest(full, FuzzyConfig(order=2)).collect()
    assert {r["n"] for r in m} == {198, 129}


def test_far_value_takes_first_set(spark):
    df = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 10.0), ("s", 3, 500.0)], "station string, ts int, temperature double")
    u = spark.createDataFrame([("s", 0.0, 10.0)], "station string, u_min double, u_max double")
    lab = lambda **k: fuzzy.fz_fuzzify(df, u, FuzzyConfig(**k)).filter("ts = 3").first()["label"]
    assert lab() == "VeryLow" and lab(nearest=True) == "VeryHigh"


def test_advanced_features_are_wider(full):
    from wxspark.functions.weather import fe_advanced

    out = fe_advanced(features.win_diff(full))
    assert {"temp_humidity_interaction", "wind_u", "wind_v", "pressure_rising"} <= set(out.columns) and len(out.columns) > len(full.columns)


def test_pipeline_restores_units(full):
    scaled, params = pipeline.pipe_train(full, columns=["temperature"], lags=[1, 2], windows=[3])
    back = pipeline.restore(scaled, params, ["humidity"]).groupBy("station").agg(F.avg("humidity").alias("m"))
    want = full.groupBy("station").agg(F.avg("humidity").alias("w"))
    for r in back.join(want, "station").collect():
        assert r["m"] == pytest.approx(r["w"], rel=0.02)
    same = pipeline.pipe_predict(full, params, columns=["temperature"], lags=[1, 2], windows=[3])
    assert same.exceptAll(scaled.select(same.columns)).count() == 0


def test_forest_shapes_and_importance(spark, full):
    cfg = forest.ForestConfig(trees=4, depth=4)
    train = forest.training_frame(full, FEATURES, ["temperature", "humidity"], cfg).persist()
    assert train.count() == 200 + 131 - 2
    models = forest.mdl_forest(train, ["temperature", "humidity"], cfg)
    assert forest.predict_long(models, train).count() == 2 * train.count()
    imp = forest.agg_importance(models, FEATURES, spark).collect()
    assert len(imp) == 4 and sum(r["importance"] for r in imp) == pytest.approx(1)
    spread = forest.int_tree_spread(models, train)
    assert spread.filter("NOT (lower <= prediction AND prediction <= upper)").isEmpty()
    tuned = forest.mdl_forest_tune(train, "temperature", {"trees": [2, 3], "depth": [3]}, n_splits=2).collect()
    assert len(tuned) == 2 and tuned[0]["mse"] <= tuned[1]["mse"]


def test_window_regression(full):
    train = forest.window_frame(full, length=6).persist()
    assert train.count() == 200 + 131 - 12
    models = forest.mdl_window_reg(train)
    out = forest.multi_step(models, forest.recent_windows(full, length=6), 5, every=2)
    assert out.count() == 10 and out.dropna().count() == 10
    first = forest.predict_long(models, forest.recent_windows(full, length=6)).filter("target = 'pressure'").collect()
    steps = {r["station"]: r["pressure"] for r in out.filter("step = 1").collect()}
    assert steps == pytest.approx({r["station"]: r["prediction"] for r in first})
    replicas = forest.int_replicas(train, train, "temperature", replicas=3)
    assert replicas.filter("lower <= prediction AND prediction <= upper").count() == train.count()
    close = replicas.join(forest.predict_long({"temperature": models["temperature"]}, train).withColumnRenamed("prediction", "p"), ["station", "ts"])
    assert close.selectExpr("max(abs(prediction - p))").first()[0] < 3


@pytest.mark.parametrize("width", [3, 20])
def test_moments_give_the_same_ridge(full, width):
    import numpy as np

    def moments(x, y):
        shift = np.append(x[:64].mean(axis=0), y[:64].mean())
        z = np.column_stack([np.column_stack([x, y]) - shift, np.ones(len(x))])
        return z.T @ z, shift

    rnd = np.random.default_rng(1)
    x = 10 + rnd.normal(size=(400, width))
    y = x @ np.arange(1, width + 1) + rnd.normal(size=400)
    train = full.sparkSession.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label_y"])
    theirs = np.array([r["prediction"] for r in forest.mdl_window_reg(train, ["y"])["y"].transform(train).collect()])
    m, shift = moments(x, y)
    c, at = forest.ridge(m, 0.1)
    assert np.abs((x - shift[:-1]) @ c + at + shift[-1] - theirs).max() < 0.02 * y.std()
    # Far from zero nothing is lost.
    far = 1e6 + x
    exact, _ = forest.ridge(moments(far, y)[0], 0.0)
    direct = np.linalg.lstsq(np.column_stack([x - x.mean(0), np.ones(400)]), y, rcond=None)[0]
    assert np.abs(exact - direct[:-1]).max() < 1e-6


def test_poisson_counts():
    import numpy as np

    w = forest.poisson_counts(np.arange(200_000), 2)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and w.max() >= 7
    assert (forest.poisson_counts(np.arange(5), 2) == w[:5]).all()


def test_single_model_has_all_weight(spark):
    one = spark.createDataFrame([("s", "fuzzy", 2.0, True)], "station string, model string, mae double, is_trained boolean")
    for method in ("equal", "performance", "something"):
        assert [r["weight"] for r in E.en_update(one, None, E.EnsembleConfig(method=method)).collect()] == [1.0]


def test_failed_models_lose_their_weight(spark):
    w = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.25), ("s", "c", 0.25)], "station string, model string, weight double")
    ok = spark.createDataFrame([("s", "a", False), ("s", "b", True), ("s", "c", True)], "station string, model string, is_trained boolean")
    assert [r["weight"] for r in E.en_drop_failed(w, ok).collect()] == [0.5, 0.5]
    with pytest.raises(ValueError):
        E.en_drop_failed(w, ok.withColumn("is_trained", F.lit(False)))


def test_short_history_uses_training_metrics(spark):
    m = spark.createDataFrame([("s", "a", 1.0, True), ("s", "b", 4.0, True)], "station string, model string, mae double, is_trained boolean")
    rows = [("s", "a", i, 1.0, 9.0) for i in range(5)] + [("s", "b", i, 1.0, 1.0) for i in range(5)]
    log = spark.createDataFrame(rows, "station string, model string, ts int, actual double, prediction double")
    w = {r["model"]: r["weight"] for r in E.en_adaptive(m, log).collect()}
    assert w == pytest.approx({"a": 0.8, "b": 0.2})
    w = {r["model"]: r["weight"] for r in E.en_adaptive(m, log, E.EnsembleConfig(least_history=3)).collect()}
    assert w["b"] > 0.9


def test_forecast_frame(full):
    f = forecast.fc_forecast(full, 6)
    assert f.count() == 12
    r = f.filter("station = 'a' AND step = 1").first()
    assert r["lower"] <= r["temperature"] <= r["upper"] and r["confidence"] == 0.95 and set(r["contributions"]) == {"fuzzy", "arima"}


def test_training_gates(full):
    from wxspark.sources.panel import located

    few = full.filter("station = 'a' OR ts < '2024-01-02'")
    out = forecast.fc_train(located(few), targets=["temperature"])
    assert {(r["station"], r["model_type"]) for r in out.collect()} == {("a", "fuzzy"), ("a", "arima")}


def test_ensemble_state_round_trip(spark):
    w = spark.createDataFrame([("s", "a", 0.5)], "station string, model string, weight double")
    root = scratch(spark, "ens")
    save_model(w, root, "ensemble", {"method": "adaptive"})
    back, meta = load_model(spark, root, "ensemble")
    assert back.collect() == w.collect() and meta == {"method": "adaptive"}


def test_registered_forecaster_is_used(full):
    E.register_model("mean", E.Forecaster(
        fit=lambda obs, t: obs.groupBy("station").agg(F.avg(t).alias("m"), F.max("ts").alias("last_ts")),
        predict=lambda obs, p, t, steps: p.select("station", "last_ts", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.col("m").alias("prediction")),
    ))
    out = forecast.model_points(full, 4, targets=["pressure"], models=("mean", "arima"))
    assert {(r["model"], r["count"]) for r in out.groupBy("model").count().collect()} == {("mean", 8), ("arima", 8)}
    del E.FORECASTERS["mean"]
