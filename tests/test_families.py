"""Five families: windows from moments, node tables, recursive features, versions, training and forecasting."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wxspark.operators import forest, recursive, trees, windowed
from wxspark.operators.forest import ForestConfig
from wxspark.plans import families
from wxspark.schema import TARGETS
from wxspark.session import scratch, stored
from wxspark.sources import commits


@pytest.mark.parametrize(("length", "block"), [(24, 8192), (24, 30), (90, 8192), (90, 40)])
def test_windows_from_moments_equal_copied_windows(full, monkeypatch, length, block):
    """Lengths beyond half a series make its first and last rows overlap."""
    monkeypatch.setattr(windowed, "BLOCK", block)
    some = full.withColumn("humidity", F.when(F.hour("ts") % 11 != 3, F.col("humidity")))
    want = forest.mdl_window_reg(stored(forest.window_frame(some, length=length)))
    got = windowed.fit_windows(some, length)
    for t in TARGETS:
        assert np.allclose(got[t][0], want[t].coefficients.toArray(), atol=1e-8)
        assert abs(got[t][1] - want[t].intercept) < 1e-4
    pred = {(r.station, r.ts, r.target): r.prediction for r in windowed.predicted(some, got, length).collect()}
    rows = {}
    for r in some.dropna(subset=TARGETS).orderBy("station", "ts").collect():
        rows.setdefault(r.station, []).append(r)
    n = 0
    for s, run in rows.items():
        for i in range(length, len(run)):
            x = np.array([[q[t] for t in TARGETS] for q in run[i - length : i]]).ravel()
            for t in TARGETS:
                assert abs(pred[s, run[i].ts, t] - (x @ got[t][0] + got[t][1])) < 1e-6
                n += 1
    assert n == len(pred)


def test_no_window_no_model(full):
    assert windowed.fit_windows(full, 500) == {} and windowed.fit_windows(full.limit(0), 5) == {}


def test_node_table_votes_equal_each_tree(full, spark):
    train = stored(forest.training_frame(full, ["temperature", "humidity", "pressure"], ["temperature", "wind_speed"]))
    models = forest.mdl_forest(train, ["temperature", "wind_speed"], ForestConfig(trees=7, depth=9))
    nodes = stored(trees.node_table(models, spark))
    got = {(r.station, r.ts, r.target): (r.prediction, r.lower, r.upper) for r in trees.tree_spread(train, nodes).collect()}
    want = {(r.station, r.ts, r.target): (r.prediction, r.lower, r.upper) for r in forest.int_tree_spread(models, train).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert trees.tree_spread(train.limit(0), nodes).count() == 0


def test_ring_buffer_rebuilds_window_features(full):
    """Features of the newest row, from all rows before it, both ways."""
    made = {r.station: r for r in recursive.with_features(full).withColumn("x", vector_to_array("features")).groupBy("station").agg(F.max("ts").alias("ts"), F.max_by("x", "ts").alias("x")).collect()}
    last = full.groupBy("station").agg(F.max("ts").alias("newest"))
    before = full.join(last, "station").filter("ts < newest").drop("newest")
    state = recursive.newest_rows(before, recursive.DEPTH).collect()
    assert len(state) == 2
    for r in state:
        x = recursive.rebuilt(np.array([r["rows"]]), np.array([made[r.station].ts], "datetime64[us]"))
        assert np.allclose(x[0], made[r.station].x)


def test_steps_use_own_predictions(full):
    half = lambda b, at: b[:, -1] / 2 + b[:, 0]
    out = recursive.stepped(recursive.newest_rows(full, 5), 4, {"half": (3, half), "deep": (6, half)}).collect()
    assert {r.model for r in out} == {"half"} and len(out) == 2 * 4 * len(TARGETS)
    for s in ("a", "b"):
        rows = [[r[t] for t in TARGETS] for r in full.filter(F.col("station") == s).orderBy(F.desc("ts")).limit(3).collect()][::-1]
        for step in range(1, 5):
            rows.append((np.array(rows[-1]) / 2 + rows[-3]).tolist())
            got = {r.target: r.prediction for r in out if r.station == s and r.step == step}
            assert np.allclose([got[t] for t in TARGETS], rows[-1])


def test_ridge_of_all_targets_equals_single_fits(full):
    train = stored(recursive.with_features(full))
    got = recursive.fit_ridge(train)
    want = forest.mdl_window_reg(train)
    for t in TARGETS:
        x = np.array([r[0].toArray() for r in train.select("features").limit(20).collect()])
        assert np.allclose(x @ got[t][0] + got[t][1], x @ want[t].coefficients.toArray() + want[t].intercept, atol=1e-5)
    assert recursive.fit_ridge(train.limit(0)) == {}


def test_a_killed_writer_leaves_nothing_to_see(spark):
    root = scratch(spark, "commits")
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("y",)], "y string")
    assert commits.newest_version(spark, root) is None and commits.read_all(spark, root, "a") is None
    commits.commit(spark, root, "v1", {"a": a, "b": b}, created_at=datetime(2024, 1, 1))

    broken = b.select(F.raise_error(F.lit("lost")).alias("y"))
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, root, "v2", {"a": a, "b": broken}, created_at=datetime(2024, 1, 2))
    assert commits.newest_version(spark, root) == "v1" and commits.read_all(spark, root, "a").count() == 1
    with pytest.raises(LookupError):
        commits.read(spark, root, "a", "v2")
    with pytest.raises(ValueError, match="v1"):
        commits.commit(spark, root, "v1", {"a": a})
    assert commits.sweep(spark, root) == ["v2"] and commits.sweep(spark, root) == []
    commits.commit(spark, root, "v2", {"a": a.union(a)}, created_at=datetime(2024, 1, 2))
    assert commits.newest_version(spark, root) == "v2" and commits.read(spark, root, "a").count() == 2
    assert sorted((r.x, r.version) for r in commits.read_all(spark, root, "a").collect()) == [(1, "v1"), (1, "v2"), (1, "v2")]
    assert commits.read(spark, root, "b", "v1").count() == 1


CFG = families.FamilyConfig(length=12, forest=ForestConfig(trees=5, depth=4))


@pytest.fixture(scope="module")
def trained(spark, full):
    obs = stored(full.withColumns({"latitude": F.lit(10.0), "longitude": F.lit(70.0)}))
    root = scratch(spark, "families")
    families.save(families.train(obs, CFG), root, "v1", datetime(2024, 2, 1), CFG)
    return obs, root, families.load(spark, root)


def test_every_family_is_trained_and_registered(spark, trained):
    _, root, tables = trained
    scores = tables["scores"].collect()
    assert {(r.station, r.model, r.target) for r in scores} == {(s, m, t) for s in "ab" for m in families.FAMILIES for t in TARGETS}
    assert all(r.n > 20 and r.mae < 40 for r in scores)
    weights = tables["weights"].groupBy("station").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert all(abs(r.w - 1) < 1e-9 and r.n == 5 for r in weights)
    rows = commits.read_all(spark, root, "registry").collect()
    assert len(rows) == 10 and {r.model_type for r in rows} == set(families.FAMILIES)
    mae = {(r.station, r.model): [] for r in scores}
    for r in scores:
        mae[r.station, r.model].append(r.mae)
    assert all(abs(r.mae - np.mean(mae[r.station, r.model_type])) < 1e-9 and r.training_rows in (200, 131) for r in rows)


def test_forecast_is_the_weighted_mean_of_all_families(trained):
    obs, _, tables = trained
    points = families.points(obs, tables, 6, CFG).collect()
    assert len(points) == 2 * 6 * len(TARGETS) * len(families.FAMILIES)
    weight = {(r.station, r.model): r.weight for r in tables["weights"].collect()}
    bound = {r.station: (r.res_lo, r.res_hi) for r in tables["bounds"].filter("target = 'temperature'").collect()}
    out = families.forecast(obs, tables, 6, CFG).collect()
    assert len(out) == 12
    for r in out:
        for t in TARGETS:
            own = [(p.prediction, weight[p.station, p.model]) for p in points if (p.station, p.step, p.target) == (r.station, r.step, t)]
            assert abs(r[t] - sum(p * w for p, w in own) / sum(w for _, w in own)) < 1e-9
        lo, hi = bound[r.station]
        assert np.allclose([r.lower, r.upper], [min(r.temperature, r.temperature + lo), max(r.temperature, r.temperature + hi)])
        assert set(r.contributions) == set(families.FAMILIES)


def test_pooled_families_step_like_a_plain_loop(spark, trained):
    obs, _, tables = trained
    got = {(p.station, p.model, p.step, p.target): p.prediction for p in families.points(obs, tables, 5, CFG).collect()}
    window = {r.target: r for r in tables["window"].collect()}
    nodes = tables["forest"].collect()
    by_place = {(n.target, n.tree, n.node): n for n in nodes}

    def tree(target, i, x):
        at = by_place[target, i, 0]
        while at.feature >= 0:
            at = by_place[target, i, at.left if x[at.feature] <= at.threshold else at.right]
        return at.prediction

    clean = families.pipeline.cleaned(obs.select("station", "ts", *families.BASE), tables["pipeline"])
    for s in "ab":
        rows = clean.filter(F.col("station") == s).orderBy("ts").collect()
        lstm = [[r[t] for t in TARGETS] for r in rows]
        grown = [list(r) for r in lstm]
        for step in range(1, 6):
            x = np.array(lstm[-12:]).ravel()
            lstm.append([float(x @ np.array(window[t].coefficients) + window[t].intercept) for t in TARGETS])
            at = np.datetime64(rows[-1].ts) + np.timedelta64(step, "h")
            f = recursive.rebuilt(np.array([grown[-24:]]), np.array([at]))[0]
            grown.append([float(np.mean([tree(t, i, f) for i in range(5)])) for t in TARGETS])
            for t, a, b in zip(TARGETS, lstm[-1], grown[-1]):
                assert abs(got[s, "lstm", step, t] - a) < 1e-6 and abs(got[s, "random_forest", step, t] - b) < 1e-6


def test_a_family_that_cannot_be_fitted_stays_out(trained):
    obs, _, _ = trained
    cfg = families.FamilyConfig(length=400, forest=ForestConfig(trees=2, depth=2), families=("lstm", "lube", "arima"), targets=("temperature",))
    tables = families.train(obs, cfg)
    assert tables["window"].count() == 0 and {r.model for r in tables["scores"].select("model").distinct().collect()} == {"lube", "arima"}
    out = families.forecast(obs, tables, 2, cfg).collect()
    assert len(out) == 4 and all(set(r.contributions) == {"lube", "arima"} and r.humidity == 50.0 for r in out)
