import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wxspark.functions import geo, labels, weather
from wxspark.operators import ensemble as E
from wxspark.operators import features, fuzzy, metrics, places, quality, select, split
from wxspark.operators.clean import nan_to_num


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "x,edges,want",
    [(0, weather.TEMPERATURE_EDGES, 0), (0.1, weather.TEMPERATURE_EDGES, 1), (50, weather.TEMPERATURE_EDGES, 4), (50.1, weather.TEMPERATURE_EDGES, None),
     (0, weather.WIND_EDGES, None), (0, weather.RAIN_EDGES, 0), (2.5, weather.RAIN_EDGES, 1), (51, weather.RAIN_EDGES, 4), (1013, weather.PRESSURE_EDGES, 1)],
)
def test_bin_edges(spark, x, edges, want):
    assert value(spark, weather.right_closed(F.lit(float(x)), edges)) == want


def test_weather_formulas(spark):
    lit = lambda x: F.lit(float(x))
    al = 17.27 * 25 / (237.7 + 25) + math.log(0.6)
    assert value(spark, weather.dew_point(lit(25), lit(60))) == pytest.approx(237.7 * al / (17.27 - al))
    assert value(spark, weather.dew_point(lit(25), lit(0))) is None
    assert value(spark, weather.wind_chill(lit(0), lit(10))) == pytest.approx(13.12 - 11.37 * 36**0.16)
    assert value(spark, weather.wind_chill(lit(11), lit(10))) == 11
    assert value(spark, weather.heat_index(lit(20), lit(50))) == pytest.approx(20 + 0.5 * (81 + (20 - 68) * 1.2 + 4.7))
    assert value(spark, weather.feels_like(lit(15), lit(50), lit(3))) == 15
    assert [value(spark, weather.season(F.lit(m))) for m in (12, 1, 2, 3, 5, 6, 8, 9, 11)] == [0, 0, 0, 1, 1, 2, 2, 3, 3]
    assert 40 < value(spark, weather.heat_index(lit(35), lit(60), "f")) < 50


def test_haversine(spark):
    one = value(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert one == pytest.approx(math.pi * 6371 / 180)
    assert value(spark, geo.haversine(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0))) == 0


def test_labels(spark):
    assert value(spark, labels.performance_label(F.lit(1.9))) == "Excellent"
    assert value(spark, labels.display_name(F.lit("other"))) == "OTHER"
    assert value(spark, labels.influence_label(F.lit(0.3))) == "Medium"


def test_membership_is_a_share(spark):
    df = spark.range(-20, 21).select(fuzzy.membership(F.col("id") / 4.0, F.lit(1.0), F.lit(2.0)).alias("m"), "id")
    rows = {r["id"]: r["m"] for r in df.collect()}
    assert all(0 <= m <= 1 for m in rows.values()) and rows[4] == 1 and rows[0] == 0.5 and rows[20] == 0
    assert value(spark, fuzzy.membership(F.lit(2.0), F.lit(2.0), F.lit(0.0))) == 1


def test_metrics_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", nan, 5.0), ("b", None, 1.0), ("c", 3.0, 3.0), ("c", 3.0, 3.0), ("d", 3.0, 4.0)], "station string, actual double, prediction double")
    m = {r["station"]: r for r in metrics.agg_metrics_detailed(df).collect()}
    assert (m["a"]["n"], m["a"]["mae"], m["a"]["mape"]) == (1, 1.0, 100.0)
    assert m["b"]["mae"] == float("inf") and m["b"]["r2"] == float("-inf")
    assert m["c"]["r2"] == 1.0 and m["d"]["r2"] == 0.0


def test_constant_columns_rank_last(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, 2.0), ("a", 2.0, 5.0, 3.0), ("a", 3.0, 5.0, 1.0)], "station string, x double, k double, y double")
    rows = select.agg_corr_rank(df, ["k", "x"], "y").orderBy("rank").collect()
    assert [r["feature"] for r in rows] == ["x", "k"] and rows[1]["score"] == 0


def test_topk_importance(spark):
    many = spark.createDataFrame([(f"f{i:03}", 0.5 - i / 1000) for i in range(80)], "feature string, importance double")
    assert select.topk_importance(many).count() == 50
    few = spark.createDataFrame([(f"f{i:03}", 0.5 if i < 2 else 0.0) for i in range(30)], "feature string, importance double")
    assert select.topk_importance(few).count() == 10


def test_inputs_are_checked(spark, full):
    with pytest.raises(ValueError):
        features.val_input(full, ["nope"])
    with pytest.raises(ValueError):
        features.val_input(full, ["humidity"], expected=2)
    with pytest.raises(ValueError):
        features.val_input(full.filter("false"), ["humidity"])
    assert features.distinct_features(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


def test_rejected_rows_carry_reasons(spark, full):
    bad = full.withColumn("humidity", F.when(F.col("station") == "a", 101.0).otherwise(F.col("humidity").cast("double") * 0 + 50))
    good, rejected = quality.split_valid(bad.withColumn("wind_speed", F.abs("wind_speed")))
    assert good.count() == 131 and rejected.count() == 200 and rejected.first()["reasons"] == ["humidity out of range"]


def test_quality_strict(spark, full):
    few = full.filter("ts < '2024-01-01 10:00:00'")
    assert all(r["is_valid"] for r in quality.agg_quality(few).collect())
    assert not any(r["is_valid"] for r in quality.agg_quality(few, strict=True).collect())


def test_nan_to_num(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert sorted(r["x"] for r in nan_to_num(df, ["x"]).collect()) == [0.0, 0.0, 0.0, 2.0]


def test_nearest_city_with_poles_and_date_line(spark):
    towns = spark.createDataFrame([("east", 0.0, 179.9, 1), ("pole", 89.7, 10.0, 2), ("mid", 45.0, 7.0, 3)], "name string, lat double, lon double, rank int")
    pts = [(1, 0.0, -179.9), (2, 89.8, -170.0), (3, 45.5, 6.2), (4, -60.0, 0.0), (5, 45.0, 8.2)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {r["id"]: r["city"] for r in places.join_nearest_city(df, towns).collect()}
    assert got == {1: "east", 2: "pole", 3: "mid", 4: None, 5: "mid"}


def test_band_join_equals_brute_force(spark):
    import random

    rnd = random.Random(1)
    req = [(i, rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for i in range(40)]
    rows = [(i, round(rnd.uniform(-2, 2), 1), round(rnd.uniform(-2, 2), 1)) for i in range(500)]
    a = spark.createDataFrame(req, "id int, lat double, lon double")
    b = spark.createDataFrame(rows, "row int, latitude double, longitude double")
    want = {(i, r) for i, la, lo in req for r, y, x in rows if la - 0.1 <= y <= la + 0.1 and lo - 0.1 <= x <= lo + 0.1}
    for salt in (1, 5):
        got = [(r["id"], r["row"]) for r in places.join_band(a, b, salt=salt).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # Cells of any crowding; a third of the rows lies in one of them.
    crowded = b.union(b.selectExpr("row + 1000", "0.5D", "0.5D").limit(250))
    want |= {(i, r["row"]) for i, la, lo in req for r in crowded.filter("row >= 1000").collect() if abs(la - 0.5) <= 0.1 and abs(lo - 0.5) <= 0.1}
    for crowd in (2, 60, 10_000):
        got = [(r["id"], r["row"]) for r in places.join_band(a, crowded, crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left = places.join_band(a, b, how="left")
    assert left.select("id").distinct().count() == 40


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0.001, 1e4), min_size=1, max_size=8))
def test_weights_add_up(spark, maes):
    df = spark.createDataFrame([("s", f"m{i}", m, i % 3 != 2) for i, m in enumerate(maes)], "station string, model string, mae double, is_trained boolean")
    w = [r["weight"] for r in E.en_performance(df).collect()]
    assert sum(w) == pytest.approx(1) and min(w) >= 0.05 / (1 + 0.05 * len(w)) - 1e-9


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 400), st.floats(0.05, 0.4), st.floats(0.05, 0.4))
def test_split_sizes(spark, n, test, val):
    df = spark.range(n).select(F.lit("s").alias("station"), F.col("id").alias("ts"))
    got = {r["role"]: r["count"] for r in split.win_split(df, test_size=test, validation_size=val).groupBy("role").count().collect()}
    assert got.get("train", 0) == int(n * (1 - test - val)) and got.get("train", 0) + got.get("validation", 0) == int(n * (1 - test))
    assert sum(got.values()) == n


def test_unknown_models_are_skipped():
    import wxspark.plans.forecast  # noqa: F401

    with pytest.warns(UserWarning):
        assert E.initial_weights(["fuzzy", "arima", "nope", "lstm"]) == {"fuzzy": 0.25, "arima": 0.25}
