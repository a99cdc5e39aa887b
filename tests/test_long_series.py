"""Both plans of every ordered operator give the same rows; the long-series plan is forced with tiny limits."""

import pytest
from pyspark.sql import functions as F

from conftest import as_set
from wxspark.operators import clean, features, fuzzy, report, series, split, timeline
from wxspark.operators.clean import forced
from wxspark.operators.fuzzy import FuzzyConfig
from wxspark.sources.panel import forecast_log


@pytest.fixture(scope="module")
def shapes(obs):
    short = timeline.measure(obs)
    return short, forced(short, max_rows=5, block_rows=17, chunk_days=2)


CASES = {
    "position": lambda df, s: timeline.with_position(df.select("station", "ts"), shape=s),
    "lag": lambda df, s: features.win_lag(df, columns=["humidity"], shape=s),
    "rolling": lambda df, s: features.win_rolling(df, columns=["humidity"], shape=s),
    "diff": lambda df, s: features.win_diff(df, shape=s).select("station", "ts", "pressure_tendency"),
    "interpolate": lambda df, s: clean.win_interpolate(df, shape=s).select("station", "ts", "temperature"),
    "running": lambda df, s: timeline.running_sum(df.select("station", "ts", "humidity"), "humidity", "c", shape=s),
    "split": lambda df, s: split.win_split(df.select("station", "ts"), shape=s),
    "folds": lambda df, s: split.win_cv_folds(df.select("station", "ts"), shape=s),
    "sequences": lambda df, s: split.win_sequences(df, length=40, features=["pressure"], targets=["pressure"], shape=s),
    "last window": lambda df, s: split.win_sequences_predict(df, length=40, features=["pressure"], last_only=True, shape=s),
    "history": lambda df, s: split.win_history_bound(df.select("station", "ts"), keep=30),
    "labels": lambda df, s: fuzzy.prepare(df, FuzzyConfig(order=2), shape=s)[1],
    "trend": lambda df, s: series.win_seasonal_trend(df.select("station", "ts", "humidity"), "humidity", 24, shape=s),
    "long trend": lambda df, s: series.win_seasonal_trend(df.select("station", "ts", "humidity"), "humidity", 60, shape=s),
    "odd trend": lambda df, s: series.win_seasonal_trend(df.select("station", "ts", "humidity"), "humidity", 61, shape=s),
    "decompose": lambda df, s: series.ts_decompose(df, "humidity", 24, shape=s),
    "kpss": lambda df, s: series.ts_kpss(df, "humidity", shape=s),
    "ar": lambda df, s: series.mdl_ar(df, "humidity", series.ARConfig(p=2), shape=s),
    "naive log": lambda df, s: forecast_log(df, target="humidity", shape=s),
}


@pytest.mark.parametrize("name", CASES)
def test_plans_agree(obs, shapes, name):
    short, long = (CASES[name](obs, s) for s in shapes)
    assert as_set(short.select(sorted(short.columns)), 6) == as_set(long.select(sorted(short.columns)), 6)


def test_blocks_bound_every_task(obs, shapes):
    fr = timeline.frames(obs, back=3, ahead=2, shape=shapes[1])
    sizes = fr.df.groupBy(*fr.keys).count().agg(F.max("count")).first()[0]
    assert sizes <= 17 + 3 + 2


@pytest.mark.parametrize("accuracy", [20_000, 10])
def test_bracketed_quantiles_are_exact(obs, shapes, accuracy):
    cols, probs = ["temperature", "precipitation", "wind_direction"], [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    want = clean.station_quantiles(obs, cols, probs, shape=shapes[0])
    got = clean.station_quantiles(obs, cols, probs, shape=shapes[1], accuracy=accuracy)
    assert as_set(want, 9) == as_set(got, 9)


def test_bracketed_quantiles_with_ties(spark, shapes):
    df = spark.createDataFrame([("a", float(v)) for v in [0] * 60 + [1, 1, 2, 5, 5, 9]] + [("b", 4.0)], "station string, x double")
    for acc in (10, 1000):
        got = clean.station_quantiles(df, ["x"], [0.1, 0.5, 0.95], shape=shapes[1], accuracy=acc)
        assert as_set(got) == as_set(clean.station_quantiles(df, ["x"], [0.1, 0.5, 0.95], shape=shapes[0]))


def test_first_hours_reduce_before_the_shuffle(obs):
    plan = report.limit_first_hours(obs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_batched_moments_equal_native(full):
    names = ["temperature", "humidity", "pressure"]
    native = series.moments(full, names)
    from pyspark.sql import functions as F

    batched = series._batched_moments(full.select("station", F.array(*names).alias("x")), 3, "station")
    assert as_set(native, 6) == as_set(batched, 6)


@pytest.mark.parametrize("period", [12, 13])
@pytest.mark.parametrize("column", ["humidity", "temperature"])
def test_running_sum_trend_equals_frames(obs, shapes, period, column, monkeypatch):
    df = obs.select("station", "ts", column)
    want = as_set(series.win_seasonal_trend(df, column, period, shape=shapes[0]), 6)
    monkeypatch.setattr(series, "FRAME_PERIOD", 0)
    for s in shapes:
        assert as_set(series.win_seasonal_trend(df, column, period, shape=s), 6) == want


def test_nothing_is_quadratic(obs, shapes):
    """No window frame reaches to the end of its partition; such a frame is evaluated anew for every row."""
    for shape in shapes:
        for name in ("interpolate", "labels", "running", "sequences"):
            plan = CASES[name](obs, shape)._jdf.queryExecution().executedPlan().toString()
            rows = [p for p in plan.split("specifiedwindowframe(")[1:] if "unboundedfollowing" in p.split(")")[0]]
            assert all("unboundedpreceding" in p.split(")")[0] for p in rows), name
