"""Training and forecasting of all stations in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import ensemble as E
from wxspark.operators import fuzzy, intervals, metrics, places, quality, series, timeline
from wxspark.operators.fuzzy import FuzzyConfig
from wxspark.operators.series import ARConfig
from wxspark.operators.timeline import Shape, measure
from wxspark.schema import STATION, TARGET_DEFAULTS, TARGETS, TS

CONFIDENCE = 0.95


def model_points(
    obs: DataFrame, steps: int, *, targets: Sequence[str] = tuple(TARGETS), ar: ARConfig = ARConfig(), models=("fuzzy", "arima"),
    shape: Shape | None = None,
) -> DataFrame:
    """station, last_ts, step, target, model, prediction for every model and target."""
    shape = shape or measure(obs)
    out = None
    for t in targets:
        for m in models:
            if m == "fuzzy":
                part = fuzzy.fz_multi_step(obs, steps, FuzzyConfig(target=t), shape=shape)
            elif m == "arima":
                part = series.mdl_multi_step(obs, series.mdl_ar(obs, t, ar, shape=shape), t, steps, ar).drop("target")
            else:
                part = E.FORECASTERS[m].predict(obs, E.FORECASTERS[m].fit(obs, t), t, steps)
            part = part.select("station", "last_ts", "step", F.lit(t).alias("target"), F.lit(m).alias("model"), "prediction")
            out = part if out is None else out.unionByName(part)
    return out


def fc_forecast(
    obs: DataFrame, hours: int = 24, *, weights: DataFrame | None = None, bounds: DataFrame | None = None,
    targets: Sequence[str] = tuple(TARGETS), ar: ARConfig = ARConfig(), models=("fuzzy", "arima"), shape: Shape | None = None,
) -> DataFrame:
    """One row per station and hour: the four targets, the temperature interval, confidence and model contributions.

    ``weights`` (station, model, weight) default to equal; ``bounds`` (station, res_lo, res_hi) give the primary
    interval, else the spread over the models is used. A target without any prediction takes its default.
    """
    shape = shape or measure(obs)
    points = model_points(obs, hours, targets=targets, ar=ar, models=models, shape=shape)
    if weights is None:
        each = F.explode(F.array(*[F.lit(m) for m in models]))
        weights = E.en_equal(obs.select("station").distinct().withColumn("model", each))
    return combined(points, weights, bounds=bounds, targets=targets, shape=shape)


def combined(points: DataFrame, weights: DataFrame, *, bounds: DataFrame | None = None, targets: Sequence[str] = tuple(TARGETS), shape: Shape | None = None) -> DataFrame:
    """The forecast from station, last_ts, step, target, model and prediction of all models."""
    points = points.withColumn("ts", F.col("last_ts") + F.make_dt_interval(hours=F.col("step")))
    mixed = E.en_interval(points, weights, by=("station", "ts", "step", "target"))
    if bounds is not None:
        mixed = intervals.int_bounds(mixed.drop("lower", "upper"), bounds, shape=shape)
    pick = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    wide = mixed.groupBy("station", "ts", "step").agg(
        *[F.coalesce(pick(t, "prediction"), F.lit(TARGET_DEFAULTS[t])).alias(t) for t in TARGETS],
        pick(targets[0], "lower").alias("lower"),
        pick(targets[0], "upper").alias("upper"),
    )
    shares = E.en_contributions(weights)
    return wide.join(shares, "station", "left").withColumn("confidence", F.lit(CONFIDENCE))


def fc_train(
    obs: DataFrame, *, fetched: DataFrame | None = None, days: int = 30, targets: Sequence[str] = tuple(TARGETS),
    ar: ARConfig = ARConfig(), shape: Shape | None = None,
) -> DataFrame:
    """Registry rows of the models fitted on the stations that pass the gates.

    Coverage (stored or fetched rows), at least 100 rows and a valid quality report; then every station is fitted in one
    job per target: station, model_type, target, mae, rmse, mape, n, is_trained.
    """
    if fetched is not None:
        obs = places.coverage_gate(obs, fetched, days).drop("origin")
    shape = shape or measure(obs)
    enough = quality.min_rows_gate(obs, stage="train", shape=shape)
    good = quality.agg_quality(enough).filter("is_valid").select("station")
    usable = timeline.join_small(enough, good, ["station"], shape.series, "left_semi")
    scores = None
    for t in targets:
        fz = metrics.agg_metrics(fuzzy.fz_fitted(usable, FuzzyConfig(target=t), shape=shape))
        fitted = series.ar_fitted(usable, series.mdl_ar(usable, t, ar, shape=shape), t, ar, shape=shape)
        for name, m in (("fuzzy", fz), ("arima", metrics.agg_metrics(fitted))):
            part = m.withColumns({"model_type": F.lit(name), "target": F.lit(t)})
            scores = part if scores is None else scores.unionByName(part)
    return scores.withColumn("is_trained", F.col("n") > 0)


def _ar_fit(obs, target, **kw):
    return series.mdl_ar(obs, target, **kw)


E.register_model(
    "arima",
    E.Forecaster(
        fit=_ar_fit,
        predict=lambda obs, params, target, steps=1: series.mdl_multi_step(obs, params, target, steps),
        interval=lambda obs, params, target, steps=1: series.mdl_ar_interval(obs, params, target, steps=steps),
    ),
)
E.register_model(
    "fuzzy",
    E.Forecaster(
        fit=lambda obs, target: fuzzy.fz_fit(obs, FuzzyConfig(target=target)),
        predict=lambda obs, params, target, steps=1: fuzzy.fz_multi_step(obs, steps, FuzzyConfig(target=target), params=params),
        interval=lambda obs, params, target, steps=1: fuzzy.fz_interval(obs, FuzzyConfig(target=target)),
    ),
)
