"""Weights, combination, intervals and state of a model ensemble. Weight frames have a few rows per station."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wxspark.operators.metrics import agg_metrics_detailed
from wxspark.operators.timeline import count_small, join_small, newest
from wxspark.schema import STATION, TS

Z95 = 1.96


@dataclass(frozen=True)
class EnsembleConfig:
    method: str = "adaptive"
    min_weight: float = 0.05
    window: int = 100
    least_history: int = 10
    untrained_score: float = 0.1
    epsilon: float = 1e-6
    interval: str = "primary"

    def with_(self, **changes) -> EnsembleConfig:
        return replace(self, **changes)


def _normalised(scores: DataFrame, score: Column, keys: Sequence[str], floor: float) -> DataFrame:
    """Share of the score, raised to the floor, shared again."""
    w = Window.partitionBy(*keys)
    out = scores.withColumn("weight", score).withColumn("weight", F.col("weight") / F.sum("weight").over(w))
    out = out.withColumn("weight", F.greatest("weight", F.lit(floor)))
    return out.withColumn("weight", F.col("weight") / F.sum("weight").over(w))


def en_equal(models: DataFrame, *, keys: Sequence[str] = (STATION,)) -> DataFrame:
    w = Window.partitionBy(*keys)
    return models.withColumn("weight", 1.0 / F.count(F.lit(1)).over(w)).select(*keys, "model", "weight")


def performance_score(cfg: EnsembleConfig) -> Column:
    mae = F.col("mae")
    good = F.when(mae > 0, F.try_divide(F.lit(1.0), mae)).otherwise(F.lit(1.0))
    return F.when(F.coalesce(F.col("is_trained"), F.lit(False)) & mae.isNotNull(), good).otherwise(F.lit(cfg.untrained_score))


def en_performance(models: DataFrame, cfg: EnsembleConfig = EnsembleConfig(), *, keys: Sequence[str] = (STATION,)) -> DataFrame:
    """models: keys, model, mae, is_trained."""
    out = _normalised(models, performance_score(cfg), keys, cfg.min_weight)
    return out.select(*keys, "model", "weight")


def recent_errors(log: DataFrame, cfg: EnsembleConfig, *, station=STATION, ts=TS) -> DataFrame:
    """Mean absolute error of the last records of each station and model: station, model, avg_error, records."""
    scored = log.filter(F.col("prediction").isNotNull() & F.col("actual").isNotNull())
    last = newest(scored, cfg.window, keys=[station, "model"], ts=ts)
    return last.groupBy(station, "model").agg(
        F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("avg_error"), F.count(F.lit(1)).alias("records")
    )


def en_adaptive(
    models: DataFrame, log: DataFrame, cfg: EnsembleConfig = EnsembleConfig(), *, station=STATION, ts=TS
) -> DataFrame:
    """Inverse recent error; stations with a short history use the training metrics instead."""
    err = recent_errors(log, cfg, station=station, ts=ts)
    j = models.join(err, [station, "model"], "left")
    w = Window.partitionBy(station)
    enough = F.coalesce(F.max("records").over(w), F.lit(0)) >= cfg.least_history
    recent = F.when(F.col("avg_error").isNotNull(), 1.0 / (F.col("avg_error") + cfg.epsilon)).otherwise(F.lit(1.0))
    j = j.withColumn("_enough", enough)
    score = F.when(F.col("_enough"), recent).otherwise(performance_score(cfg))
    return _normalised(j, score, [station], cfg.min_weight).select(station, "model", "weight")


def en_update(models, log=None, cfg: EnsembleConfig = EnsembleConfig(), **opts) -> DataFrame:
    """Weights by the configured method; an unknown method means equal weights."""
    if cfg.method == "performance":
        return en_performance(models, cfg)
    if cfg.method == "adaptive" and log is not None:
        return en_adaptive(models, log, cfg, **opts)
    return en_equal(models)


def _weighted(predictions: DataFrame, weights: DataFrame, station: str) -> DataFrame:
    return join_small(predictions, weights, [station, "model"], count_small(weights), "inner")


def en_combine(predictions: DataFrame, weights: DataFrame, *, station=STATION, by: Sequence[str] = (STATION, TS, "target")) -> DataFrame:
    """Weighted mean per target over the models that produced a prediction."""
    j = _weighted(predictions.filter(F.col("prediction").isNotNull()), weights, station)
    return j.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("weight") * F.col("prediction")), F.sum("weight")).alias("prediction"),
        F.count(F.lit(1)).alias("models"),
    )


def en_interval(
    predictions: DataFrame, weights: DataFrame, primary: DataFrame | None = None, *, station=STATION,
    by: Sequence[str] = (STATION, TS, "target"), z: float = Z95,
) -> DataFrame:
    """Combined prediction with the primary interval (by, lower, upper) where it exists, else the spread over models."""
    j = _weighted(predictions.filter(F.col("prediction").isNotNull()), weights, station)
    p, s = F.avg("prediction"), F.stddev_pop("prediction")
    out = j.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("weight") * F.col("prediction")), F.sum("weight")).alias("prediction"),
        (p - z * s).alias("lower"), (p + z * s).alias("upper"),
    )
    if primary is None:
        return out
    own = primary.select(*by, F.col("lower").alias("_lo"), F.col("upper").alias("_hi"))
    j = out.join(own, list(by), "left")
    return j.withColumns({"lower": F.coalesce("_lo", "lower"), "upper": F.coalesce("_hi", "upper")}).drop("_lo", "_hi")


def en_drop_failed(weights: DataFrame, trained: DataFrame, *, station=STATION) -> DataFrame:
    """Remove untrained models (trained: station, model, is_trained) and share their weight. Raises if a station is left
    without a model; only whether one exists is looked at."""
    ok = trained.filter("is_trained").select(station, "model")
    left = weights.join(ok, [station, "model"], "left_semi")
    bare = weights.select(station).distinct().join(left.select(station).distinct(), station, "left_anti")
    if not bare.isEmpty():
        raise ValueError("no model is left for at least one station")
    w = Window.partitionBy(station)
    return left.withColumn("weight", F.col("weight") / F.sum("weight").over(w))


def join_actuals(predictions: DataFrame, actuals: DataFrame, *, on: Sequence[str] = (STATION, TS, "target")) -> DataFrame:
    """Attach the truth and the absolute error to stored predictions."""
    j = predictions.join(actuals.select(*on, "actual"), list(on), "left")
    return j.withColumn("abs_error", F.abs(F.col("actual") - F.col("prediction")))


def en_metrics(log: DataFrame, weights: DataFrame, *, station=STATION) -> DataFrame:
    """Detailed metrics of every model and of the ensemble, with weights and the number of models."""
    combined = en_combine(log, weights, station=station)
    truth = log.groupBy(station, TS, "target").agg(F.max("actual").alias("actual"))
    ens = combined.join(truth, [station, TS, "target"]).withColumn("model", F.lit("ensemble"))
    every = log.select(station, "model", "actual", "prediction").unionByName(ens.select(station, "model", "actual", "prediction"))
    m = agg_metrics_detailed(every, by=[station, "model"])
    counts = weights.groupBy(station).agg(F.count(F.lit(1)).alias("model_count"))
    return m.join(weights, [station, "model"], "left").join(counts, station, "left")


def en_contributions(weights: DataFrame, *, station=STATION) -> DataFrame:
    """Current weights as one map per station."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "weight"))))
    return weights.groupBy(station).agg(pairs.alias("contributions"))


# ---- extension point ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forecaster:
    """``fit(df) -> params``, ``predict(df, params) -> points`` and ``interval(df, params) -> points with bounds``."""

    fit: Callable[..., DataFrame]
    predict: Callable[..., DataFrame]
    interval: Callable[..., DataFrame] | None = None


FORECASTERS: dict[str, Forecaster] = {}


def register_model(name: str, forecaster: Forecaster) -> None:
    FORECASTERS[name] = forecaster


def initial_weights(names: Sequence[str]) -> dict[str, float]:
    """1/n for the known names; unknown names are skipped with a warning."""
    import warnings

    known = [n for n in names if n in FORECASTERS]
    for n in names:
        if n not in FORECASTERS:
            warnings.warn(f"unknown model skipped: {n}", stacklevel=2)
    return {n: 1.0 / len(names) for n in known}
