"""Expanding-window validation of a forecaster over all stations and folds in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import fuzzy, metrics, series, split, timeline
from wxspark.operators.fuzzy import FuzzyConfig
from wxspark.operators.series import ARConfig
from wxspark.operators.timeline import Shape, join_small, measure
from wxspark.schema import STATION, TS
from wxspark.session import stored

#: Key of one series of one fold, in place of a station.
KEY = "fold_series"
#: (rows of all folds, their training rows, target, ts, shape) -> KEY, ts, actual, prediction; one step ahead, training rows may be among them.
Fitter = Callable[[DataFrame, DataFrame, str, str, Shape], DataFrame]


def by_autoregression(cfg: ARConfig = ARConfig()) -> Fitter:
    """An autoregression per station and fold; a fold of fewer training rows than ``cfg.min_rows`` has none."""

    def fit(rows: DataFrame, train: DataFrame, target: str, ts: str, shape: Shape) -> DataFrame:
        own = replace(cfg, station=KEY, ts=ts)
        params = stored(series.mdl_ar(train, target, own, shape=shape), "cv_ar")
        return series.ar_fitted(rows, params, target, own, shape=shape)

    return fit


def by_rules(cfg: FuzzyConfig = FuzzyConfig()) -> Fitter:
    """A rule base of first order per station and fold, over the range of its training rows."""

    def fit(rows: DataFrame, train: DataFrame, target: str, ts: str, shape: Shape) -> DataFrame:
        own = replace(cfg, target=target, station=KEY, ts=ts)
        params = stored(fuzzy.fz_fit(train, own, shape=shape), "cv_rules")
        known = rows.select(KEY, ts, target).dropna(subset=[target])
        lagged = timeline.over_rows(known, lambda w: {"_before": F.lag(target, 1).over(w)}, back=1, station=KEY, ts=ts, shape=shape)
        j = join_small(lagged.filter("_before IS NOT NULL"), params, [KEY], shape.series, "inner", per_row=4 * cfg.sets)
        led = F.get("map", fuzzy.best_set(F.col("_before"), own))["value"]
        return j.select(KEY, ts, F.col(target).alias("actual"), led.alias("prediction"))

    return fit


def cv_folds(df, target: str, models: dict[str, Fitter], *, station=STATION, ts=TS, n_splits: int = 5, shape: Shape | None = None) -> DataFrame:
    """station, fold, model and the metrics of its validation rows, for every model that fits per station.

    Each (station, fold) is a series of its own, so the fits of all folds are the same few jobs as one fit of all stations; nothing loops
    over folds. Validation rows are those after the last training row of their fold. Rows without a station are left out; a fold
    a model cannot be fitted on has no row for it.
    """
    folds = split.win_cv_folds(df.select(station, ts, target).filter(F.col(station).isNotNull()), station=station, ts=ts, n_splits=n_splits, shape=shape)
    rows = stored(folds.withColumn(KEY, F.concat(F.col("fold").cast("string"), F.lit(":"), F.col(station).cast("string"))), "cv_folds")
    keyed = measure(rows, KEY)
    train = rows.filter("role = 'train'").select(KEY, ts, target)
    starts = rows.filter("role = 'train'").groupBy(KEY, station, "fold").agg(F.max(ts).alias("_last"))
    made = [
        fit(rows.select(KEY, ts, target), train, target, ts, keyed).select(KEY, ts, "actual", "prediction", F.lit(name).alias("model"))
        for name, fit in models.items()
    ]
    judged = join_small(reduce(DataFrame.unionByName, made), starts, [KEY], keyed.series, "inner").filter(F.col(ts) > F.col("_last"))
    return metrics.agg_metrics(judged.dropna(subset=["actual", "prediction"]), by=[station, "fold", "model"])


def cv_models(df, target: str, models: dict[str, Fitter] | None = None, *, station=STATION, ts=TS, n_splits: int = 5, shape: Shape | None = None) -> DataFrame:
    """Mean and deviation of the fold metrics of every model: by default the autoregression and the rule base."""
    models = models or {"arima": by_autoregression(), "fuzzy": by_rules()}
    return metrics.agg_cv_summary(cv_folds(df, target, models, station=station, ts=ts, n_splits=n_splits, shape=shape), by=[station, "model"])


def cv_time_series(df, target: str, *, station=STATION, ts=TS, n_splits: int = 5, shape: Shape | None = None) -> DataFrame:
    """Fit a first-order autoregression on the training part of each fold and score the validation part.

    Lags are taken once before the rows are copied to folds; the fits of all folds are one grouped aggregate.
    """
    shape = shape or timeline.measure(df, station)
    lagged = timeline.over_rows(
        df.select(station, ts, target), lambda w: {"_x": F.lag(target).over(w)}, back=1, station=station, ts=ts, shape=shape
    )
    folds = split.win_cv_folds(lagged, station=station, ts=ts, n_splits=n_splits, shape=shape)
    fold_fit = folds.filter("role = 'train'").withColumn("_k", F.struct(station, "fold"))
    m = series.moments(fold_fit.withColumnRenamed(target, "_y"), ["_y", "_x"], station="_k")
    slope = F.try_divide(F.col("cov")[1], F.nullif(F.col("cov")[2], F.lit(0.0)))
    fit = m.select(f"_k.{station}", "_k.fold", slope.alias("_b"), (F.col("means")[0] - slope * F.col("means")[1]).alias("_a"))
    scored = timeline.join_small(folds.filter("role = 'validation'"), fit, [station, "fold"], shape.series * n_splits, "inner")
    scored = scored.withColumn("prediction", F.col("_a") + F.col("_b") * F.col("_x"))
    per_fold = metrics.agg_metrics(scored, by=[station, "fold"], truth=target)
    return metrics.agg_cv_summary(per_fold, by=[station])
