"""Five model families from training to forecast: fitted together, stored as one version, read back as one.

``train`` runs the gates, fits the cleaning parameters and every family on the first part of each series, and scores them on the
rest, one step ahead. ``save`` commits all tables and the registry rows through one manifest. ``forecast`` reads a version and steps
each family on its own predictions. Families: ``lstm`` is a ridge regression on the last rows, ``arima`` an autoregression per
station, ``random_forest`` and ``lube`` learn from recursive features over all stations (``lube`` linearly, with
residual quantiles per station as its bounds), ``fuzzy`` a rule base per station.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.operators import fuzzy, metrics, places, quality, recursive, series, split, timeline, trees, windowed
from wxspark.operators import ensemble as E
from wxspark.operators.forest import ForestConfig, mdl_forest
from wxspark.operators.fuzzy import FuzzyConfig
from wxspark.operators.intervals import int_bounds_fit
from wxspark.operators.series import ARConfig
from wxspark.operators.timeline import Shape, join_small, measure
from wxspark.plans import pipeline
from wxspark.plans.forecast import combined
from wxspark.schema import BASE, STATION, TARGETS, TS
from wxspark.session import stored
from wxspark.sources import commits

FAMILIES = ("lstm", "arima", "random_forest", "fuzzy", "lube")


@dataclass(frozen=True)
class FamilyConfig:
    targets: tuple[str, ...] = tuple(TARGETS)
    families: tuple[str, ...] = FAMILIES
    length: int = 168
    reg: float = 0.1
    forest: ForestConfig = field(default_factory=ForestConfig)
    ar: ARConfig = field(default_factory=ARConfig)
    train: float = 0.8
    alpha: float = 0.05


def usable(obs: DataFrame, *, fetched: DataFrame | None = None, days: int = 30, shape: Shape | None = None) -> DataFrame:
    """Rows of the stations that pass the gates: coverage, at least 100 rows, a valid quality report."""
    if fetched is not None:
        obs, shape = places.coverage_gate(obs, fetched, days).drop("origin"), None
    shape = shape or measure(obs)
    enough = quality.min_rows_gate(obs, stage="train", shape=shape)
    good = quality.agg_quality(enough).filter("is_valid").select(STATION)
    return join_small(enough, good, [STATION], shape.series, "left_semi")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _coefficients(spark: SparkSession, models: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    rows = [(t, [float(x) for x in c], float(i)) for t, (c, i) in models.items()]
    return spark.createDataFrame(rows, "target string, coefficients array<double>, intercept double")


def _linear(table: DataFrame, targets: Sequence[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients by column and intercepts, one row per target; None without a model of every target."""
    rows = {r["target"]: r for r in table.collect()}
    if any(t not in rows for t in targets):
        return None
    return np.array([rows[t]["coefficients"] for t in targets]).T, np.array([rows[t]["intercept"] for t in targets])


def _predictors(tables: dict[str, DataFrame], cfg: FamilyConfig) -> dict[str, object]:
    """Functions from a feature matrix (``lstm``: from windows) to one column per target, of the pooled families."""
    out = {}
    if "random_forest" in cfg.families:
        grown = trees.forests(tables["forest"])
        if all(t in grown for t in cfg.targets):
            out["random_forest"] = lambda x: np.column_stack([grown[t].votes(x).mean(1) for t in cfg.targets])
    for name, table in (("lube", "lube"), ("lstm", "window")):
        fitted = _linear(tables[table], cfg.targets) if name in cfg.families else None
        if fitted is not None:
            out[name] = lambda x, c=fitted: x @ c[0] + c[1]
    return out


def _fuzzy_scored(rows: DataFrame, params: DataFrame, target: str, cfg: FuzzyConfig, shape: Shape) -> DataFrame:
    """The value that the row before leads to."""
    lagged = timeline.over_rows(rows.select(STATION, TS, "role", target).dropna(subset=[target]), lambda w: {"_before": F.lag(target, 1).over(w)}, back=1, shape=shape)
    j = join_small(lagged.filter("_before IS NOT NULL AND role = 'validation'"), params, [STATION], shape.series, "inner", per_row=64)
    found = F.get("map", fuzzy.best_set(F.col("_before"), cfg))["value"]
    return j.select(STATION, TS, F.lit("fuzzy").alias("model"), F.lit(target).alias("target"), F.col(target).alias("actual"), found.alias("prediction"))


def train(obs: DataFrame, cfg: FamilyConfig = FamilyConfig(), *, fetched: DataFrame | None = None, days: int = 30) -> dict[str, DataFrame]:
    """Tables of a trained ensemble: pipeline, fuzzy, arima, forest, window, lube, bounds, scores, weights, stations.

    Only stations that pass the gates are in them. Null measures are imputed and outliers clipped with parameters of the training
    part. A family that cannot be fitted (too few rows for its windows) has no rows in its table and no score.
    """
    spark = obs.sparkSession
    passed = stored(usable(obs, fetched=fetched, days=days), "train_obs")
    shape = measure(passed)
    roles = split.win_split_frac(passed, train=cfg.train, validation=1 - cfg.train, shape=shape)
    roles = roles.withColumn("role", F.when(F.col("role") == "train", "train").otherwise("validation"))
    early = roles.filter("role = 'train'").select(STATION, TS, *BASE)
    params = pipeline.fit_pipeline(early, shape=shape)
    rows = stored(pipeline.cleaned(roles.select(STATION, TS, "role", *BASE), params, shape=shape), "train_rows")
    fit_rows = rows.filter("role = 'train'").drop("role")
    tables, scored = {"pipeline": params}, []

    if "fuzzy" in cfg.families:
        parts = {t: stored(fuzzy.fz_fit(fit_rows, FuzzyConfig(target=t), shape=shape), "fuzzy") for t in cfg.targets}
        tables["fuzzy"] = _union([p.withColumn("target", F.lit(t)) for t, p in parts.items()])
        scored += [_fuzzy_scored(rows, p, t, FuzzyConfig(target=t), shape) for t, p in parts.items()]
    if "arima" in cfg.families:
        parts = {t: stored(series.mdl_ar(fit_rows, t, cfg.ar, shape=shape), "arima") for t in cfg.targets}
        tables["arima"] = _union(list(parts.values()))
        late = rows.filter("role = 'validation'").select(STATION, TS)
        for t, p in parts.items():
            one = series.ar_fitted(rows, p, t, cfg.ar, shape=shape).join(late, [STATION, TS], "left_semi")
            scored.append(one.select(STATION, TS, F.lit("arima").alias("model"), "target", "actual", "prediction"))
    pooled = {"random_forest", "lube"} & set(cfg.families)
    if pooled:
        made = recursive.with_features(rows, cfg.targets, shape=shape).join(rows.select(STATION, TS, "role"), [STATION, TS])
        featured = stored(made, "train_features")
        learn, judge = featured.filter("role = 'train'"), featured.filter("role = 'validation'")
        if "random_forest" in pooled:
            fitted = {} if learn.isEmpty() else mdl_forest(learn, cfg.targets, cfg.forest)
            tables["forest"] = stored(trees.node_table(fitted, spark), "forest") if fitted else spark.createDataFrame([], trees.NODES)
        if "lube" in pooled:
            tables["lube"] = _coefficients(spark, recursive.fit_ridge(learn, cfg.targets, reg=cfg.reg))
    if "lstm" in cfg.families:
        windows_fitted = windowed.fit_windows(fit_rows, cfg.length, cfg.targets, cfg.targets, reg=cfg.reg, shape=shape)
        tables["window"] = _coefficients(spark, windows_fitted)
    predict = _predictors(tables, cfg)
    scored += [recursive.scored(judge, m, predict[m], cfg.targets) for m in ("random_forest", "lube") if m in predict]
    if "lstm" in predict:
        windows = windowed.predicted(rows, windows_fitted, cfg.length, cfg.targets, keep=["role"], shape=shape)
        scored.append(windows.filter("role = 'validation'").withColumn("model", F.lit("lstm")))
    every = stored(_union([s.select(STATION, TS, "model", "target", "actual", "prediction") for s in scored]), "train_scored")
    m = metrics.agg_metrics(every.dropna(subset=["actual", "prediction"]), by=[STATION, "model", "target"])
    tables["scores"] = stored(m.withColumn("is_trained", F.col("n") > 0), "train_scores")
    per_model = tables["scores"].groupBy(STATION, "model").agg(F.avg("mae").alias("mae"), F.max("is_trained").alias("is_trained"))
    tables["weights"] = E.en_performance(per_model)
    bounds = [
        int_bounds_fit(every.filter((F.col("model") == "lube") & (F.col("target") == t)), alpha=cfg.alpha, shape=shape).withColumn("target", F.lit(t))
        for t in cfg.targets
    ]
    tables["bounds"] = _union(bounds)
    place = [F.min(c).alias(c) for c in ("latitude", "longitude") if c in passed.columns]
    tables["stations"] = passed.groupBy(STATION).agg(F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"), F.count(F.lit(1)).alias("rows"), *place)
    return tables


def registry(tables: dict[str, DataFrame], version: str, root: str, created_at, cfg: FamilyConfig) -> DataFrame:
    """One registry row per station and family that has scores, errors averaged over the targets."""
    score = tables["scores"].groupBy(STATION, F.col("model").alias("model_type")).agg(
        *[F.avg(c).alias(c) for c in ("mae", "rmse", "mape")], F.array_sort(F.collect_set("target")).alias("targets"), F.max("is_trained").alias("is_trained")
    )
    j = score.join(tables["stations"], STATION)
    for c in ("latitude", "longitude"):
        j = j if c in j.columns else j.withColumn(c, F.lit(None).cast("double"))
    at = F.lit(created_at).cast("timestamp")
    settings = {"length": cfg.length, "trees": cfg.forest.trees, "depth": cfg.forest.depth, "reg": cfg.reg, "lags": len(cfg.ar.lags), "train": cfg.train}
    return j.select(
        F.concat_ws("_", "model_type", STATION, F.lit(version)).alias("model_id"), "model_type", F.lit(version).alias("version"), STATION, "latitude", "longitude",
        at.alias("created_at"), at.alias("changed_at"), F.create_map(*[x for k, v in settings.items() for x in (F.lit(k), F.lit(str(v)))]).alias("hyperparameters"),
        F.array(*[F.lit(x) for x in recursive.names(cfg.targets)]).alias("features"), "targets", "mae", "rmse", "mape",
        F.lit(f"{root}/tables/{version}").alias("path"), F.col("rows").alias("training_rows"), F.lit(True).alias("is_active"), "is_trained",
    )


def save(tables: dict[str, DataFrame], root: str, version: str, created_at, cfg: FamilyConfig = FamilyConfig()) -> None:
    """All tables and the registry rows as one version."""
    spark = tables["scores"].sparkSession
    whole = {**tables, "registry": registry(tables, version, root, created_at, cfg)}
    commits.commit(spark, root, version, whole, created_at=created_at, metadata={"length": str(cfg.length), "targets": ",".join(cfg.targets), "families": ",".join(cfg.families)})


def load(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """Tables of a version, by default the newest."""
    version = version or commits.newest_version(spark, root)
    found = commits.versions(spark, root).filter(F.col("version") == version).first()
    if found is None:
        raise LookupError(f"no version {version or ''} under {root}")
    return {t: commits.read(spark, root, t, version) for t in found["tables"]}


def points(obs: DataFrame, tables: dict[str, DataFrame], hours: int, cfg: FamilyConfig = FamilyConfig()) -> DataFrame:
    """station, last_ts, step, target, model, prediction of every family, stepping on its own predictions.

    ``obs`` needs as many recent rows per station as the longest window; stations that were not trained have no rows.
    """
    shape = measure(obs)
    rows = stored(pipeline.cleaned(obs.select(STATION, TS, *BASE), tables["pipeline"], shape=shape), "recent_rows")
    out = []
    for t in cfg.targets:
        if "fuzzy" in cfg.families:
            own = tables["fuzzy"].filter(F.col("target") == t).drop("target")
            out.append(fuzzy.fz_multi_step(rows, hours, FuzzyConfig(target=t), params=own).select("*", F.lit(t).alias("target"), F.lit("fuzzy").alias("model")))
        if "arima" in cfg.families:
            out.append(series.mdl_multi_step(rows, tables["arima"], t, hours, cfg.ar).withColumn("model", F.lit("arima")))
    predict = _predictors(tables, cfg)
    models = {m: (recursive.DEPTH, lambda b, at, f=predict[m]: f(recursive.rebuilt(b, at))) for m in ("random_forest", "lube") if m in predict}
    if "lstm" in predict:
        models["lstm"] = (cfg.length, lambda b, at: predict["lstm"](b.reshape(len(b), -1)))
    if models:
        state = recursive.newest_rows(rows, max(need for need, _ in models.values()), cfg.targets)
        out.append(recursive.stepped(state, hours, models, cfg.targets))
    return _union([p.select(STATION, "last_ts", F.col("step").cast("int").alias("step"), "target", "model", "prediction") for p in out])


def forecast(obs: DataFrame, tables: dict[str, DataFrame], hours: int = 24, cfg: FamilyConfig = FamilyConfig()) -> DataFrame:
    """One row per station and hour: the targets, the first target's interval, confidence and contributions of the families."""
    first = tables["bounds"].filter(F.col("target") == cfg.targets[0]).drop("target")
    return combined(points(obs, tables, hours, cfg), tables["weights"], bounds=first, targets=cfg.targets)
