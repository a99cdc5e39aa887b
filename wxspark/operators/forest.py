"""Forests and window regressions on Spark ML, one model per target over all stations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import binned, split, timeline
from wxspark.operators.hashes import poisson_counts
from wxspark.operators.intervals import int_samples
from wxspark.operators.select import topk_importance
from wxspark.operators.timeline import Shape, measure
from wxspark.schema import STATION, TARGETS, TS
from wxspark.session import cut


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 100
    depth: int = 20
    min_leaf: int = 2
    subset: str = "sqrt"
    seed: int = 42
    horizon: int = 1


def training_frame(
    df, features: Sequence[str], targets: Sequence[str], cfg: ForestConfig = ForestConfig(), *, station=STATION, ts=TS,
    shape: Shape | None = None,
) -> DataFrame:
    """Assembled ``features`` and ``label_{target}``: the target ``horizon`` rows later (0: the same row)."""
    labelled = timeline.over_rows(
        df, lambda w: {f"label_{t}": F.lead(t, cfg.horizon).over(w) if cfg.horizon else F.col(t) for t in targets},
        ahead=max(cfg.horizon, 1), station=station, ts=ts, shape=shape,
    )
    full = labelled.dropna(subset=[*features, *[f"label_{t}" for t in targets]])
    asm = VectorAssembler(inputCols=list(features), outputCol="features")
    return asm.transform(full).select(station, ts, "features", *[f"label_{t}" for t in targets])


def _forest(cfg: ForestConfig, label: str) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=cfg.trees, maxDepth=cfg.depth, minInstancesPerNode=cfg.min_leaf,
        featureSubsetStrategy=cfg.subset, seed=cfg.seed, cacheNodeIds=True, maxMemoryInMB=1024,
    )


def mdl_forest(train: DataFrame, targets: Sequence[str] = tuple(TARGETS), cfg: ForestConfig = ForestConfig()) -> dict:
    """A forest per target. Every level of all trees is a pass over the rows, so they are spread over all cores first."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    if train.rdd.getNumPartitions() < cores:
        train = train.repartition(cores)
    return {t: _forest(cfg, f"label_{t}").fit(train) for t in targets}


def predict_long(models: dict, rows: DataFrame, *, station=STATION, ts=TS) -> DataFrame:
    """station, ts, target, prediction; every row is scored once per target and nothing is shuffled."""
    scored = rows
    for t, m in models.items():
        scored = m.copy({m.predictionCol: f"pred_{t}"}).transform(scored)
    out = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"pred_{t}").alias("prediction")) for t in models])
    return scored.select(station, ts, F.inline(out))


def agg_importance(models: dict, features: Sequence[str], spark) -> DataFrame:
    """Mean importance over the forests of all targets, in falling order; as many rows as features."""
    rows = [(f, float(v)) for m in models.values() for f, v in zip(features, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(
        F.avg("importance").alias("importance")
    ).orderBy(F.desc("importance"), "feature")


def sel_forest(train: DataFrame, features: Sequence[str], target: str, cfg: ForestConfig = ForestConfig(trees=50)) -> DataFrame:
    """Features that a small forest on the first target finds important."""
    model = _forest(cfg, f"label_{target}").fit(train)
    return topk_importance(agg_importance({target: model}, features, train.sparkSession))


def int_tree_spread(models: dict, rows: DataFrame, *, station=STATION, ts=TS) -> DataFrame:
    """Mean of the trees and +- 1.96 population deviations, per target. Meant for at most about 50 trees."""
    out = None
    for t, m in models.items():
        scored = rows.select(station, ts, "features")
        names = []
        for i, tree in enumerate(m.trees):
            names.append(f"_t{i}")
            scored = tree.copy({tree.predictionCol: names[-1]}).transform(scored)
        part = int_samples(scored.select(station, ts, F.lit(t).alias("target"), F.array(*names).alias("samples"))).drop("samples")
        out = part if out is None else out.unionByName(part)
    return out


# The whole search space; callers narrow it.
GRID = {"trees": [50, 100, 200], "depth": [10, 20, 30], "min_leaf": [1, 2, 4], "subset": ["sqrt", "log2", "all"]}


def mdl_forest_tune(
    train: DataFrame, target: str, grid: dict[str, list] | None = None, *, n_splits: int = 3, newest: int | None = None,
    station=STATION, ts=TS, shape: Shape | None = None,
) -> DataFrame:
    """Mean squared error of each grid point over expanding folds, best first. All rows take part; ``newest`` limits
    the search to the last rows of each series where a caller wants that. All points and folds grow together from one
    binned table, see ``binned``."""
    if newest is not None:
        train = split.win_history_bound(train, keys=[station], ts=ts, keep=newest)
    cfg = ForestConfig()
    defaults = {"trees": cfg.trees, "depth": cfg.depth, "min_leaf": cfg.min_leaf, "subset": cfg.subset}
    return binned.search(
        train, target, GRID if grid is None else grid, defaults, n_splits=n_splits, seed=cfg.seed, station=station, ts=ts, shape=shape,
    )


# ---- window regression --------------------------------------------------------------------------------------------


def window_frame(df, *, length: int = 24, features=tuple(TARGETS), targets=tuple(TARGETS), station=STATION, ts=TS, shape=None) -> DataFrame:
    """One vector per run of rows, with the targets of the next row as labels."""
    full = df.dropna(subset=list(dict.fromkeys([*features, *targets])))
    seq = split.win_sequences(full, length=length, features=features, targets=targets, station=station, ts=ts, shape=shape)
    return seq.select(
        station, ts, "window", array_to_vector(F.flatten("window")).alias("features"),
        *[F.col(f"next_{t}").alias(f"label_{t}") for t in targets],
    )


def mdl_window_reg(train: DataFrame, targets: Sequence[str] = tuple(TARGETS), *, reg: float = 0.1, weight: str | None = None) -> dict:
    """Ridge regression of the next values on the last window."""
    models = {}
    for t in targets:
        lr = LinearRegression(featuresCol="features", labelCol=f"label_{t}", regParam=reg, solver="normal")
        models[t] = (lr.setWeightCol(weight) if weight else lr).fit(train)
    return models


def multi_step(
    models: dict, last: DataFrame, steps: int, *, features: Sequence[str] = tuple(TARGETS), every: int = 8, station=STATION, ts=TS
) -> DataFrame:
    """Recursive forecast from the newest window of each station: predict, append, shift. The frame has one row per
    station; its lineage is cut every few steps."""
    state = last.select(station, ts, "window")
    done = None
    for step in range(1, steps + 1):
        scored = state.withColumn("features", array_to_vector(F.flatten("window")))
        for t, m in models.items():
            scored = m.copy({m.predictionCol: f"pred_{t}"}).transform(scored)
        nxt = F.array(*[F.col(f"pred_{f}") if f in models else F.element_at("window", -1)[i] for i, f in enumerate(features)])
        keep = [c for c in state.columns if c.startswith("out_")]
        row = F.struct(*[F.col(f"pred_{t}").alias(t) for t in models]).alias(f"out_{step}")
        state = scored.select(
            station, ts, F.concat(F.slice("window", F.lit(2), F.size("window") - 1), F.array(nxt)).alias("window"), *keep, row
        )
        if step % every == 0 and step < steps:
            state = cut(state)
    outs = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"out_{s}").alias("p")) for s in range(1, steps + 1)])
    done = state.select(station, F.col(ts).alias("last_ts"), F.inline(outs))
    return done.select(station, "last_ts", "step", *[F.col(f"p.{t}").alias(t) for t in models])


def ridge(moments, reg: float):
    """Coefficients and intercept from the weighted sums of products of (features, label, 1); both sides are standardised
    for the penalty, as in mdl_window_reg. Constant features get 0."""
    n, mean = moments[-1, -1], moments[-1, :-1] / moments[-1, -1]
    cov = moments[:-1, :-1] / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    dev[dev <= 1e-9 * np.maximum(1, np.abs(mean))] = 0
    used = np.flatnonzero(dev[:-1])
    out = np.zeros(len(mean) - 1)
    if dev[-1] and len(used):
        scale = dev[used]
        a = cov[np.ix_(used, used)] / np.outer(scale, scale) + reg / dev[-1] * np.eye(len(used))
        out[used] = np.linalg.solve(a, cov[used, -1] / (scale * dev[-1])) * dev[-1] / scale
    return out, mean[-1] - out @ mean[:-1]


def int_replicas(
    train: DataFrame, rows: DataFrame, target: str, *, replicas: int = 50, reg: float = 0.1, station=STATION, ts=TS
) -> DataFrame:
    """Interval from seeded bootstrap refits: each replica weights the rows by its own Poisson counts.

    All replicas come from one pass over ``train``: a task adds up the weighted products of its rows for every replica (replicas
    x features^2 numbers, bounded by the two), the sums of each replica meet in one row, and ``rows`` are scored in place.
    Products are taken around the mean of a few rows, so values far from zero lose no digits.
    """
    label = f"label_{target}"
    few = train.select(vector_to_array("features").alias("x"), label).dropna().limit(64).collect()
    if not few:
        return rows.select(station, ts, *[F.lit(None).cast("double").alias(c) for c in ("prediction", "lower", "upper")])
    shift = np.mean([[*r["x"], r[label]] for r in few], axis=0)

    def add_up(frames):
        sums = None
        for f in frames:
            x = np.column_stack([np.array(f["x"].tolist()), f["y"].to_numpy()]) - shift
            x = np.column_stack([x, np.ones(len(x))])
            w = poisson_counts(f["k"].to_numpy(), replicas)
            part = np.stack([(x * w[:, i : i + 1]).T @ x for i in range(replicas)])
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pd.DataFrame({"replica": range(replicas), "m": [s.ravel().tolist() for s in sums]})

    def fit(key, f):
        size = len(shift) + 1
        coefs, at = ridge(np.sum([np.array(m) for m in f["m"]], axis=0).reshape(size, size), reg)
        return pd.DataFrame({"replica": [key[0]], "c": [[*coefs.tolist(), float(at)]]})

    given = train.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(station, ts).alias("k"))
    sums = given.dropna().mapInPandas(add_up, "replica int, m array<double>")
    fitted = sums.groupBy("replica").applyInPandas(fit, "replica int, c array<double>").orderBy("replica").collect()  # one row per replica
    c = np.array([r["c"] for r in fitted])

    @F.pandas_udf("array<double>")
    def votes(x: pd.Series) -> pd.Series:
        p = (np.array(x.tolist()).reshape(len(x), -1) - shift[:-1]) @ c[:, :-1].T + c[:, -1] + shift[-1]
        return pd.Series(p.tolist())

    return int_samples(rows.select(station, ts, votes(vector_to_array("features")).alias("samples"))).drop("samples")


def recent_windows(df, *, length: int = 24, features=tuple(TARGETS), station=STATION, ts=TS, shape=None) -> DataFrame:
    """The newest full window of each station with its vector."""
    full = df.dropna(subset=list(features))
    last = split.win_sequences_predict(full, length=length, features=features, last_only=True, station=station, ts=ts, shape=shape)
    return last.withColumn("features", array_to_vector(F.flatten("window")))
