"""Recursive features: what a model needs to step from its own predictions.

Lags, rolling statistics and time parts of a row, from the rows before it alone. Two ways build the same numbers: window
functions over whole series for training and scoring, and arrays over a ring buffer of the newest rows of each station, which a
forecast shifts by one prediction per step. Stations are rows of a batch, so a step is a few array operations for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.forest import ridge
from wxspark.operators.timeline import Shape, measure
from wxspark.schema import STATION, TARGETS, TS

LAGS, SPANS, DEPTH = (1, 2, 3, 6, 12, 24), (3, 6, 12, 24), 24


def names(targets: Sequence[str] = tuple(TARGETS)) -> list[str]:
    out = []
    for t in targets:
        out += [f"{t}_lag{k}" for k in LAGS] + [f"{t}_change"]
        out += [f"{t}_{kind}{w}" for w in SPANS for kind in ("mean", "dev")]
    return [*out, "hour_sin", "hour_cos", "year_sin", "year_cos"]


def _time_parts(hour: Column, day: Column) -> dict[str, Column]:
    h, y = hour * (2 * np.pi / 24), day * (2 * np.pi / 365.25)
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "year_sin": F.sin(y), "year_cos": F.cos(y)}


def with_features(df: DataFrame, targets: Sequence[str] = tuple(TARGETS), *, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """station, ts, targets and ``features`` for every row with DEPTH rows before it; rows with a null target are not counted."""
    full = df.select(station, ts, *[F.col(t).cast("double").alias(t) for t in targets]).dropna(subset=list(targets))

    def cols(w) -> dict[str, Column]:
        out = {}
        for t in targets:
            out |= {f"{t}_lag{k}": F.lag(t, k).over(w) for k in LAGS}
            out[f"{t}_change"] = F.lag(t, 1).over(w) - F.lag(t, 2).over(w)
            for n in SPANS:
                run = w.rowsBetween(-n, -1)
                out |= {f"{t}_mean{n}": F.avg(t).over(run), f"{t}_dev{n}": F.stddev_pop(t).over(run)}
        out["_deep"] = F.lag(F.lit(1), DEPTH).over(w)
        return out

    wide = timeline.over_rows(full, cols, back=DEPTH, station=station, ts=ts, shape=shape).filter(F.col("_deep").isNotNull())
    wide = wide.withColumns(_time_parts(F.hour(ts), F.dayofyear(ts)))
    made = VectorAssembler(inputCols=names(targets), outputCol="features").transform(wide)
    return made.select(station, ts, "features", *targets, *[F.col(t).alias(f"label_{t}") for t in targets])


def rebuilt(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same features from ``buffer`` (stations, DEPTH rows with the newest last, targets) for the rows at times ``at``."""
    out = []
    for t in range(buffer.shape[2]):
        v = buffer[:, :, t]
        out += [v[:, -k] for k in LAGS] + [v[:, -1] - v[:, -2]]
        for n in SPANS:
            out += [v[:, -n:].mean(1), v[:, -n:].std(1)]
    hours = at.astype("datetime64[h]")
    days = hours.astype("datetime64[D]")
    h = (hours - days).astype(float) * (2 * np.pi / 24)
    y = ((days - days.astype("datetime64[Y]")).astype(float) + 1) * (2 * np.pi / 365.25)
    return np.column_stack([*out, np.sin(h), np.cos(h), np.sin(y), np.cos(y)])


def newest_rows(df: DataFrame, depth: int, targets: Sequence[str] = tuple(TARGETS), *, station=STATION, ts=TS) -> DataFrame:
    """station, last_ts and ``rows``: the newest ``depth`` complete rows of each station, oldest first."""
    full = df.select(station, ts, *targets).dropna(subset=list(targets))
    recent = timeline.newest(full, depth, keys=[station], ts=ts)
    row = F.struct(F.col(ts).alias("t"), F.array(*[F.col(t).cast("double") for t in targets]).alias("v"))
    return recent.groupBy(station).agg(F.max(ts).alias("last_ts"), F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias("rows"))


def fit_ridge(train: DataFrame, targets: Sequence[str] = tuple(TARGETS), *, reg: float = 0.1) -> dict[str, tuple[np.ndarray, float]]:
    """Per target (coefficients, intercept) over all stations, all targets from one pass of moments.

    A task adds up the products of its rows; the matrices, whose size follows from the number of features, are added up by place.
    """
    labels = [f"label_{t}" for t in targets]
    rows = train.select(vector_to_array("features").alias("x"), *labels).dropna()
    size = len(names(targets)) + len(labels)
    both = F.concat("x", F.array(*labels))
    centre = rows.select(F.posexplode(both).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()  # one row per feature
    if not centre:
        return {}
    shift = np.array([r["m"] for r in centre])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            x = np.column_stack([np.array(b["x"].tolist()).reshape(len(b), size) - shift, np.ones(len(b))])
            total += x.T @ x
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    parts = rows.select(both.alias("x")).mapInPandas(add_up, "m array<double>")
    sums = parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # the moment matrix
    m = np.array([r["v"] for r in sums]).reshape(size + 1, size + 1)
    used, out = size - len(labels), {}
    for i, t in enumerate(targets):
        at = [*range(used), used + i, size]
        coefs, intercept = ridge(m[np.ix_(at, at)], reg)
        out[t] = (coefs, float(intercept + shift[used + i] - coefs @ shift[:used]))
    return out


def scored(rows: DataFrame, model: str, predict, targets: Sequence[str] = tuple(TARGETS), *, station=STATION, ts=TS) -> DataFrame:
    """station, ts, target, model, actual, prediction of every feature row; ``predict`` maps a matrix to one column per target."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(predict(np.array(x.tolist(), float).reshape(len(x), -1)).tolist()))

    both = rows.withColumn("_p", run(vector_to_array("features")))
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("actual"), F.col("_p")[i].alias("prediction")) for i, t in enumerate(targets)])
    return both.select(station, ts, F.lit(model).alias("model"), F.inline(each))


def stepped(state: DataFrame, steps: int, models: dict, targets: Sequence[str] = tuple(TARGETS), *, station=STATION) -> DataFrame:
    """station, last_ts, step, target, model, prediction: every model steps from the newest rows on its own predictions.

    ``state`` is what ``newest_rows`` gives. ``models`` maps a name to (rows needed, function): the function gets (buffer, times of the next rows)
    of all stations of a batch and gives one column per target. A station with fewer rows than a model needs has no prediction of it.
    """
    n = len(targets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            depth = b["rows"].map(len).to_numpy()
            last = b["last_ts"].to_numpy().astype("datetime64[us]")
            for name, (need, predict) in models.items():
                at = np.flatnonzero(depth >= need)
                if not len(at):
                    continue
                buffer = np.array([np.vstack(b["rows"].iloc[i])[-need:] for i in at]).reshape(len(at), need, n)
                for step in range(1, steps + 1):
                    nxt = predict(buffer, last[at] + np.timedelta64(step, "h"))
                    buffer = np.concatenate([buffer[:, 1:], nxt[:, None, :]], 1)
                    yield pd.DataFrame({
                        station: np.repeat(b[station].to_numpy()[at], n), "last_ts": np.repeat(b["last_ts"].to_numpy()[at], n), "step": step,
                        "target": list(targets) * len(at), "model": name, "prediction": nxt.ravel(),
                    })

    kinds = dict(state.dtypes)
    return state.mapInPandas(run, f"{station} {kinds[station]}, last_ts {kinds['last_ts']}, step int, target string, model string, prediction double")
