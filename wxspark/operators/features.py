"""Row-window features and the feature pipeline steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wxspark.functions import weather as W
from wxspark.operators import timeline
from wxspark.operators.timeline import Shape
from wxspark.schema import BASE, STATION, TARGETS, TS

LAGS = [1, 3, 6, 12, 24]
WINDOWS = [3, 6, 12, 24]


def lag_columns(w: WindowSpec, columns: Sequence[str], lags: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag_{k}h": F.lag(c, k).over(w) for c in columns for k in lags}


def rolling_columns(w: WindowSpec, columns: Sequence[str], windows: Sequence[int]) -> dict[str, Column]:
    """Mean, sample standard deviation (null on one row), minimum and maximum of the last k rows."""
    out = {}
    for c in columns:
        for k in windows:
            f = w.rowsBetween(-(k - 1), 0)
            out[f"{c}_rolling_{k}h_mean"] = F.avg(c).over(f)
            out[f"{c}_rolling_{k}h_std"] = F.stddev_samp(c).over(f)
            out[f"{c}_rolling_{k}h_min"] = F.min(c).over(f)
            out[f"{c}_rolling_{k}h_max"] = F.max(c).over(f)
    return out


def tendency(w: WindowSpec) -> Column:
    return F.coalesce(F.col("pressure") - F.lag("pressure").over(w), F.lit(0.0))


def win_lag(df, *, station=STATION, ts=TS, columns=tuple(BASE), lags=tuple(LAGS), shape: Shape | None = None) -> DataFrame:
    return timeline.over_rows(
        df, lambda w: lag_columns(w, columns, lags), back=max(lags), station=station, ts=ts, shape=shape
    )


def win_rolling(
    df, *, station=STATION, ts=TS, columns=tuple(BASE), windows=tuple(WINDOWS), shape: Shape | None = None
) -> DataFrame:
    """All frames share one partitioning and one sort."""
    return timeline.over_rows(
        df, lambda w: rolling_columns(w, columns, windows), back=max(windows) - 1, station=station, ts=ts, shape=shape
    )


def win_diff(df, *, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    return timeline.over_rows(df, lambda w: {"pressure_tendency": tendency(w)}, back=1, station=station, ts=ts, shape=shape)


def time_features(df: DataFrame, *, ts: str = TS) -> DataFrame:
    return W.sc_cyclic(W.sc_time_parts(df, ts=ts), ts=ts)


def weather_features(df: DataFrame) -> DataFrame:
    """Needs ``pressure_tendency`` from the window step."""
    t, h, v = F.col("temperature"), F.col("humidity"), F.col("wind_speed")
    df = W.sc_precip_intensity(W.sc_ratio_norm(df))
    return df.withColumns(
        {"feels_like": W.feels_like(t, h, v), "dew_point": W.dew_point(t, h), "heat_index": W.heat_index(t, h), "wind_chill": W.wind_chill(t, v)}
    )


def engineered(
    df, *, station=STATION, ts=TS, columns=tuple(BASE), lags=tuple(LAGS), windows=tuple(WINDOWS), shape: Shape | None = None
) -> DataFrame:
    """Time, weather, lag and rolling columns with one window pass."""
    wide = timeline.over_rows(
        df,
        lambda w: {"pressure_tendency": tendency(w)} | lag_columns(w, columns, lags) | rolling_columns(w, columns, windows),
        back=max([*lags, *(k - 1 for k in windows), 1]),
        station=station,
        ts=ts,
        shape=shape,
    )
    return weather_features(time_features(wide, ts=ts))


def distinct_features(*groups: Sequence[str]) -> list[str]:
    """Feature names in first-seen order without repeats."""
    return list(dict.fromkeys(name for group in groups for name in group))


def numeric_features(df: DataFrame, *, exclude: Sequence[str] = ()) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [n for n, t in df.dtypes if (t in kinds or t.startswith("decimal")) and n not in set(exclude)]


def feature_target_split(
    df: DataFrame, *, targets: Sequence[str] = tuple(TARGETS), ts: str = TS, station: str = STATION
) -> tuple[list[str], list[str]]:
    """(features, targets): targets that are present, and every other column but the keys, in schema order."""
    present = [t for t in targets if t in df.columns]
    return [c for c in df.columns if c not in {*present, ts, station}], present


def align_features(df: DataFrame, features: Sequence[str], *, keep: Sequence[str] = (STATION, TS)) -> DataFrame:
    """Match by name: missing features become 0.0, extras are dropped."""
    have = set(df.columns)
    return df.select(
        *[c for c in keep if c in have],
        *[F.col(f).cast("double").alias(f) if f in have else F.lit(0.0).alias(f) for f in features],
    )


def val_input(df: DataFrame, features: Sequence[str], *, expected: int | None = None) -> None:
    """Raise if features are missing, the width differs, or the frame is empty (one row is looked at)."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    if expected is not None and len(features) != expected:
        raise ValueError(f"expected {expected} features, got {len(features)}")
    if df.select(*features[:1]).isEmpty():
        raise ValueError("no input rows")
