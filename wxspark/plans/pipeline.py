"""Feature pipeline: engineer, impute, clip, scale. Fitting yields one parameter row per station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import clean, features
from wxspark.operators.timeline import Shape, join_small, measure
from wxspark.schema import BASE, STATION, TS
from wxspark.session import stored

# Columns that never miss a value and so need no median.
COMPLETE = ["hour", "day_of_week", "day_of_year", "month", "season", "pressure_tendency"] + [
    f"{c}_{f}" for c in ("hour", "day_of_week", "month") for f in ("sin", "cos")
]


def fit_pipeline(
    wide: DataFrame, *, scaler: str = "standard", station=STATION, ts=TS, shape: Shape | None = None, store=stored
) -> DataFrame:
    """Medians, clip bounds of the base columns and scaler parameters from an engineered frame.

    Fitting is eager: the medians and bounds (one row per station) are written before the pass that needs them, so no
    aggregate is planned twice. Give a written table: each pass then reads only the columns it needs.
    """
    shape = shape or measure(wide, station)
    numeric = features.numeric_features(wide, exclude=[station, ts])
    gappy = [c for c in numeric if c not in COMPLETE]
    base = [c for c in BASE if c in wide.columns]
    medians = store(clean.fit_medians(wide, gappy, station=station, shape=shape))
    imputed = clean.cl_impute_median(wide.select(station, *base), columns=base, params=medians, station=station, shape=shape)
    bounds = clean.clip_bounds(imputed, base, station=station, shape=shape)
    params = store(medians.join(bounds, station))
    have = set(params.columns)
    cleaned = _project(wide, params, [station], {c: _cleaned_sql(c, have) for c in numeric}, station, shape)
    return store(params.join(clean.fit_scaler(cleaned, scaler, numeric, station=station, shape=shape), station))


def _cleaned_sql(c: str, params: set[str]) -> str:
    """SQL text of a column after imputing and clipping with whatever parameters it has. Text, because one call carries
    the expressions of a hundred columns to the engine."""
    x = f"coalesce(`{c}`, `{c}__q500`)" if f"{c}__q500" in params else f"`{c}`"
    return f"greatest(least({x}, `{c}__hi`), `{c}__lo`)" if f"{c}__lo" in params else x


def _project(wide, params, keep, columns: dict[str, str], station, shape) -> DataFrame:
    """``columns`` (name -> SQL text) over rows joined with their station's parameters; key columns are kept."""
    j = join_small(wide, params, [station], shape.series, "inner")
    return j.selectExpr(*[f"`{k}`" for k in keep], *[f"{sql} AS `{c}`" for c, sql in columns.items()])


def cleaned(rows: DataFrame, params: DataFrame, *, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """Impute and clip with fitted parameters, in physical units; all columns stay. Stations without parameters go."""
    shape = shape or measure(rows, station)
    have = set(params.columns)
    numeric = set(features.numeric_features(rows, exclude=[station, ts]))
    out = {c: _cleaned_sql(c, have) if c in numeric else f"`{c}`" for c in rows.columns if c not in (station, ts)}
    return _project(rows, params, [station, ts], out, station, shape)


def apply_pipeline(wide: DataFrame, params: DataFrame, *, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """Impute, clip and scale with fitted parameters, in one projection over one join."""
    shape = shape or measure(wide, station)
    have = set(params.columns)
    numeric = set(features.numeric_features(wide, exclude=[station, ts]))
    out = {
        c: f"({_cleaned_sql(c, have)} - `{c}__center`) / `{c}__scale`" if c in numeric else f"`{c}`"
        for c in wide.columns if c not in (station, ts)
    }
    return _project(wide, params, [station, ts], out, station, shape)


def pipe_train(
    wide_or_obs: DataFrame, *, engineered: bool = False, scaler: str = "standard", station=STATION, ts=TS, shape: Shape | None = None,
    store=stored, **options,
) -> tuple[DataFrame, DataFrame]:
    """(scaled features, parameters). ``store`` writes the engineered frame once for the passes that follow."""
    shape = shape or measure(wide_or_obs, station)
    wide = wide_or_obs if engineered else features.engineered(wide_or_obs, station=station, ts=ts, shape=shape, **options)
    wide = store(wide)
    params = fit_pipeline(wide, scaler=scaler, station=station, ts=ts, shape=shape, store=store)
    return apply_pipeline(wide, params, station=station, ts=ts, shape=shape), params


def pipe_predict(obs: DataFrame, params: DataFrame, *, station=STATION, ts=TS, shape: Shape | None = None, **options) -> DataFrame:
    """The same columns for new rows, with the training medians, bounds and scales."""
    shape = shape or measure(obs, station)
    wide = features.engineered(obs, station=station, ts=ts, shape=shape, **options)
    return apply_pipeline(wide, params, station=station, ts=ts, shape=shape)


def restore(points: DataFrame, params: DataFrame, columns: Sequence[str], *, station=STATION, rows: int | None = None) -> DataFrame:
    """Bring scaled forecasts back to physical units."""
    own = params.select(station, *[f"{c}__{e}" for c in columns for e in ("center", "scale")])
    return clean.apply_scaler(points, own, columns, station=station, rows=rows, inverse=True)
