"""Prediction intervals from samples and from out-of-sample residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.operators.clean import station_quantiles
from wxspark.operators.timeline import Shape, join_small, measure
from wxspark.schema import STATION, TS

Z95 = 1.96


def array_mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def array_spread(a: Column) -> Column:
    """Population standard deviation of an array."""
    m = array_mean(a)
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(a)))


def int_samples(df, *, samples: str = "samples", z: float = Z95) -> DataFrame:
    """prediction, lower, upper from an array of sampled predictions: mean and mean +- z population deviations."""
    return (
        df.withColumn("_m", array_mean(F.col(samples)))
        .withColumn("_s", array_spread(F.col(samples)))
        .withColumns({"prediction": F.col("_m"), "lower": F.col("_m") - z * F.col("_s"), "upper": F.col("_m") + z * F.col("_s")})
        .drop("_m", "_s")
    )


def int_samples_grouped(df, *, by: Sequence[str], value: str = "prediction", z: float = Z95) -> DataFrame:
    """The same for samples held as rows."""
    m, s = F.avg(value), F.stddev_pop(value)
    return df.groupBy(*by).agg(m.alias("prediction"), (m - z * s).alias("lower"), (m + z * s).alias("upper"))


def int_bounds_fit(
    scored, *, by: str = STATION, alpha: float = 0.05, truth="actual", pred="prediction", shape: Shape | None = None
) -> DataFrame:
    """Residual quantiles alpha/2 and 1 - alpha/2 per series: by, res_lo, res_hi."""
    r = scored.select(by, (F.col(truth) - F.col(pred)).alias("r")).dropna(subset=["r"])
    lo, hi = alpha / 2, 1 - alpha / 2
    q = station_quantiles(r, ["r"], [lo, hi], station=by, shape=shape)
    names = [c for c in q.columns if c != by]
    return q.select(by, F.col(names[0]).alias("res_lo"), F.col(names[1]).alias("res_hi"))


def int_bounds(points, bounds, *, by: str = STATION, pred="prediction", shape: Shape | None = None) -> DataFrame:
    """lower <= prediction <= upper, from the residual quantiles of the series."""
    shape = shape or measure(points, by)
    j = join_small(points, bounds, [by], shape.series)
    p = F.col(pred)
    return j.withColumns(
        {"lower": F.least(p, p + F.col("res_lo")), "upper": F.greatest(p, p + F.col("res_hi"))}
    ).drop("res_lo", "res_hi")
