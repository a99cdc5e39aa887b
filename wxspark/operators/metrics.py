"""Forecast evaluation as one-pass grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
EPS = 2.220446049250313e-16
BY = ("station",)


def _real(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x)


def _pairs(truth: str, pred: str) -> tuple[Column, Column, Column]:
    """(usable, truth, error) with unusable rows as null, so a group without pairs stays in the result."""
    ok = _real(truth) & _real(pred)
    return ok, F.when(ok, F.col(truth)), F.when(ok, F.col(pred) - F.col(truth))


def _basic(truth: str, pred: str) -> list[Column]:
    ok, y, e = _pairs(truth, pred)
    or_inf = lambda c: F.coalesce(c, F.lit(INF))
    return [
        F.count(e).alias("n"),
        or_inf(F.avg(F.abs(e))).alias("mae"),
        or_inf(F.sqrt(F.avg(e * e))).alias("rmse"),
        or_inf(F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))) * 100).alias("mape"),
    ]


def agg_metrics(df, *, by: Sequence[str] = BY, truth: str = "actual", pred: str = "prediction") -> DataFrame:
    """n, mae, rmse, mape over the usable pairs; infinite where there is none."""
    return df.groupBy(*by).agg(*_basic(truth, pred))


def agg_metrics_detailed(df, *, by: Sequence[str] = BY, truth: str = "actual", pred: str = "prediction") -> DataFrame:
    """Adds r2, mean_error and std_error. A constant truth scores 1 when matched exactly, else 0."""
    _, y, e = _pairs(truth, pred)
    out = df.groupBy(*by).agg(
        *_basic(truth, pred),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.avg(e).alias("mean_error"),
        F.stddev_pop(e).alias("std_error"),
    )
    r2 = (
        F.when(F.col("n") == 0, F.lit(-INF))
        .when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - F.try_divide(F.col("_sse"), F.col("_sst")))
    )
    none = {c: F.coalesce(F.col(c), F.lit(INF)) for c in ("mean_error", "std_error")}
    return out.withColumns({"r2": r2} | none).drop("_sse", "_sst")


def _width(truth: str, lower: str, upper: str) -> Column:
    mean_width, span = F.avg(F.col(upper) - F.col(lower)), F.max(truth) - F.min(truth)
    return F.coalesce(F.try_divide(mean_width, F.nullif(span, F.lit(0.0))), mean_width)


def _covered(truth: str, lower: str, upper: str) -> Column:
    return F.avg(F.col(truth).between(F.col(lower), F.col(upper)).cast("double"))


def agg_coverage(
    df, *, by: Sequence[str] = BY, truth: str = "actual", lower: str = "lower", upper: str = "upper"
) -> DataFrame:
    """Share of truths inside the interval (ends included), mean width and width relative to the range of the truth."""
    return df.groupBy(*by).agg(
        _covered(truth, lower, upper).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"),
        _width(truth, lower, upper).alias("normalized_width"),
    )


def agg_interval_loss(
    df, *, by: Sequence[str] = BY, truth="actual", pred="prediction", lower="lower", upper="upper",
    level: float = 0.95, weight_coverage: float = 50.0, weight_width: float = 1.0,
) -> DataFrame:
    """Squared error plus a penalty for coverage below ``level`` plus normalised width."""
    short = F.greatest(F.lit(0.0), F.lit(level) - _covered(truth, lower, upper))
    loss = (
        F.avg((F.col(pred) - F.col(truth)) * (F.col(pred) - F.col(truth)))
        + weight_coverage * short * short
        + weight_width * _width(truth, lower, upper)
    )
    return df.groupBy(*by).agg(loss.alias("interval_loss"))


def agg_metric_mean(metrics, *, by: Sequence[str] = ("station", "model"), names=("mae", "rmse", "mape")) -> DataFrame:
    """Mean of the per-target metrics."""
    return metrics.groupBy(*by).agg(*[F.avg(m).alias(m) for m in names])


def agg_cv_summary(folds, *, by: Sequence[str] = BY, names=("mae", "rmse", "mape")) -> DataFrame:
    """Mean and population deviation of each fold metric; no finite fold gives infinite mean and zero deviation."""
    out = []
    for m in names:
        x = F.when(F.col(m) < INF, F.col(m))
        out += [
            F.coalesce(F.avg(x), F.lit(INF)).alias(f"{m}_mean"),
            F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias(f"{m}_std"),
        ]
    return folds.groupBy(*by).agg(*out)
