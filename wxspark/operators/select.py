"""Feature ranking and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wxspark.schema import STATION, TS


def _ranked(scores: DataFrame, station: str) -> DataFrame:
    """Scores of one series are as many as its features, so the window partitions are small. Scores that agree to six
    digits are ties, decided by name."""
    w = Window.partitionBy(station).orderBy(F.desc(F.round("score", 6)), "feature")
    return scores.withColumn("rank", F.row_number().over(w))


def agg_corr_rank(df, features: Sequence[str], target: str, *, station=STATION, ts=TS) -> DataFrame:
    """Absolute Pearson correlation with the target, all features in one aggregate; undefined counts as 0."""
    y = F.col(target)

    def corr(c: str):
        a, b = F.when(y.isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), y)
        r = F.try_divide(F.covar_pop(a, b), F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0)))
        return F.coalesce(F.nanvl(F.abs(r), F.lit(0.0)), F.lit(0.0))

    rows = df.groupBy(station).agg(
        F.array(*[F.struct(F.lit(c).alias("feature"), corr(c).alias("score")) for c in features]).alias("s")
    )
    return _ranked(rows.select(station, F.inline("s")), station)


def agg_variance_rank(df, features: Sequence[str], *, station=STATION, ts=TS) -> DataFrame:
    rows = df.groupBy(station).agg(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.var_pop(c).alias("score")) for c in features]).alias("s")
    )
    return _ranked(rows.select(station, F.inline("s")), station)


def topk_features(ranked: DataFrame, *, k: int = 10) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


def topk_importance(
    scores: DataFrame, *, keys: Sequence[str] = (), threshold: float = 0.001, most: int = 50, least: int = 5, fallback: int = 10
) -> DataFrame:
    """Features above the threshold; the best ``most`` when there are too many, the best ``fallback`` when too few."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    above = F.col("importance") > threshold
    marked = scores.withColumns(
        {
            "rank": F.row_number().over(w.orderBy(F.desc("importance"), "feature")),
            "_above": F.count_if(above).over(w),
        }
    )
    keep = F.when(F.col("_above") < least, F.col("rank") <= fallback).otherwise(above & (F.col("rank") <= most))
    return marked.filter(keep).drop("_above")
