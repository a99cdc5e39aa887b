"""Tables behind the dashboard: chart series, first hours, health and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wxspark.schema import STATION, TS

# Parameter, source column, factor, unit, axis minimum, axis maximum.
CHART_PARAMETERS = [
    ("temperature", "temperature", 1.0, "°C", None, None),
    ("humidity", "humidity", 1.0, "%", 0.0, 100.0),
    ("pressure", "pressure", 1.0, "hPa", None, None),
    ("windSpeed", "wind_speed", 3.6, "km/h", 0.0, None),
    ("cloudCover", "cloud_cover", 1.0, "%", 0.0, 100.0),
    ("precipitation", "precipitation", 1.0, "mm", 0.0, None),
]


def sc_chart_series(df, *, parameters=None, station=STATION, ts=TS, lower="lower", upper="upper") -> DataFrame:
    """Long table: one row per time and parameter with value, unit, interval and axis limits."""
    bound = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(name).alias("parameter"), (F.col(col) * factor).alias("value"), F.lit(unit).alias("unit"),
            bound(lower).alias("lower"), bound(upper).alias("upper"),
            F.lit(lo).cast("double").alias("axis_min"), F.lit(hi).cast("double").alias("axis_max"),
        )
        for name, col, factor, unit, lo, hi in CHART_PARAMETERS
        if col in df.columns and (parameters is None or name in parameters)
    ]
    return df.select(station, ts, F.inline(F.array(*rows)))


def limit_first_hours(df, *, station=STATION, ts=TS, hours: int = 24) -> DataFrame:
    """First points of each series with the labels Now, +1h, ... The rank limit is applied before the shuffle."""
    ranked = df.withColumn("position", F.row_number().over(Window.partitionBy(station).orderBy(ts)))
    top = ranked.filter(F.col("position") <= hours)
    label = F.when(F.col("position") == 1, "Now").otherwise(F.concat(F.lit("+"), (F.col("position") - 1).cast("string"), F.lit("h")))
    return top.withColumn("label", label)


def agg_system_health(models: DataFrame, *, by=(STATION,)) -> DataFrame:
    """healthy with at least half of the models trained, degraded below, failed without any."""
    g = models.groupBy(*by).agg(F.count_if("is_trained").alias("healthy_models"), F.count(F.lit(1)).alias("total_models"))
    state = (
        F.when(F.col("healthy_models") == 0, "failed")
        .when(F.col("healthy_models") < F.col("total_models") * 0.5, "degraded")
        .otherwise("healthy")
    )
    return g.withColumn("system_health", state)


def agg_model_performance(requests: DataFrame, metrics: DataFrame, weights: DataFrame, *, station=STATION) -> DataFrame:
    """One row per requested model (station, model): metrics and weight; the ensemble row carries all weights and the
    number of scored points; a model without metrics gets a message."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "weight"))))
    all_weights = weights.groupBy(station).agg(pairs.alias("model_weights"))
    j = requests.join(metrics, [station, "model"], "left").join(weights, [station, "model"], "left")
    j = j.join(all_weights, station, "left")
    missing = F.col("mae").isNull()
    ens = F.col("model") == "ensemble"
    return j.withColumns(
        {
            "weight": F.when(~ens & ~missing, F.coalesce("weight", F.lit(0.0))),
            "model_weights": F.when(ens, F.col("model_weights")),
            "message": F.when(missing, "Model not available or not trained"),
        }
    )
