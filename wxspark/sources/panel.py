"""Hourly station panel from a raw event stream table.

One row per (station, hour). Sums stay integral until the last division, so the result does not depend on the order in
which partial aggregates meet. A station with a third of all events is combined on the map side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.session import stored


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/events.parquet")


def hour_sums(events: DataFrame, hour: Column | None = None) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz") if hour is None else hour
    return events.groupBy(F.col("event_type").alias("station"), hour.alias("ts")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
        F.sum("user_id").alias("u"),
        F.sum("event_id").alias("e"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"),
    )


def to_observations(sums: DataFrame, *extra: str) -> DataFrame:
    n, u, e, k = (F.col(c) for c in ("n", "u", "e", "k"))
    return sums.select(
        "station",
        "ts",
        (F.col("cents").cast("double") / (100 * n) * 0.5 - 5).alias("temperature"),
        (k.cast("double") / n).alias("humidity"),
        (990 + (u % 50).cast("double")).alias("pressure"),
        ((e % 200).cast("double") / 10).alias("wind_speed"),
        (e % 361).cast("double").alias("wind_direction"),
        (u % 101).cast("double").alias("cloud_cover"),
        F.when(n % 4 == 0, (k % 60).cast("double")).otherwise(F.lit(0.0)).alias("precipitation"),
        *extra,
    )


def panel(spark: SparkSession, path: str) -> DataFrame:
    """station, ts and the seven measures."""
    return to_observations(hour_sums(read_events(spark, path)))


def panel_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The panel with some temperatures missing, for operators that treat nulls."""
    full = to_observations(hour_sums(read_events(spark, path)), "n", "e")
    blank = (F.col("n") == 1) & (F.col("e") % 7 == 0)
    return full.withColumn("temperature", F.when(~blank, F.col("temperature"))).drop("n", "e")


def located(obs: DataFrame) -> DataFrame:
    """Give every station a fixed place, derived from its name."""
    code = F.ascii("station")
    return obs.withColumns(
        {
            "latitude": 8 + (code * 37 % 280) / F.lit(10.0),
            "longitude": 68 + (code * 53 % 270) / F.lit(10.0),
        }
    )


def customer_points(spark: SparkSession, path: str) -> DataFrame:
    """Request points: one per customer row."""
    c = F.col("c_custkey")
    return spark.read.parquet(f"{path.rstrip('/')}/customer.parquet").select(
        c.alias("id"),
        (8 + (c % 2800) / F.lit(100.0)).alias("lat"),
        (68 + (c * 7 % 2700) / F.lit(100.0)).alias("lon"),
    )


def panel_table(spark: SparkSession, path: str) -> DataFrame:
    """The panel as a written table, for operators that pass over it more than once: one scan of the raw events."""
    return stored(panel(spark, path), "panel")


def forecast_log(obs: DataFrame, *, target: str = "temperature", shape: timeline.Shape | None = None) -> DataFrame:
    """A log of three simple forecasters: station, ts, target, actual, model, prediction (null while too young)."""

    def cols(w):
        last6 = w.rowsBetween(-6, -1)
        return {
            "persist": F.lag(target, 1).over(w),
            "daily": F.lag(target, 24).over(w),
            "mean6": F.when(F.count(target).over(last6) == 6, F.avg(target).over(last6)),
        }

    wide = timeline.over_rows(obs.select("station", "ts", target), cols, back=24, shape=shape)
    long = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in ("persist", "daily", "mean6")]
    )
    return wide.select("station", "ts", F.lit(target).alias("target"), F.col(target).alias("actual"), F.inline(long))
