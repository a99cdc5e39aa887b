"""Row layouts shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

STATION, TS = "station", "ts"
BASE = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction", "cloud_cover", "precipitation"]
TARGETS = ["temperature", "humidity", "pressure", "wind_speed"]
# Fixed value: what a forecast reports for a target without a prediction.
TARGET_DEFAULTS = {"temperature": 20.0, "humidity": 50.0, "pressure": 1013.25, "wind_speed": 5.0}
MODEL_TYPES = ["lstm", "arima", "random_forest", "fuzzy", "lube", "ensemble"]

LOCATION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
    ]
)

# A nested observation, the shape the providers and the API edge use.
OBSERVATION = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in BASE]
    + [T.StructField("location", LOCATION)]
)

# A flat observation, the shape the stores use.
FLAT = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("location_name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in BASE]
    + [T.StructField("data_source", T.StringType())]
)
