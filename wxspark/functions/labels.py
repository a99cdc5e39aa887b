"""Texts and bands that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles of the known models.
MODEL_TITLES = {
    "lstm": "LSTM",
    "arima": "ARIMA",
    "random_forest": "Random Forest",
    "fuzzy": "Fuzzy Time Series",
    "lube": "LUBE",
    "ensemble": "Ensemble",
}
# Upper limits and names of the temperature bands.
TEMPERATURE_BANDS = [
    (0, "blue-600"),
    (10, "blue-500"),
    (20, "green-500"),
    (30, "yellow-500"),
    (40, "orange-500"),
]
TOP_BAND = "red-500"


def performance_label(metric: Column) -> Column:
    return F.when(metric < 2, "Excellent").when(metric < 5, "Good").otherwise("Needs Improvement")


def influence_label(weight: Column) -> Column:
    return F.when(weight > 0.3, "High").when(weight > 0.15, "Medium").otherwise("Low")


def display_name(code: Column) -> Column:
    titles = F.create_map(*[F.lit(x) for pair in MODEL_TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(titles, code), F.upper(code))


def temperature_band(t: Column) -> Column:
    chain = F
    for limit, name in TEMPERATURE_BANDS:
        chain = chain.when(t < limit, name)
    return chain.otherwise(TOP_BAND)


def sky_icon(h: Column, c: Column) -> Column:
    """Missing cloud cover shows the thermometer."""
    return F.when((c > 80) & (h > 80), "rain").when(c > 80, "cloud").otherwise("thermometer")


def location_name(lat: Column, lon: Column) -> Column:
    return F.format_string("Location (%.2f, %.2f)", lat, lon)


def sc_perf_label(df: DataFrame, *, metric: str = "mae") -> DataFrame:
    return df.withColumn("performance_label", performance_label(F.col(metric)))


def sc_influence_label(df: DataFrame, *, weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    return df.withColumns({"influence": influence_label(w), "weight_percent": w * 100})


def sc_display_name(df: DataFrame, *, model: str = "model") -> DataFrame:
    return df.withColumn("display_name", display_name(F.col(model)))


def sc_temp_band(df: DataFrame) -> DataFrame:
    return df.withColumn("temperature_band", temperature_band(F.col("temperature")))


def sc_sky_icon(df: DataFrame) -> DataFrame:
    return df.withColumn("sky_icon", sky_icon(F.col("humidity"), F.col("cloud_cover")))


def sc_time_labels(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    return df.withColumns(
        {"time_label": F.date_format(ts, "h:mm a"), "date_label": F.date_format(ts, "EEE, MMM d")}
    )


def sc_location_name(df: DataFrame, *, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.withColumn("location_name", location_name(F.col(lat), F.col(lon)))
