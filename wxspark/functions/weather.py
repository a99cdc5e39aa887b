"""Weather arithmetic as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dew point coefficients.
DEW_A, DEW_B = 17.27, 237.7
# Heat index regression, (coefficient, power of temperature, power of humidity).
HEAT_TERMS = [
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-6.83783e-3, 2, 0),
    (-5.481717e-2, 0, 2),
    (1.22874e-3, 2, 1),
    (8.5282e-4, 1, 2),
    (-1.99e-6, 2, 2),
]
STANDARD_PRESSURE = 1013.25
# Right-closed bin edges; a value outside has no bin.
TEMPERATURE_EDGES = [-50, 0, 10, 20, 30, 50]
WIND_EDGES = [0, 2, 5, 10, 15, 100]
PRESSURE_EDGES = [0, 1000, 1013, 1025, 1100]
RAIN_EDGES = [-0.1, 0, 2.5, 10, 50, float("inf")]


def right_closed(x: Column, edges: Sequence[float]) -> Column:
    """Number of the bin (lo, hi] that holds x, starting at 0; null outside."""
    chain = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = x > lo if hi == float("inf") else (x > lo) & (x <= hi)
        chain = F.when(inside, F.lit(i)) if chain is None else chain.when(inside, F.lit(i))
    return chain


def season(month: Column) -> Column:
    """0 winter, 1 spring, 2 summer, 3 autumn."""
    return F.floor((month % 12) / 3).cast("int")


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * F.pi() * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def dew_point(t: Column, h: Column) -> Column:
    """Undefined (null) without humidity."""
    gamma = F.when(h > 0, DEW_A * t / (DEW_B + t) + F.ln(h / 100))
    return F.try_divide(DEW_B * gamma, DEW_A - gamma)


def heat_index(t: Column, h: Column, unit: str = "reference") -> Column:
    """``reference`` feeds Celsius into the Fahrenheit regression, as the matched results do; ``f`` converts first and
    returns Celsius."""
    if unit == "f":
        return (heat_index(t * 1.8 + 32, h) - 32) / 1.8
    simple = t + 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + h * 0.094)
    full = None
    for c, i, j in HEAT_TERMS:
        term = F.lit(c)
        for factor in [t] * i + [h] * j:
            term = term * factor
        full = term if full is None else full + term
    return F.when(simple >= 80, full).otherwise(simple)


def wind_chill(t: Column, v: Column) -> Column:
    k = F.pow(v * 3.6, F.lit(0.16))
    return F.when((t <= 10) & (v * 3.6 >= 4.8), 13.12 + 0.6215 * t - 11.37 * k + 0.3965 * t * k).otherwise(t)


def feels_like(t: Column, h: Column, v: Column) -> Column:
    return F.when(t >= 27, heat_index(t, h)).when(t <= 10, wind_chill(t, v)).otherwise(t)


def flag(condition: Column) -> Column:
    return condition.cast("double")


def kmh_to_ms(x: Column) -> Column:
    return x / 3.6


def ms_to_kmh(x: Column) -> Column:
    return x * 3.6


def parse_ts(text: Column) -> Column:
    """ISO text, with or without seconds and zone, to timestamp; null when unreadable."""
    with_seconds = F.regexp_replace(text, r"(\d{1,2}:\d{2})(Z|[+-]\d{2}:?\d{2})$", "$1:00$2")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(with_seconds))


def epoch_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


# ---- column groups added to a frame -------------------------------------------------------------------------------


def sc_time_parts(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    """hour, day_of_week (Monday = 0), day_of_year, month, season."""
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "day_of_year": F.dayofyear(ts),
            "month": F.month(ts),
            "season": season(F.month(ts)),
        }
    )


def sc_season(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    return df.withColumn("season", season(F.month(ts)))


def sc_cyclic(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    parts = {
        "hour": (F.hour(ts), 24),
        "day_of_week": (F.weekday(ts), 7),
        "month": (F.month(ts), 12),
        "wind_direction": (F.col("wind_direction"), 360),
    }
    cols = {}
    for name, (x, period) in parts.items():
        cols[f"{name}_sin"], cols[f"{name}_cos"] = cyclic(x, period)
    return df.withColumns(cols)


def sc_dew_point(df: DataFrame) -> DataFrame:
    return df.withColumn("dew_point", dew_point(F.col("temperature"), F.col("humidity")))


def sc_heat_index(df: DataFrame, *, unit: str = "reference") -> DataFrame:
    return df.withColumn("heat_index", heat_index(F.col("temperature"), F.col("humidity"), unit))


def sc_wind_chill(df: DataFrame) -> DataFrame:
    return df.withColumn("wind_chill", wind_chill(F.col("temperature"), F.col("wind_speed")))


def sc_feels_like(df: DataFrame) -> DataFrame:
    t, h, v = F.col("temperature"), F.col("humidity"), F.col("wind_speed")
    return df.withColumn("feels_like", feels_like(t, h, v))


def sc_ratio_norm(df: DataFrame) -> DataFrame:
    t, h, p = F.col("temperature"), F.col("humidity"), F.col("pressure")
    return df.withColumns(
        {
            "temp_humidity_ratio": F.try_divide(t, h + 1e-6),
            "pressure_normalized": (p - STANDARD_PRESSURE) / STANDARD_PRESSURE,
        }
    )


def sc_precip_intensity(df: DataFrame) -> DataFrame:
    return df.withColumn("precipitation_intensity", right_closed(F.col("precipitation"), RAIN_EDGES))


def sc_interactions(df: DataFrame) -> DataFrame:
    t, h, p = F.col("temperature"), F.col("humidity"), F.col("pressure")
    return df.withColumns(
        {
            "temp_humidity_interaction": t * h,
            "temp_humidity_ratio": F.try_divide(t, h + 1e-6),
            "pressure_temp_ratio": F.try_divide(p, t + 273.15),
        }
    )


def sc_wind_components(df: DataFrame) -> DataFrame:
    v, d = F.col("wind_speed"), F.radians("wind_direction")
    return df.withColumns({"wind_u": v * F.cos(d), "wind_v": v * F.sin(d)})


def sc_polynomials(df: DataFrame) -> DataFrame:
    cols = {}
    for c in ("temperature", "pressure", "wind_speed"):
        x = F.col(c)
        cols[f"{c}_squared"] = x * x
        cols[f"{c}_cubed"] = x * x * x
    return df.withColumns(cols)


def sc_bins(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "temp_category": right_closed(F.col("temperature"), TEMPERATURE_EDGES).cast("double"),
            "wind_category": right_closed(F.col("wind_speed"), WIND_EDGES).cast("double"),
            "pressure_category": right_closed(F.col("pressure"), PRESSURE_EDGES).cast("double"),
        }
    )


def sc_pattern_flags(df: DataFrame) -> DataFrame:
    c, r = F.col("cloud_cover"), F.col("precipitation")
    return df.withColumns({"rain_probability": (c > 70) & (r > 0), "clear_sky": c < 20, "overcast": c > 80})


def sc_comfort(df: DataFrame) -> DataFrame:
    ok = F.col("temperature").between(18, 24) & F.col("humidity").between(40, 60)
    return df.withColumn("comfort_index", flag(ok))


def sc_extremes(df: DataFrame) -> DataFrame:
    t, v = F.col("temperature"), F.col("wind_speed")
    return df.withColumns({"extreme_cold": flag(t < -10), "extreme_hot": flag(t > 35), "high_wind": flag(v > 10)})


def sc_tendency_flags(df: DataFrame) -> DataFrame:
    d = F.col("pressure_tendency")
    return df.withColumns({"pressure_rising": flag(d > 0.5), "pressure_falling": flag(d < -0.5)})


def sc_units(df: DataFrame) -> DataFrame:
    v = F.col("wind_speed")
    return df.withColumns({"wind_kmh": ms_to_kmh(v), "wind_ms": kmh_to_ms(ms_to_kmh(v))})


def fe_advanced(df: DataFrame) -> DataFrame:
    """The whole forest column set; tendency flags are added where ``pressure_tendency`` is present."""
    for step in (sc_interactions, sc_wind_components, sc_polynomials, sc_bins, sc_pattern_flags, sc_comfort, sc_extremes):
        df = step(df)
    return sc_tendency_flags(df) if "pressure_tendency" in df.columns else df
