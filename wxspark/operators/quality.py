"""Validation of observations, requests and whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.timeline import Shape
from wxspark.schema import BASE, MODEL_TYPES, STATION, TS

# Accepted range of each field (low, high, low is allowed); None is open.
RANGES = {
    "humidity": (0, 100, True),
    "pressure": (0, None, False),
    "wind_speed": (0, None, True),
    "wind_direction": (0, 360, True),
    "cloud_cover": (0, 100, True),
    "precipitation": (0, None, True),
}
REQUIRED = [TS] + [c for c in BASE if c != "precipitation"]
# Limits outside which a series is reported (low, high, wording).
SERIES_LIMITS = {
    "temperature": (-50, 60, "Extreme"),
    "humidity": (0, 100, "Invalid"),
    "pressure": (800, 1100, "Extreme"),
}
MIN_ROWS = {"prepare": 24, "train": 100, "series": 50, "fuzzy": 10}
FLAT_COLUMNS = [TS, *BASE, "latitude", "longitude"]


def _tenth(x: Column) -> Column:
    """One decimal, with a tiny shift so that ties read the same in every engine."""
    return F.round(x + 1e-9, 1)


def _out_of_range(c: str) -> Column:
    lo, hi, closed = RANGES[c]
    bad = F.col(c) < lo if closed else F.col(c) <= lo
    return bad if hi is None else bad | (F.col(c) > hi)


def val_obs(df: DataFrame) -> DataFrame:
    """Add ``reasons`` (names of the failing fields, in fixed order) and ``is_valid``."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in REQUIRED if c in df.columns]
    checks += [F.when(_out_of_range(c), F.lit(f"{c} out of range")) for c in RANGES if c in df.columns]
    if "latitude" in df.columns:
        checks += [
            F.when(~F.coalesce(F.col("latitude").between(-90, 90), F.lit(False)), F.lit("latitude out of range")),
            F.when(~F.coalesce(F.col("longitude").between(-180, 180), F.lit(False)), F.lit("longitude out of range")),
        ]
    out = df.withColumn("reasons", F.filter(F.array(*checks), lambda r: r.isNotNull()))
    return out.withColumn("is_valid", F.size("reasons") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons)."""
    checked = val_obs(df)
    return checked.filter("is_valid").drop("is_valid", "reasons"), checked.filter("NOT is_valid").drop("is_valid")


def val_coords(df, *, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    ok = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    return df.withColumn("valid_coords", F.coalesce(ok, F.lit(False)))


def val_requests(df: DataFrame) -> DataFrame:
    """Requests with columns horizon (default 24), query, limit, city_limit; adds ``valid_request``."""
    horizon = F.coalesce(F.col("horizon"), F.lit(24))
    ok = (
        horizon.between(1, 168)
        & F.length("query").between(2, 100)
        & F.col("limit").between(1, 50)
        & F.col("city_limit").between(1, 20)
    )
    return df.withColumns({"horizon": horizon, "valid_request": F.coalesce(ok, F.lit(False))})


def val_model_type(df, *, column: str = "model_type") -> DataFrame:
    return df.withColumn("valid_model_type", F.coalesce(F.col(column).isin(MODEL_TYPES), F.lit(False)))


def bbox_filter(df, lat: float, lon: float, *, tol: float = 0.1, lat_col="latitude", lon_col="longitude") -> DataFrame:
    """Rows in the box around a point; the comparison reaches the Parquet scan."""
    return df.filter(F.col(lat_col).between(lat - tol, lat + tol) & F.col(lon_col).between(lon - tol, lon + tol))


def min_rows_gate(df, *, stage: str = "prepare", station: str = STATION, ts: str = TS, shape: Shape | None = None) -> DataFrame:
    """Keep the series with enough rows for a stage. Counts travel in a small table, not in a window."""
    shape = shape or timeline.measure(df, station)
    enough = df.groupBy(station).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= MIN_ROWS[stage]).drop("_c")
    return timeline.join_small(df, enough, [station], shape.series, "left_semi")


def agg_quality(df, *, station: str = STATION, ts: str = TS, strict: bool = False) -> DataFrame:
    """Per series: size, time range, missing share, issues and verdict, in one aggregate.

    A series is valid with at most two issues; ``strict`` also asks for 24 rows.
    """
    flat = [c for c in FLAT_COLUMNS if c in df.columns or c == TS]
    flat = [ts if c == TS else c for c in flat]
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in flat), F.lit(0).cast("long"))
    g = df.groupBy(station).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        nulls.alias("_nulls"),
        *[f(c).alias(f"_{n}_{c}") for c in SERIES_LIMITS for n, f in (("lo", F.min), ("hi", F.max))],
    )
    missing = F.col("_nulls") / (F.col("total_records") * len(flat)) * 100
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    g = g.withColumns(
        {
            "duration_hours": (seconds("end_ts") - seconds("start_ts")) / 3600.0,
            "missing_data_percentage": missing,
        }
    )
    checks = [
        F.when(
            F.col("missing_data_percentage") > 20,
            F.format_string("High missing data: %.1f%%", F.col("missing_data_percentage")),
        ),
        F.when(
            F.col("total_records") < MIN_ROWS["prepare"],
            F.format_string("Insufficient data: %d records", F.col("total_records")),
        ),
    ]
    for c, (lo, hi, word) in SERIES_LIMITS.items():
        a, b = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        checks.append(F.when((a < lo) | (b > hi), F.format_string(f"{word} {c} values: %.1f to %.1f", _tenth(a), _tenth(b))))
    g = g.withColumn("issues", F.filter(F.array(*checks), lambda i: i.isNotNull()))
    valid = F.size("issues") <= 2
    if strict:
        valid = valid & (F.col("total_records") >= MIN_ROWS["prepare"])
    return g.withColumn("is_valid", valid).select(
        station, "total_records", "start_ts", "end_ts", "duration_hours", "missing_data_percentage", "issues", "is_valid"
    )
