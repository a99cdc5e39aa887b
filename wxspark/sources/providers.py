"""Weather and geocoding payloads (JSON files) to nested observations and place lists.

Every reader declares its schema, so a scan is one pass and parallel by file. A payload that cannot be parsed is dropped
on its own; its neighbours stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.functions.labels import location_name
from wxspark.functions.weather import STANDARD_PRESSURE, epoch_ts, kmh_to_ms, parse_ts
from wxspark.schema import BASE

# Field names of the first provider, in the order of the measures.
GRID_FIELDS = [
    "temperature_2m",
    "relative_humidity_2m",
    "surface_pressure",
    "wind_speed_10m",
    "wind_direction_10m",
    "cloud_cover",
    "precipitation",
]
_HOUR = "temp_c double, humidity double, pressure_mb double, wind_kph double, wind_degree double, cloud double, precip_mm double"
_PLACE = "struct<name:string,lat:double,lon:double,country:string,region:string,localtime:string>"


def _location(name: Column, lat: Column, lon: Column, country: Column, region: Column) -> Column:
    return F.struct(
        name.alias("name"), lat.alias("latitude"), lon.alias("longitude"), country.alias("country"), region.alias("region")
    ).alias("location")


def _none() -> Column:
    return F.lit(None).cast("string")


def _grid_location() -> Column:
    lat, lon = F.col("latitude"), F.col("longitude")
    return _location(location_name(lat, lon), lat, lon, F.lit("Unknown"), _none())


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    good = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return good.filter(F.col("_bad").isNull())


def read_openmeteo_hourly(spark: SparkSession, path: str) -> DataFrame:
    """One row per hour of each payload. Missing and zero values take the default of their field."""
    arrays = ", ".join(["time: array<string>", *[f"{f}: array<double>" for f in GRID_FIELDS]])
    raw = _json(spark, path, f"latitude double, longitude double, hourly struct<{arrays}>")
    zipped = F.arrays_zip(*[F.col(f"hourly.{f}").alias(f) for f in ["time", *GRID_FIELDS]])
    rows = raw.select("latitude", "longitude", F.inline(zipped))

    def filled(field: str) -> Column:
        x = F.col(field)
        default = STANDARD_PRESSURE if field == "surface_pressure" else 0.0
        return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)

    return rows.select(
        parse_ts(F.col("time")).alias("timestamp"), *[filled(f).alias(c) for f, c in zip(GRID_FIELDS, BASE)], _grid_location()
    )


def read_openmeteo_current(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(["time: string", *[f"{f}: double" for f in GRID_FIELDS]])
    raw = _json(spark, path, f"latitude double, longitude double, current struct<{fields}>")
    cols = {c: F.col(f"current.{f}") for f, c in zip(GRID_FIELDS, BASE)}
    cols["precipitation"] = F.coalesce(cols["precipitation"], F.lit(0.0))
    return raw.select(
        parse_ts(F.col("current.time")).alias("timestamp"), *[x.alias(c) for c, x in cols.items()], _grid_location()
    )


def _second(prefix: str) -> list[Column]:
    f = lambda n: F.col(f"{prefix}.{n}")
    values = [
        f("temp_c"), f("humidity"), f("pressure_mb"), kmh_to_ms(f("wind_kph")), f("wind_degree"), f("cloud"),
        F.coalesce(f("precip_mm"), F.lit(0.0)),
    ]
    return [v.alias(c) for v, c in zip(values, BASE)]


def _second_location() -> Column:
    f = lambda n: F.col(f"location.{n}")
    return _location(f("name"), f("lat"), f("lon"), f("country"), f("region"))


def read_weatherapi_current(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(spark, path, f"location {_PLACE}, current struct<{_HOUR}>")
    return raw.select(parse_ts(F.col("location.localtime")).alias("timestamp"), *_second("current"), _second_location())


def read_weatherapi_history(spark: SparkSession, path: str) -> DataFrame:
    """One payload per day; the hours of its first day. A broken day is skipped, the others are kept."""
    raw = _json(spark, path, f"location {_PLACE}, forecast struct<forecastday: array<struct<hour: array<struct<time: string, {_HOUR}>>>>>")
    hours = raw.select("location", F.explode(F.get("forecast.forecastday", F.lit(0))["hour"]).alias("h"))
    return hours.select(parse_ts(F.col("h.time")).alias("timestamp"), *_second("h"), _second_location())


def read_owm_current(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(
        spark, path,
        "name string, coord struct<lat: double, lon: double>, sys struct<country: string>, dt bigint,"
        " main struct<temp: double, humidity: double, pressure: double>, wind struct<speed: double, deg: double>,"
        " clouds struct<all: double>, rain struct<`1h`: double>",
    )
    values = [
        F.col("main.temp"), F.col("main.humidity"), F.col("main.pressure"), F.col("wind.speed"),
        F.coalesce("wind.deg", F.lit(0.0)), F.col("clouds.all"), F.coalesce(F.col("rain.1h"), F.lit(0.0)),
    ]
    return raw.select(
        epoch_ts(F.col("dt")).alias("timestamp"), *[v.alias(c) for v, c in zip(values, BASE)],
        _location(F.col("name"), F.col("coord.lat"), F.col("coord.lon"), F.col("sys.country"), _none()),
    )


# ---- geocoding: query, rank, name, lat, lon, country, region -------------------------------------------------------

_NAMED = "name string, {lat} double, {lon} double, country string, {region} string"


def _file_query() -> Column:
    base = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.url_decode(F.regexp_replace(base, r"\.[^.]*$", ""))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """One answer per file as (query, value); the base name of the file is the query text."""
    return spark.read.text(path, wholetext=True).select(_file_query().alias("query"), "value")


def _reader(items: str | None, lat: str, lon: str, region: str, country_default: str | None):
    item = "struct<" + _NAMED.format(lat=lat, lon=lon, region=region).replace(" ", ":").replace(",:", ",") + ">"
    schema = f"{items} array<{item}>" if items else f"array<{item}>"

    def read(source: DataFrame | tuple[SparkSession, str], *, limit: int | None = None) -> DataFrame:
        """``source``: a frame (query, value) of answer texts, or (session, path) for one file per answer."""
        text = source if isinstance(source, DataFrame) else answers(*source)
        parsed = text.select("query", F.from_json("value", schema).alias("p"))
        found = F.col(f"p.{items}") if items else F.col("p")
        if limit is not None:
            found = F.slice(found, 1, limit)
        rows = parsed.select("query", F.posexplode(found).alias("rank", "r"))
        country = F.col("r.country")
        return rows.select(
            "query", (F.col("rank") + 1).alias("rank"), "r.name", F.col(f"r.{lat}").alias("lat"), F.col(f"r.{lon}").alias("lon"),
            (F.coalesce(country, F.lit(country_default)) if country_default else country).alias("country"),
            F.col(f"r.{region}").alias("region"),
        )

    return read


geocode_openmeteo = _reader("results", "latitude", "longitude", "admin1", "Unknown")
geocode_weatherapi = _reader(None, "lat", "lon", "region", None)
geocode_owm = _reader(None, "lat", "lon", "state", None)
