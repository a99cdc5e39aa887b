"""Payload readers, snapshots, the model registry and saved models."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wxspark.catalog.base import query
from wxspark.catalog.models import PERF, log_table, model_frame
from wxspark.catalog.series import AR1_FIT
from wxspark.functions.weather import epoch_ts, parse_ts
from wxspark.operators import ensemble as E
from wxspark.operators import series
from wxspark.session import scratch
from wxspark.sources import providers, stores
from wxspark.sources.panel import customer_points, located, panel, panel_table
from wxspark.schema import BASE

NTZ = "timestamp_ntz"


@query("sc_parse_ts", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS a, date_trunc('minute', ts)::TIMESTAMP AS b, date_trunc('second', ts)::TIMESTAMP AS c, NULL::TIMESTAMP AS d FROM events", keys="event_id a b c d")
def sc_parse_ts(spark, path):
    e = spark.read.parquet(f"{path}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    texts = e.select(
        "event_id", "t", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("t", "yyyy-MM-dd'T'HH:mm'Z'").alias("minute")
    )
    return texts.select(
        "event_id", parse_ts(F.col("iso")).cast(NTZ).alias("a"), parse_ts(F.col("minute")).cast(NTZ).alias("b"),
        epoch_ts(F.unix_timestamp("t")).cast(NTZ).alias("c"), parse_ts(F.concat(F.lit("x"), "iso")).cast(NTZ).alias("d"),
    )


@query("src_openmeteo_current", "SELECT ts, latitude, longitude, temperature, wind_speed, precipitation, printf('Location (%.2f, %.2f)', latitude, longitude) AS location_name, 'Unknown' AS country FROM located",
       keys="ts location_name country", nums="latitude longitude temperature wind_speed precipitation")
def src_openmeteo_current(spark, path):
    obs = located(panel(spark, path)).withColumn("precipitation", F.when(F.col("precipitation") > 0, F.col("precipitation")))
    now = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("time"), *[F.col(c).alias(g) for c, g in zip(BASE, providers.GRID_FIELDS)])
    where = scratch(spark, "payload")
    obs.select("latitude", "longitude", now.alias("current")).write.json(where)
    flat = stores.flatten_obs(providers.read_openmeteo_current(spark, where))
    return flat.withColumn("ts", F.col("ts").cast(NTZ))


@query("src_weatherapi_current", "SELECT station, ts, latitude, temperature, wind_speed, pressure FROM located", keys="station ts", nums="latitude temperature wind_speed pressure")
def src_weatherapi_current(spark, path):
    obs = located(panel(spark, path))
    place = F.struct(F.col("station").alias("name"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit("X").alias("country"),
                     F.date_format("ts", "yyyy-MM-dd H:mm").alias("localtime"))
    now = F.struct(F.col("temperature").alias("temp_c"), "humidity", F.col("pressure").alias("pressure_mb"), (F.col("wind_speed") * 3.6).alias("wind_kph"),
                   F.col("wind_direction").alias("wind_degree"), F.col("cloud_cover").alias("cloud"))
    where = scratch(spark, "payload")
    obs.select(place.alias("location"), now.alias("current")).write.json(where)
    flat = stores.flatten_obs(providers.read_weatherapi_current(spark, where))
    return flat.withColumnRenamed("location_name", "station").withColumn("ts", F.col("ts").cast(NTZ))


GEO = "geo AS (SELECT CAST(id // 5 AS VARCHAR) AS query, 1 + id % 5 AS rank, 'P' || id AS name, lat, lon, CASE WHEN id % 3 <> 0 THEN 'C' || (id % 7) END AS country, CASE WHEN id % 2 = 0 THEN 'R' END AS region FROM points)"


def answer_texts(spark, path, lat, lon, region, wrap):
    """One answer text per five neighbouring customers."""
    i = F.col("id")
    item = F.struct(
        F.concat(F.lit("P"), i.cast("string")).alias("name"), F.col("lat").alias(lat), F.col("lon").alias(lon),
        F.when(i % 3 != 0, F.concat(F.lit("C"), (i % 7).cast("string"))).alias("country"), F.when(i % 2 == 0, "R").alias(region),
    )
    grouped = customer_points(spark, path).groupBy(F.floor(i / 5).cast("string").alias("query")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))), lambda s: s["x"]).alias("items")
    )
    return grouped.select("query", F.to_json(F.struct(F.col("items").alias("results")) if wrap else F.col("items")).alias("value"))


@query("src_geocode_openmeteo", "SELECT query, rank, name, lat, lon, coalesce(country, 'Unknown') AS country, region FROM geo", keys="query name country region", ints="rank", nums="lat lon", ctes=GEO)
def src_geocode_openmeteo(spark, path):
    return providers.geocode_openmeteo(answer_texts(spark, path, "latitude", "longitude", "admin1", True))


@query("src_geocode_weatherapi", "SELECT * FROM geo WHERE rank <= 3", keys="query name country region", ints="rank", nums="lat lon", ctes=GEO)
def src_geocode_weatherapi(spark, path):
    return providers.geocode_weatherapi(answer_texts(spark, path, "lat", "lon", "region", False), limit=3)


@query("src_geocode_owm", "SELECT * FROM geo", keys="query name country region", ints="rank", nums="lat lon", ctes=GEO)
def src_geocode_owm(spark, path):
    return providers.geocode_owm(answer_texts(spark, path, "lat", "lon", "state", False))


# ---- snapshots ----------------------------------------------------------------------------------------------------


def _snapshots(spark, path):
    obs = panel_table(spark, path).select("station", "ts", "temperature")
    where = scratch(spark, "snapshots")
    for sid, day, keep in (("old", 1, F.hour("ts") < 12), ("new", 2, F.hour("ts") >= 12), ("other", 3, F.hour("ts") == 0)):
        stores.write_snapshot(
            obs.filter(keep), where, snapshot_id=sid, model="rf" if sid != "other" else "ar", lat=19.0, lon=73.0,
            created_at=datetime(2024, 2, day), features=["temperature"], config={"scaler": "standard"},
        )
    return where


@query("src_training_snapshot", "SELECT station, ts, temperature FROM panel WHERE hour(ts) >= 12", keys="station ts", nums="temperature")
def src_training_snapshot(spark, path):
    return stores.read_snapshot(spark, _snapshots(spark, path), "rf", 19.0, 73.0)


@query(
    "snk_training_snapshot",
    "SELECT snapshot_id, snapshot_id IN ('new', 'other') AS is_active, count(*) AS n FROM (SELECT CASE WHEN hour(ts) < 12 THEN 'old' ELSE 'new' END AS snapshot_id FROM panel UNION ALL SELECT 'other' FROM panel WHERE hour(ts) = 0) GROUP BY 1",
    keys="snapshot_id is_active", ints="n",
)
def snk_training_snapshot(spark, path):
    where = _snapshots(spark, path)
    active = stores.active_snapshots(spark.read.parquet(f"{where}/headers")).select("snapshot_id", F.lit(True).alias("_a"))
    counts = spark.read.parquet(f"{where}/samples").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(active, "snapshot_id", "left").withColumn("is_active", F.coalesce("_a", F.lit(False)))


# ---- registry -----------------------------------------------------------------------------------------------------


def _registry(spark, path):
    """One entry per station and model, at the station's place; written and read back."""
    m = model_frame(log_table(spark, path))
    c = F.ascii("station")
    rows = located(m).select(
        F.concat_ws("/", "station", "model").alias("model_id"), F.col("model").alias("model_type"), F.lit("1").alias("version"), "latitude", "longitude",
        F.timestamp_seconds(1704067200 + c * 60 + F.length("model")).alias("created_at"), F.timestamp_seconds(F.lit(1704067200)).alias("changed_at"),
        F.create_map(F.lit("p"), F.lit("1")).alias("hyperparameters"), F.array(F.lit("temperature")).alias("features"),
        F.array(F.lit("temperature")).alias("targets"), "mae", "rmse", "mape", F.lit("-").alias("path"), F.lit(0).cast("long").alias("size_bytes"),
        F.lit(True).alias("is_active"), "is_trained",
    )
    where = scratch(spark, "registry")
    stores.registry_append(spark, rows, where)
    return where


REG = PERF + ", reg AS (SELECT DISTINCT m.station || '/' || m.model AS model_id, m.station, m.model AS model_type, mae, is_trained, latitude, longitude FROM models m JOIN located USING (station))"


@query("snk_registry", "SELECT model_id, model_type, mae, is_trained, latitude FROM reg", keys="model_id model_type is_trained", nums="mae latitude", ctes=REG)
def snk_registry(spark, path):
    return stores.registry_state(spark.read.parquet(_registry(spark, path)))


@query("src_registry", "SELECT model_id, mae FROM reg WHERE is_trained AND latitude BETWEEN 10 AND 30 AND longitude BETWEEN 71.5 AND 91.5", keys="model_id", nums="mae", ctes=REG)
def src_registry(spark, path):
    return stores.registry_active(spark.read.parquet(_registry(spark, path)), 20.0, 81.5, tol=10.0)


def _deactivated(spark, path):
    where = _registry(spark, path)
    log = spark.read.parquet(where)
    off = stores.registry_deactivate(log, 25.0, 81.5, datetime(2024, 3, 1), model_type="daily", tol=15.0)
    stores.registry_append(spark, off, where)
    return spark.read.parquet(where)


OFF = "model_type = 'daily' AND latitude BETWEEN 10 AND 40 AND longitude BETWEEN 66.5 AND 96.5"


@query("registry_deactivate", f"SELECT model_id, NOT ({OFF}) AS is_active FROM reg", keys="model_id is_active", ctes=REG)
def registry_deactivate(spark, path):
    return stores.registry_state(_deactivated(spark, path))


@query("model_cleanup", f"SELECT model_id FROM reg WHERE NOT ({OFF})", keys="model_id", ctes=REG)
def model_cleanup(spark, path):
    return stores.model_cleanup(_deactivated(spark, path), datetime(2024, 6, 1)).select("model_id").distinct()


# ---- saved models -------------------------------------------------------------------------------------------------


@query("model_save_load", "SELECT station, n, a AS const, b AS coef FROM fit", keys="station", ints="n", nums="const coef", ctes=AR1_FIT)
def model_save_load(spark, path):
    root = scratch(spark, "models")
    stores.save_model(series.mdl_ar(panel(spark, path), "temperature"), root, "ar", {"p": "1"})
    params, _ = stores.load_model(spark, root, "ar")
    return params.withColumn("coef", F.col("level_coef")[0])


@query("en_state", "SELECT * FROM weights", keys="station model", nums="weight", ctes=PERF)
def en_state(spark, path):
    root = scratch(spark, "models")
    stores.save_model(E.en_performance(model_frame(log_table(spark, path))), root, "ensemble", {"method": "performance"})
    return stores.load_model(spark, root, "ensemble")[0]
