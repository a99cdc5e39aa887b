"""Spatial joins, search, providers, stores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wxspark.catalog.base import query
from wxspark.catalog.models import COMBINE, PERF, log_table, model_frame
from wxspark.functions.geo import CITIES, EARTH_KM, cities, haversine
from wxspark.operators import ensemble as E
from wxspark.operators import places as P
from wxspark.operators import report
from wxspark.session import scratch
from wxspark.sources import providers, stores
from wxspark.sources.panel import customer_points, forecast_log, located, panel, panel_table

CITY_SQL = "cities(rank, name, lat, lon, region) AS (VALUES " + ", ".join(
    f"({i}, '{n}', {a}::DOUBLE, {o}::DOUBLE, '{r}')" for i, (n, a, o, r) in enumerate(CITIES, 1)
) + ")"


def hav(a, b, c, d):
    return (
        f"2*6371.0::DOUBLE*asin(sqrt(pow(sin(radians({c}-{a})/2),2) + cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)))"
    )


NEAR = CITY_SQL + (
    ", dist AS (SELECT p.id, p.lat, p.lon, c.name, c.region, c.rank, " + hav("p.lat", "p.lon", "c.lat", "c.lon") + " AS km FROM points p, cities c),"
    " near AS (SELECT id, lat, lon, arg_min(name, km) AS city, min(km) AS km, arg_min(region, km) AS region FROM dist GROUP BY 1, 2, 3)"
)


@query(
    "sc_haversine", "SELECT id, " + hav("lat", "lon", "28.7041::DOUBLE", "77.1025::DOUBLE") + " AS km FROM points", keys="id", nums="km",
)
def sc_haversine(spark, path):
    km = haversine(F.col("lat"), F.col("lon"), F.lit(28.7041), F.lit(77.1025))
    return customer_points(spark, path).withColumn("km", km)


@query(
    "join_nearest_city", "SELECT id, CASE WHEN km < 100 THEN city END AS city, CASE WHEN km < 100 THEN km END AS distance_km FROM near",
    keys="id city", nums="distance_km", ctes=NEAR,
)
def join_nearest_city(spark, path):
    return P.join_nearest_city(customer_points(spark, path))


@query(
    "join_nearest_city_table", "SELECT id, CASE WHEN km < 100 THEN city END AS city, CASE WHEN km < 100 THEN km END AS distance_km FROM near",
    keys="id city", nums="distance_km", ctes=NEAR,
)
def join_nearest_city_table(spark, path):
    """The same lookup against a city table of any size."""
    return P.join_nearest_city(customer_points(spark, path), cities(spark))


@query(
    "reverse_geocode",
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'Place ' || id WHEN km < 100 THEN city ELSE printf('Location (%.2f, %.2f)', lat, lon) END AS name,"
    " CASE WHEN id % 3 = 0 THEN 'Geo' WHEN km < 100 THEN 'India' ELSE 'Unknown' END AS country,"
    " CASE WHEN id % 3 = 0 THEN NULL WHEN km < 100 THEN region END AS region FROM near",
    keys="id name country region", ctes=NEAR,
)
def reverse_geocode(spark, path):
    pts = customer_points(spark, path)
    hits = pts.filter(F.col("id") % 3 == 0).select(
        "id", F.concat(F.lit("Place "), F.col("id").cast("string")).alias("name"), F.lit("Geo").alias("country"),
        F.lit(None).cast("string").alias("region"),
    )
    return P.reverse_geocode(pts, hits)


BANDS = (
    "req AS (SELECT s_suppkey AS id, 8 + (s_suppkey*13 % 2800)/100.0::DOUBLE AS lat, 68 + (s_suppkey*13*7 % 2700)/100.0::DOUBLE AS lon,"
    " TIMESTAMP '1996-01-01' AS t0, TIMESTAMP '1998-12-31' AS t1 FROM supplier),"
    " rws AS (SELECT o_orderkey, o_totalprice, o_orderdate AS ts, 8 + (o_custkey % 2800)/100.0::DOUBLE AS latitude, 68 + (o_custkey*7 % 2700)/100.0::DOUBLE AS longitude FROM orders)"
)


@query(
    "join_band",
    "SELECT id, o_orderkey, ts, o_totalprice FROM req, rws WHERE latitude BETWEEN lat-0.25 AND lat+0.25 AND longitude BETWEEN lon-0.25 AND lon+0.25 AND ts BETWEEN t0 AND t1",
    keys="id o_orderkey ts", nums="o_totalprice", ctes=BANDS,
)
def join_band(spark, path):
    k, c = F.col("s_suppkey"), F.col("o_custkey")
    req = spark.read.parquet(f"{path}/supplier.parquet").select(
        k.alias("id"), (8 + (k * 13 % 2800) / F.lit(100.0)).alias("lat"), (68 + (k * 13 * 7 % 2700) / F.lit(100.0)).alias("lon"),
        F.lit("1996-01-01").cast("timestamp_ntz").alias("t0"), F.lit("1998-12-31").cast("timestamp_ntz").alias("t1"),
    )
    rows = spark.read.parquet(f"{path}/orders.parquet").select(
        "o_orderkey", "o_totalprice", F.col("o_orderdate").alias("ts"),
        (8 + (c % 2800) / F.lit(100.0)).alias("latitude"), (68 + (c * 7 % 2700) / F.lit(100.0)).alias("longitude"),
    )
    return P.join_band(req, rows, tol=0.25, start="t0", end="t1")


# Provider results for search: one row per customer and provider, places repeat and shift.
SEARCH = (
    "sr AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'pur' WHEN 1 THEN 'an' ELSE 'zz' END AS query, p AS priority, c_custkey AS rank, 'Place ' || (c_custkey % 97) AS name,"
    " 8 + (c_custkey % 97 + p)/4.0::DOUBLE AS lat, 70 + (c_custkey % 89)/4.0::DOUBLE AS lon, CASE WHEN c_custkey % 5 = 0 THEN 'India' WHEN c_custkey % 5 = 1 THEN 'IN' ELSE 'Other' END AS country, NULL::VARCHAR AS region"
    " FROM customer, range(0, 2) r(p)),"
    " dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, round(lat,2), round(lon,2) ORDER BY priority, rank) AS k FROM sr) WHERE k = 1),"
    " dp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority, rank) AS position FROM dd),"
    " inf AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query ORDER BY CASE WHEN lower(country) IN ('india','in') THEN 0 ELSE 1 END, position) AS position) FROM dp)"
)


def search_results(spark, path, p):
    k = F.col("c_custkey")
    q = F.when(k % 3 == 0, "pur").when(k % 3 == 1, "an").otherwise("zz")
    country = F.when(k % 5 == 0, "India").when(k % 5 == 1, "IN").otherwise("Other")
    return spark.read.parquet(f"{path}/customer.parquet").select(
        q.alias("query"), k.alias("rank"), F.concat(F.lit("Place "), (k % 97).cast("string")).alias("name"),
        (8 + (k % 97 + p) / F.lit(4.0)).alias("lat"), (70 + (k % 89) / F.lit(4.0)).alias("lon"), country.alias("country"),
        F.lit(None).cast("string").alias("region"),
    )


def both(spark, path):
    return [search_results(spark, path, p) for p in (0, 1)]


@query("union_search", "SELECT * FROM sr", keys="query name country", ints="priority rank", nums="lat lon", ctes=SEARCH)
def union_search(spark, path):
    return P.union_search(*both(spark, path))


@query("dedup_coords", "SELECT * FROM dp WHERE position <= 50", keys="query name country", ints="position", nums="lat lon", ctes=SEARCH)
def dedup_coords(spark, path):
    return P.dedup_coords(P.union_search(*both(spark, path)), limit=50)


@query(
    "india_first", "SELECT *, CASE WHEN lower(country) IN ('india','in') THEN 0 ELSE 1 END AS home FROM dd",
    keys="query name country", ints="home priority rank", nums="lat lon", ctes=SEARCH,
)
def india_first(spark, path):
    return P.india_first(P.dedup_coords(P.union_search(*both(spark, path))))


@query(
    "search_locations",
    "SELECT query, name, country, lat, lon, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority, rank) AS position FROM"
    " (SELECT *, row_number() OVER (PARTITION BY query, round(lat,2), round(lon,2) ORDER BY priority, rank) AS k FROM"
    " (SELECT q.query, 0 AS priority, rank, name, lat, lon, 'India' AS country FROM cities, (SELECT DISTINCT query FROM sr) q WHERE contains(lower(name), q.query)"
    " UNION ALL SELECT query, 1, position, name, lat, lon, country FROM inf)) WHERE k = 1) WHERE position <= 10",
    keys="query name country", ints="position", nums="lat lon", ctes=f"{CITY_SQL}, {SEARCH}",
)
def search_locations(spark, path):
    results = both(spark, path)
    return P.search_locations(results[0].select("query"), *results)


@query(
    "limit_cities",
    "SELECT c_custkey, count(*) AS n, arg_max(name, rank) AS last_city FROM customer, cities WHERE rank <= 1 + c_custkey % 20 GROUP BY 1",
    keys="c_custkey last_city", ints="n", ctes=CITY_SQL,
)
def limit_cities(spark, path):
    req = spark.read.parquet(f"{path}/customer.parquet").select("c_custkey", (1 + F.col("c_custkey") % 20).alias("limit"))
    out = P.limit_cities(req)
    return out.withColumns({"n": F.size("cities"), "last_city": F.element_at("cities", -1)["name"]})


# ---- providers ----------------------------------------------------------------------------------------------------

LOG = "plog AS (SELECT event_type AS provider, ts, event_id % 5 < 3 AS success FROM events)"
HEALTH = LOG + (
    ", okk AS (SELECT provider, max(ts) FILTER (success) AS ok FROM plog GROUP BY 1),"
    " hs AS (SELECT l.provider, count(*) AS total_requests, count(*) FILTER (success) AS successful_requests, count(*) FILTER (NOT success AND (ok IS NULL OR ts > ok)) AS f, max(ts) FILTER (NOT success) AS last_failure FROM plog l JOIN okk USING (provider) GROUP BY 1),"
    " hh AS (SELECT *, f >= 3 AND date_diff('second', date_trunc('second', last_failure), date_trunc('second', (SELECT max(ts) FROM plog))) > 300 AS reset FROM hs),"
    " health AS (SELECT provider, total_requests, successful_requests, last_failure, CASE WHEN reset THEN 0 ELSE f END AS consecutive_failures, f < 3 OR reset AS is_healthy FROM hh)"
)


def provider_log(spark, path):
    return spark.read.parquet(f"{path}/events.parquet").select(
        F.col("event_type").alias("provider"), "ts", (F.col("event_id") % 5 < 3).alias("success")
    )


@query(
    "agg_provider_health", "SELECT *, count(*) FILTER (is_healthy) OVER () AS healthy_count FROM health",
    keys="provider last_failure is_healthy", ints="total_requests successful_requests consecutive_failures healthy_count", ctes=HEALTH,
)
def agg_provider_health(spark, path):
    return P.agg_provider_health(provider_log(spark, path))


@query(
    "provider_fallback",
    "SELECT station, ts, provider, temperature FROM (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY CASE WHEN provider = 'b' THEN 1 ELSE 0 END, priority) AS r FROM"
    " (SELECT 'a' AS provider, 0 AS priority, station, ts, temperature FROM panel_n WHERE e % 3 = 0 UNION ALL SELECT 'b', 1, station, ts, temperature + 1 FROM panel_n WHERE e % 4 <> 0"
    " UNION ALL SELECT 'c', 2, station, ts, temperature + 2 FROM panel_n WHERE e % 5 < 2)) WHERE r = 1",
    keys="station ts provider", nums="temperature",
)
def provider_fallback(spark, path):
    from wxspark.sources.panel import hour_sums, read_events, to_observations

    base = to_observations(hour_sums(read_events(spark, path)), "e")
    parts = [("a", 0, F.col("e") % 3 == 0), ("b", 1, F.col("e") % 4 != 0), ("c", 2, F.col("e") % 5 < 2)]
    obs = None
    for name, rank, keep in parts:
        one = base.filter(keep).select(
            F.lit(name).alias("provider"), F.lit(rank).alias("priority"), "station", "ts", (F.col("temperature") + rank).alias("temperature")
        )
        obs = one if obs is None else obs.unionByName(one)
    # Provider b fails three times in a row in the log; a and c answer.
    log = provider_log(spark, path).select(
        F.when(F.col("provider").isin("click", "purchase"), "a").when(F.col("provider") == "error", "b").otherwise("c").alias("provider"), "ts",
        (F.col("provider") != "error").alias("success"),
    )
    health = P.agg_provider_health(log, reset_after=10**9)
    return P.provider_fallback(obs, health)


@query(
    "coverage_gate",
    "SELECT kept.station, ts, temperature, CASE WHEN enough THEN 'stored' ELSE 'fallback' END AS origin FROM kept JOIN have ON kept.station = have.station WHERE enough OR kept.station NOT IN (SELECT station FROM got)"
    " UNION ALL SELECT got.station, ts, temperature, 'fetched' FROM got LEFT JOIN have ON got.station = have.station WHERE NOT coalesce(enough, false)",
    keys="station ts origin", nums="temperature",
    ctes="kept AS (SELECT station, ts, temperature FROM panel WHERE ascii(station) % 2 = 0 OR hour(ts) % 3 = 0), got AS (SELECT station, ts, temperature FROM panel WHERE ascii(station) % 3 <> 0),"
    " have AS (SELECT station, count(*) >= 16*20 AS enough FROM kept GROUP BY station)",
)
def coverage_gate(spark, path):
    obs = panel_table(spark, path)
    kept = obs.filter("ascii(station) % 2 = 0 OR hour(ts) % 3 = 0")
    return P.coverage_gate(kept, obs.filter("ascii(station) % 3 <> 0"), 16)


# ---- stores -------------------------------------------------------------------------------------------------------


@query(
    "src_obs_table",
    "SELECT station, ts, temperature, coalesce(precipitation, 0) AS precipitation, 'Unknown' AS country FROM located WHERE latitude BETWEEN 20.1 AND 30.1 AND longitude BETWEEN 69 AND 79 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    keys="station ts country", nums="temperature precipitation",
)
def src_obs_table(spark, path):
    obs = located(panel(spark, path)).withColumns(
        {"country": F.lit(None).cast("string"), "precipitation": F.when(F.col("precipitation") > 0, F.col("precipitation"))}
    )
    where = scratch(spark, "obs")
    obs.write.parquet(where)
    return stores.read_obs(spark, where, 25.1, 74.0, "2024-01-05", "2024-01-20", tol=5.0)


@query(
    "src_flatten_obs",
    "SELECT ts, latitude, longitude, temperature, precipitation FROM located", keys="ts", nums="latitude longitude temperature precipitation",
)
def src_flatten_obs(spark, path):
    from wxspark.schema import BASE

    p = F.col("precipitation")
    o = located(panel(spark, path)).withColumn("precipitation", F.when(p > 0, p))
    place = F.struct(F.col("station").alias("name"), "latitude", "longitude", F.lit("X").alias("country"), F.lit(None).cast("string").alias("region"))
    return stores.flatten_obs(o.select(F.col("ts").alias("timestamp"), *BASE, place.alias("location")))


@query(
    "snk_obs_upsert",
    "SELECT station, ts, temperature, CASE WHEN hour(ts) < 12 THEN 'first' ELSE 'second' END AS data_source FROM panel",
    keys="station ts data_source", nums="temperature",
)
def snk_obs_upsert(spark, path):
    """Half of the rows are stored first; the second batch brings every row twice, and only the missing half arrives."""
    obs = located(panel_table(spark, path))
    where = scratch(spark, "upsert")
    stores.upsert_obs(spark, obs.filter(F.hour("ts") < 12), where, source="first")
    stores.upsert_obs(spark, obs.unionByName(obs), where, source="second")
    return spark.read.parquet(where)


@query(
    "join_anti_existing", "SELECT station, ts, temperature FROM panel WHERE hour(ts) >= 12", keys="station ts", nums="temperature",
)
def join_anti_existing(spark, path):
    obs = located(panel_table(spark, path))
    return stores.new_rows(obs, obs.filter(F.hour("ts") < 12), source="x")


REG = PERF + ", reg AS (SELECT station, model, mae, count(*) AS n FROM models JOIN pairs USING (station, model) GROUP BY 1, 2, 3)"


@query("registry_best", "SELECT model AS model_type, arg_min(station, mae) AS station, min(mae) AS mae FROM models GROUP BY 1", keys="model_type station", nums="mae", ctes=REG)
def registry_best(spark, path):
    m = model_frame(log_table(spark, path)).withColumnRenamed("model", "model_type")
    return stores.registry_best(m.select("model_type", "station", "mae"))


STORE = (
    "fs AS (SELECT CAST(c_custkey % 40 AS DOUBLE)/4 + 10 AS latitude, CAST(c_custkey % 30 AS DOUBLE)/4 + 70 AS longitude, CAST(6*(1 + c_custkey % 4) AS INT) AS horizon, o_orderkey,"
    " o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def forecasts(spark, path):
    c = F.col("c_custkey")
    o = spark.read.parquet(f"{path}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    j = o.join(spark.read.parquet(f"{path}/customer.parquet").select("c_custkey"), F.col("o_custkey") == c)
    at = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    return j.select(
        ((c % 40).cast("double") / 4 + 10).alias("latitude"), ((c % 30).cast("double") / 4 + 70).alias("longitude"),
        (6 * (1 + c % 4)).cast("int").alias("horizon"), "o_orderkey", at.alias("created_at"),
    )


@query(
    "snk_forecast_store",
    "SELECT printf('pred_%.2f_%.2f_%d', latitude, longitude, horizon) AS cache_key, max(created_at) AS created_at, max(created_at) + INTERVAL 3600 SECOND AS expires_at FROM fs GROUP BY latitude, longitude, horizon",
    keys="cache_key created_at expires_at", ctes=STORE,
)
def snk_forecast_store(spark, path):
    f = forecasts(spark, path)
    old = stores.forecast_store(None, f.filter(F.col("o_orderkey") % 2 == 0))
    return stores.forecast_store(old, f.filter(F.col("o_orderkey") % 2 == 1))


@query(
    "src_forecast_store",
    "SELECT DISTINCT latitude, longitude, horizon, cache_key, e.at IS NOT NULL AS hit, e.at AS created_at FROM (SELECT *, printf('pred_%.2f_%.2f_%d', latitude, longitude, horizon) AS cache_key FROM fs)"
    " LEFT JOIN (SELECT printf('pred_%.2f_%.2f_%d', latitude, longitude, horizon) AS cache_key, max(created_at) AS at FROM fs GROUP BY 1 HAVING max(created_at) + INTERVAL 100 DAY >= TIMESTAMP '2001-09-01') e USING (cache_key)",
    keys="latitude longitude horizon cache_key hit created_at", ctes=STORE,
)
def src_forecast_store(spark, path):
    """Every place and horizon ever stored asks for its entry; entries live 100 days here, so some have expired."""
    f = forecasts(spark, path)
    store = stores.forecast_store(None, f, ttl=100 * 86400)
    requests = f.select("latitude", "longitude", "horizon").distinct()
    return stores.read_forecasts(store, requests, F.lit("2001-09-01").cast("timestamp_ntz"))


@query(
    "cache_key", "SELECT id, 'get_weather|lat:' || printf('%.2f', lat) || '|lon:' || printf('%.2f', lon) AS cache_key FROM points", keys="id cache_key",
)
def cache_key(spark, path):
    params = F.create_map(
        F.lit("lon"), F.format_string("%.2f", F.col("lon")), F.lit("lat"), F.format_string("%.2f", F.col("lat"))
    )
    return customer_points(spark, path).withColumn("cache_key", stores.cache_key(F.lit("get_weather"), params))


NOW = "2024-01-15 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    "cache_valid", f"SELECT event_id FROM events WHERE date_diff('second', date_trunc('second', ts), TIMESTAMP '{NOW}') < 900", keys="event_id",
)
def cache_valid(spark, path):
    e = spark.read.parquet(f"{path}/events.parquet").select("event_id", F.col("ts").alias("cached_at"))
    return stores.cache_valid(e, now())


CACHE = "ce AS (SELECT event_id, event_type, ts AS last_accessed, ts + INTERVAL 1 HOUR * (user_id % 50) AS expires_at FROM events)"


def cache_entries(spark, path):
    e = spark.read.parquet(f"{path}/events.parquet")
    return e.select(
        "event_id", "event_type", F.col("ts").alias("last_accessed"),
        (F.col("ts") + F.make_dt_interval(hours=(F.col("user_id") % 50).cast("int"))).alias("expires_at"),
    )


@query(
    "cache_stats",
    f"SELECT event_type, count(*) AS total_entries, count(*) FILTER (last_accessed > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS recent_hits, count(*) FILTER (expires_at < TIMESTAMP '{NOW}') AS expired_entries,"
    f" 100.0::DOUBLE*count(*) FILTER (last_accessed > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)/count(*) AS cache_hit_rate FROM ce GROUP BY 1",
    keys="event_type", ints="total_entries recent_hits expired_entries", nums="cache_hit_rate", ctes=CACHE,
)
def cache_stats(spark, path):
    return stores.cache_stats(cache_entries(spark, path), now(), by=["event_type"])


@query("cache_cleanup", f"SELECT event_id FROM ce WHERE expires_at >= TIMESTAMP '{NOW}'", keys="event_id", ctes=CACHE)
def cache_cleanup(spark, path):
    return stores.cache_cleanup(cache_entries(spark, path), now())


# ---- payload files written from the panel, one per station and day ------------------------------------------------


@query(
    "src_openmeteo_hourly",
    "SELECT ts, CASE WHEN humidity = 0 THEN 0 ELSE humidity END AS humidity, temperature, pressure, wind_speed, precipitation, latitude, longitude FROM located",
    keys="ts", nums="temperature humidity pressure wind_speed precipitation latitude longitude",
)
def src_openmeteo_hourly(spark, path):
    from wxspark.schema import BASE

    obs = located(panel(spark, path))
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    # A day of one station has at most 24 rows.
    days = obs.groupBy("latitude", "longitude", F.to_date("ts").alias("d")).agg(
        F.array_sort(F.collect_list(F.struct(text.alias("time"), *[F.col(c).alias(g) for c, g in zip(BASE, providers.GRID_FIELDS)]))).alias("h")
    )
    hourly = F.struct(*[F.col(f"h.{f}").alias(f) for f in ("time", *providers.GRID_FIELDS)])
    where = scratch(spark, "payload")
    days.select("latitude", "longitude", hourly.alias("hourly")).write.json(where)
    flat = stores.flatten_obs(providers.read_openmeteo_hourly(spark, where))
    return flat.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "src_weatherapi_history",
    "SELECT station, ts, temperature, wind_speed, latitude FROM located", keys="station ts", nums="temperature wind_speed latitude",
)
def src_weatherapi_history(spark, path):
    obs = located(panel(spark, path))
    hour = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), F.col("temperature").alias("temp_c"), "humidity",
        F.col("pressure").alias("pressure_mb"), (F.col("wind_speed") * 3.6).alias("wind_kph"),
        F.col("wind_direction").alias("wind_degree"), F.col("cloud_cover").alias("cloud"),
    )
    days = obs.groupBy("station", "latitude", "longitude", F.to_date("ts").alias("d")).agg(F.array_sort(F.collect_list(hour)).alias("hour"))
    place = F.struct(F.col("station").alias("name"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit("X").alias("country"))
    where = scratch(spark, "payload")
    days.select(place.alias("location"), F.struct(F.array(F.struct("hour")).alias("forecastday")).alias("forecast")).write.json(where)
    flat = stores.flatten_obs(providers.read_weatherapi_history(spark, where))
    return flat.withColumnRenamed("location_name", "station").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "src_owm_current", "SELECT station, ts, temperature, wind_speed, precipitation FROM located", keys="station ts", nums="temperature wind_speed precipitation",
)
def src_owm_current(spark, path):
    obs = located(panel(spark, path))
    rain = F.when(F.col("precipitation") > 0, F.struct(F.col("precipitation").alias("1h")))
    where = scratch(spark, "payload")
    obs.select(
        F.col("station").alias("name"), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("coord"),
        F.struct(F.lit("X").alias("country")).alias("sys"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct(F.col("temperature").alias("temp"), "humidity", "pressure").alias("main"),
        F.struct(F.col("wind_speed").alias("speed"), F.col("wind_direction").alias("deg")).alias("wind"),
        F.struct(F.col("cloud_cover").alias("all")).alias("clouds"), rain.alias("rain"),
    ).write.json(where)
    flat = stores.flatten_obs(providers.read_owm_current(spark, where))
    return flat.withColumnRenamed("location_name", "station").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- reports ------------------------------------------------------------------------------------------------------

CHART_SQL = " UNION ALL ".join(
    f"SELECT station, ts, '{n}' AS parameter, {c}*{k}::DOUBLE AS value, '{u}' AS unit, temperature-2 AS lower, temperature+2 AS upper, {lo if lo is not None else 'NULL'} AS axis_min, {hi if hi is not None else 'NULL'} AS axis_max FROM panel"
    for n, c, k, u, lo, hi in report.CHART_PARAMETERS
)


@query("sc_chart_series", CHART_SQL, keys="station ts parameter unit", nums="value lower upper axis_min axis_max")
def sc_chart_series(spark, path):
    t = F.col("temperature")
    return report.sc_chart_series(panel(spark, path).withColumns({"lower": t - 2, "upper": t + 2}))


@query(
    "limit_first_hours",
    "SELECT station, ts, temperature, CASE WHEN r = 1 THEN 'Now' ELSE '+' || (r-1) || 'h' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) AS r FROM panel) WHERE r <= 24",
    keys="station ts label", nums="temperature",
)
def limit_first_hours(spark, path):
    return report.limit_first_hours(panel(spark, path))


@query(
    "agg_system_health",
    "SELECT user_id, count(*) FILTER (t) AS healthy_models, count(*) AS total_models, CASE WHEN count(*) FILTER (t) = 0 THEN 'failed' WHEN count(*) FILTER (t) < count(*)*0.5 THEN 'degraded' ELSE 'healthy' END AS system_health"
    " FROM (SELECT user_id, event_id % 3 = 0 AS t FROM events) GROUP BY 1",
    keys="user_id system_health", ints="healthy_models total_models",
)
def agg_system_health(spark, path):
    e = spark.read.parquet(f"{path}/events.parquet").select("user_id", (F.col("event_id") % 3 == 0).alias("is_trained"))
    return report.agg_system_health(e, by=["user_id"])


@query(
    "agg_model_performance",
    "WITH m AS (SELECT station, model, avg(abs(prediction-actual)) AS mae FROM flog WHERE prediction IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT station, 'ensemble', avg(abs(prediction-actual)) FROM comb GROUP BY 1),"
    " rq2 AS (SELECT station, model0 AS model FROM (SELECT DISTINCT station FROM flog), (VALUES ('persist'), ('ensemble'), ('lstm')) r(model0))"
    " SELECT rq2.station, rq2.model, mae, CASE WHEN mae IS NOT NULL AND rq2.model <> 'ensemble' THEN coalesce(weight, 0) END AS weight, CASE WHEN rq2.model = 'ensemble' THEN 3 END AS weight_count,"
    " CASE WHEN mae IS NULL THEN 'Model not available or not trained' END AS message FROM rq2 LEFT JOIN m USING (station, model) LEFT JOIN weights USING (station, model)",
    keys="station model message", ints="weight_count", nums="mae weight", ctes=COMBINE,
)
def agg_model_performance(spark, path):
    log = log_table(spark, path)
    weights = E.en_performance(model_frame(log))
    m = E.en_metrics(log, weights).select("station", "model", "mae", "n")
    req = log.select("station").distinct().withColumn("model", F.explode(F.array(*[F.lit(x) for x in ("persist", "ensemble", "lstm")])))
    out = report.agg_model_performance(req, m, weights)
    return out.withColumn("weight_count", F.when(F.col("model_weights").isNotNull(), F.size("model_weights")))
