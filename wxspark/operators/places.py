"""Spatial lookups, place search and provider choice, batched as joins and grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wxspark.functions.geo import CITIES, CITY_COUNTRY, EARTH_KM, haversine
from wxspark.functions.labels import location_name
from wxspark.operators.timeline import count_small, join_small, measure
from wxspark.schema import TS
from wxspark.session import stored

_DEGREE_KM = EARTH_KM * math.pi / 180


#: Rows of a grid cell from which they are spread over several join keys.
CROWD = 1_000_000


def _grid(x: Column, cell: float) -> Column:
    return F.floor(x / F.lit(cell)).cast("long")


def join_band(
    requests: DataFrame, rows: DataFrame, *, tol: float = 0.1, ts: str = TS, start: str | None = None, end: str | None = None,
    how: str = "inner", salt: int | None = None, crowd: int = CROWD,
) -> DataFrame:
    """Rows within ``tol`` degrees of each request point (id, lat, lon), and between its ``start`` and ``end`` columns.

    A range condition alone would compare everything with everything. Both sides are put on a grid of cells a little
    wider than ``tol``; each request goes to its 3x3 neighbour cells and meets only the rows of those cells. A cell with
    more than ``crowd`` rows is spread over as many join keys as it holds ``crowd`` rows, and only the requests near it are
    copied to each; ``salt`` sets one number of keys for all cells instead and saves counting them.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    cell = tol * 1.001
    near = lambda c: F.sequence(_grid(c, cell) - 1, _grid(c, cell) + 1)
    asked = requests.withColumn("_gy", F.explode(near(F.col("lat")))).withColumn("_gx", F.explode(near(F.col("lon"))))
    placed = rows.withColumns({"_gy": _grid(F.col("latitude"), cell), "_gx": _grid(F.col("longitude"), cell)})
    if salt is None:
        counts = placed.groupBy("_gy", "_gx").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowd)
        crowded = stored(counts.select("_gy", "_gx", F.ceil(F.col("_n") / crowd).cast("int").alias("_salts")), "crowded")
        n = count_small(crowded)
        salts = F.coalesce("_salts", F.lit(1))
        asked = join_small(asked, crowded, ["_gy", "_gx"], n)
        placed = join_small(placed, crowded, ["_gy", "_gx"], n)
    else:
        salts = F.lit(salt)
    asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_salts")
    ok = F.col("latitude").between(F.col("lat") - tol, F.col("lat") + tol)
    ok = ok & F.col("longitude").between(F.col("lon") - tol, F.col("lon") + tol)
    if start:
        ok = ok & (F.col(ts) >= F.col(start))
    if end:
        ok = ok & (F.col(ts) <= F.col(end))
    met = asked.join(placed, ["_gy", "_gx", "_salt"]).filter(ok).drop("_gy", "_gx", "_salt")
    if how == "inner":
        return met
    alone = requests.join(met.select("id").distinct(), "id", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def nearest_builtin_city(df, *, lat="lat", lon="lon", max_km: float = 100.0) -> DataFrame:
    """Add ``city`` (struct distance_km, rank, name, region, country), the nearest of the fixed list below ``max_km``.

    The list is a literal of fixed size, so no join is planned at all.
    """
    options = [
        F.struct(
            haversine(F.col(lat), F.col(lon), F.lit(a), F.lit(o)).alias("distance_km"),
            F.lit(i).alias("rank"),
            F.lit(n).alias("name"),
            F.lit(r).alias("region"),
            F.lit(CITY_COUNTRY).alias("country"),
        )
        for i, (n, a, o, r) in enumerate(CITIES, 1)
    ]
    best = df.withColumn("_best", F.least(*options))
    return best.withColumn("city", F.when(F.col("_best")["distance_km"] < max_km, F.col("_best"))).drop("_best")


def join_nearest_city(
    points: DataFrame, cities: DataFrame | None = None, *, max_km: float = 100.0
) -> DataFrame:
    """Nearest city of each point (id, lat, lon) strictly below ``max_km``: id, lat, lon, city, distance_km (null when
    none is close).

    Any city table works: every city is copied to the one-degree cells within reach, points meet only the cities of
    their own cell, and the nearest is a grouped minimum with map-side combine.
    """
    if cities is None:
        found = nearest_builtin_city(points, max_km=max_km)
        return found.select("id", "lat", "lon", F.col("city.name").alias("city"), F.col("city.distance_km").alias("distance_km"))
    reach = max_km / _DEGREE_KM * 1.001
    # Degrees of longitude that max_km can span at a latitude; near a pole that is the whole circle.
    top = F.least(F.abs(F.col("lat")) + reach, F.lit(90.0))
    ratio = F.try_divide(F.sin(F.radians(F.lit(reach))), F.cos(F.radians(F.abs(F.col("lat")))))
    span = F.when((top >= 89.9) | (ratio >= 1) | ratio.isNull(), F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)))
    west, east = F.floor(F.col("lon") - span), F.floor(F.col("lon") + span)
    wrap = lambda x: F.pmod(x + 180, F.lit(360)).cast("long")
    reachable = (
        cities.withColumn("_gy", F.explode(F.sequence(F.floor(F.col("lat") - reach), F.floor(F.col("lat") + reach))))
        .withColumn("_gx", F.explode(F.array_distinct(F.transform(F.sequence(west, east), wrap))))
        .select("_gy", "_gx", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "name", "rank")
    )
    placed = points.withColumns({"_gy": F.floor("lat"), "_gx": wrap(F.floor("lon"))})
    pairs = join_small(placed, reachable, ["_gy", "_gx"], count_small(reachable), "left")
    km = haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    choice = F.when(km < max_km, F.struct(km.alias("distance_km"), "rank", "name"))
    best = pairs.groupBy("id", "lat", "lon").agg(F.min(choice).alias("b"))
    return best.select("id", "lat", "lon", F.col("b.name").alias("city"), F.col("b.distance_km").alias("distance_km"))


def reverse_geocode(points: DataFrame, geocoded: DataFrame, *, max_km: float = 100.0) -> DataFrame:
    """Geocoder answer (id, name, country, region) if there is one, else the nearest built-in city, else a generated
    name with an unknown country."""
    hits = geocoded.select("id", F.struct("name", "country", "region").alias("hit"))
    found = nearest_builtin_city(points, max_km=max_km).join(hits, "id", "left")
    none = F.lit(None).cast("string")
    place = F.coalesce(
        F.col("hit"),
        F.when(F.col("city").isNotNull(), F.struct("city.name", "city.country", "city.region")),
        F.struct(
            location_name(F.col("lat"), F.col("lon")).alias("name"), F.lit("Unknown").alias("country"), none.alias("region")
        ),
    )
    return found.withColumn("p", place).select("id", "lat", "lon", "p.name", "p.country", "p.region")


# ---- search -------------------------------------------------------------------------------------------------------


def union_search(*results: DataFrame) -> DataFrame:
    """Provider results one after the other: adds ``priority`` (argument order). Each needs query, rank and places."""
    out = None
    for i, r in enumerate(results):
        r = r.withColumn("priority", F.lit(i))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    return out


def _first_per_place(results: DataFrame, order: Sequence[str], digits: int, lat: str, lon: str) -> DataFrame:
    """Smallest row by ``order`` of each rounded place and query: a grouped minimum that combines before the shuffle."""
    rest = [c for c in results.columns if c != "query" and c not in order]
    best = results.groupBy("query", F.round(lat, digits).alias("_y"), F.round(lon, digits).alias("_x")).agg(
        F.min(F.struct(*order, *rest)).alias("r")
    )
    return best.select("query", "r.*")


def _top(results: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """First rows of each query with ``position``. Every task keeps only its own first rows before the shuffle."""
    w = Window.partitionBy("query").orderBy(*order)
    return results.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def dedup_coords(results: DataFrame, *, limit: int | None = None, lat="lat", lon="lon", digits: int = 2) -> DataFrame:
    """First result of each rounded place per query; with ``limit`` also the first places only, numbered by ``position``."""
    order = ["priority", "rank"]
    first = _first_per_place(results, order, digits, lat, lon)
    return first if limit is None else _top(first, order, limit)


def with_home(results: DataFrame) -> DataFrame:
    """``home`` is 0 for Indian places and 1 for others."""
    return results.withColumn("home", F.when(F.lower("country").isin("india", "in"), 0).otherwise(1))


def india_first(results: DataFrame) -> DataFrame:
    """Indian places in front, otherwise the order of the results (a distributed sort)."""
    return with_home(results).orderBy("query", "home", "priority", "rank")


def _city_options() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(o).alias("lon"),
                F.lit(CITY_COUNTRY).alias("country"), F.lit(r).alias("region"),
            )
            for i, (n, a, o, r) in enumerate(CITIES, 1)
        ]
    )


def match_cities(queries: DataFrame) -> DataFrame:
    """Built-in cities whose name holds the query text; a query under two characters shows them all."""
    text = F.lower("query")
    hit = lambda c: (F.length("query") < 2) | F.contains(F.lower(c["name"]), text)
    return queries.select("query").distinct().select("query", F.inline(F.filter(_city_options(), hit)))


def search_locations(queries: DataFrame, *provider_results: DataFrame, limit: int = 10, digits: int = 2) -> DataFrame:
    """Cities that match, then the provider results (India first), one per rounded place, up to ``limit`` a query."""
    order = ["step", "home", "priority", "rank"]
    everything = match_cities(queries).withColumns({"step": F.lit(0), "home": F.lit(0), "priority": F.lit(0)})
    if provider_results:
        merged = with_home(dedup_coords(union_search(*provider_results), digits=digits)).withColumn("step", F.lit(1))
        everything = everything.unionByName(merged, allowMissingColumns=True)
    return _top(_first_per_place(everything, order, digits, "lat", "lon"), order, limit)


def limit_cities(requests: DataFrame, *, limit: str = "limit") -> DataFrame:
    """The first ``limit`` built-in cities for each request."""
    return requests.withColumn("cities", F.slice(_city_options(), F.lit(1), F.col(limit).cast("int")))


# ---- providers ----------------------------------------------------------------------------------------------------


def agg_provider_health(
    log: DataFrame, *, ts: str = TS, as_of=None, unhealthy_at: int = 3, reset_after: int = 300
) -> DataFrame:
    """State of each provider from its request log (provider, ts, success), as of a time (default: the newest entry).

    Failures after the last success are counted with two small aggregates; no log of one provider is ever sorted.
    """
    last = log.groupBy("provider").agg(F.max(F.when(F.col("success"), F.col(ts))).alias("_ok"))
    last = last.withColumnRenamed("provider", "_p")
    marked = join_small(log, last.withColumnRenamed("_p", "provider"), ["provider"], measure(log, "provider").series)
    after = ~F.col("success") & (F.col("_ok").isNull() | (F.col(ts) > F.col("_ok")))
    g = marked.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.count_if(after).alias("_failures"),
        F.max(F.when(~F.col("success"), F.col(ts))).alias("last_failure"),
        F.max(ts).alias("_seen"),
    )
    everything = Window.partitionBy(F.lit(0))
    now = F.max("_seen").over(everything) if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    down = F.col("_failures") >= unhealthy_at
    reset = down & (seconds(F.col("_now")) - seconds(F.col("last_failure")) > reset_after)
    g = g.withColumn("_now", now).withColumns(
        {
            "consecutive_failures": F.when(reset, F.lit(0).cast("long")).otherwise(F.col("_failures")),
            "is_healthy": ~down | reset,
        }
    )
    return g.withColumn("healthy_count", F.count_if("is_healthy").over(everything)).drop("_failures", "_seen", "_now")


def provider_fallback(
    observations: DataFrame, health: DataFrame, *, keys: Sequence[str] = ("station", TS)
) -> DataFrame:
    """One observation per key: the first healthy provider by priority, any provider when all are down."""
    state = health.select("provider", "is_healthy")
    o = join_small(observations, state, ["provider"], count_small(state))
    rest = [c for c in observations.columns if c not in (*keys, "priority")]
    up = F.coalesce("is_healthy", F.lit(True))
    best = F.min(F.struct((~up).alias("_down"), "priority", *rest))
    return o.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.priority", *[f"b.{c}" for c in rest])


def coverage_gate(obs: DataFrame, fetched: DataFrame, days: int, *, station: str = "station", per_day: int = 20) -> DataFrame:
    """Stored rows where they suffice (days * 20), else the fetched ones, else the stored ones after all.

    Adds ``origin``: stored, fetched or fallback.
    """
    have = obs.groupBy(station).agg((F.count(F.lit(1)) >= days * per_day).alias("_enough"))
    new = fetched.groupBy(station).agg(F.lit(True).alias("_new"))
    plan = have.join(new, station, "full").select(
        station,
        F.when(F.coalesce("_enough", F.lit(False)), "stored").when(F.col("_new"), "fetched").otherwise("fallback").alias("origin"),
    )
    n = measure(obs, station).series + measure(fetched, station).series
    kept = join_small(obs, plan.filter("origin <> 'fetched'"), [station], n, "inner")
    more = join_small(fetched, plan.filter("origin = 'fetched'"), [station], n, "inner")
    return kept.unionByName(more, allowMissingColumns=True)
