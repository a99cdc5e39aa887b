"""Registry of queries and of the SQL each one is checked against.

A query returns its key columns as they are, its integer columns as BIGINT and its measures rounded to six decimals
after a shift of 1e-9, which keeps exact ties from rounding apart in two engines. The SQL gets the same final
projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PANEL_SQL = """
b AS (SELECT event_type AS station, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) AS n,
             sum(CAST(round(value*100) AS BIGINT)) AS cents, sum(user_id) AS u, sum(event_id) AS e,
             sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k
      FROM events GROUP BY 1, 2),
panel_n AS (SELECT station, ts, n, e,
       CAST(cents AS DOUBLE)/(100*n)*0.5-5 AS temperature, CAST(k AS DOUBLE)/n AS humidity,
       990+CAST(u%50 AS DOUBLE) AS pressure, CAST(e%200 AS DOUBLE)/10 AS wind_speed,
       CAST(e%361 AS DOUBLE) AS wind_direction, CAST(u%101 AS DOUBLE) AS cloud_cover,
       CASE WHEN n%4=0 THEN CAST(k%60 AS DOUBLE) ELSE 0.0::DOUBLE END AS precipitation FROM b),
panel AS (SELECT station, ts, temperature, humidity, pressure, wind_speed, wind_direction, cloud_cover, precipitation
          FROM panel_n),
gaps AS (SELECT station, ts, CASE WHEN n = 1 AND e % 7 = 0 THEN NULL ELSE temperature END AS temperature,
                humidity, pressure, wind_speed, wind_direction, cloud_cover, precipitation FROM panel_n),
located AS (SELECT *, 8 + (ascii(station)*37 % 280)/10.0::DOUBLE AS latitude,
                   68 + (ascii(station)*53 % 270)/10.0::DOUBLE AS longitude FROM panel),
points AS (SELECT c_custkey AS id, 8 + (c_custkey % 2800)/100.0::DOUBLE AS lat,
                  68 + (c_custkey*7 % 2700)/100.0::DOUBLE AS lon FROM customer),
naive AS (SELECT station, ts, temperature AS actual, lag(temperature, 1) OVER w AS persist,
                 lag(temperature, 24) OVER w AS daily,
                 CASE WHEN count(*) OVER p = 6 THEN avg(temperature) OVER p END AS mean6
          FROM panel WINDOW w AS (PARTITION BY station ORDER BY ts),
               p AS (PARTITION BY station ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
flog AS (SELECT station, ts, 'temperature' AS target, actual, 'persist' AS model, persist AS prediction FROM naive
         UNION ALL SELECT station, ts, 'temperature', actual, 'daily', daily FROM naive
         UNION ALL SELECT station, ts, 'temperature', actual, 'mean6', mean6 FROM naive)
"""


def final(df: DataFrame, keys, ints, nums, digits=6) -> DataFrame:
    return df.selectExpr(
        *keys,
        *[f"CAST({c} AS BIGINT) AS {c}" for c in ints],
        *[f"round(CAST({c} AS DOUBLE) + 1e-9D, {digits}) + 0.0D AS {c}" for c in nums],
    )


def query(name: str, sql: str | None = None, *, keys="", ints="", nums="", digits: int = 6, ctes: str = ""):
    """Register a query. ``sql`` is the body of a CTE over ``panel`` and friends (see PANEL_SQL); without it the query
    is checked by rows only. Column lists are space-separated."""
    keys, ints, nums = keys.split(), ints.split(), nums.split()

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, path: str) -> DataFrame:
            out = fn(spark, path)
            return final(out, keys, ints, nums, digits) if keys or ints or nums else out

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            cols = [*keys, *[f"CAST({c} AS BIGINT) AS {c}" for c in ints]]
            cols += [f"round(CAST({c} AS DOUBLE) + 1e-9, {digits}) + 0.0::DOUBLE AS {c}" for c in nums]
            extra = f", {ctes}" if ctes else ""
            ORACLES[name] = f"WITH {PANEL_SQL}{extra}, result AS ({sql}) SELECT {', '.join(cols)} FROM result"
        return fn

    return wrap
