"""Tables of observations, training snapshots, models and forecasts on Parquet.

Stores only append. "Active", "deactivated" and "replaced" are read as the newest state of a key, so writers never
rewrite what readers see; cleaning writes a new table next to the old one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wxspark.operators.quality import bbox_filter
from wxspark.schema import BASE

KEY = ["latitude", "longitude", "ts"]
CACHE_TTL, FORECAST_TTL = 900, 3600
RETENTION_DAYS = 30


def _ordered(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that can be compared; they settle ties in a fixed way."""
    return [c for c in columns if not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType))]


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


# ---- observations -------------------------------------------------------------------------------------------------


def flatten_obs(nested: DataFrame) -> DataFrame:
    """Nested observations to flat columns; missing precipitation counts as 0."""
    measures = [F.coalesce(c, F.lit(0.0)).alias(c) if c == "precipitation" else F.col(c) for c in BASE]
    return nested.select(
        F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"),
        F.col("location.name").alias("location_name"), F.col("location.country").alias("country"),
        F.col("location.region").alias("region"), F.col("timestamp").alias("ts"), *measures,
    )


def select_obs(obs: DataFrame, lat: float, lon: float, start, end, *, tol: float = 0.1) -> DataFrame:
    """Rows around a point and inside a time range, defaults filled, in time order."""
    near = bbox_filter(obs, lat, lon, tol=tol).filter(F.col("ts").between(F.lit(start), F.lit(end)))
    if "country" in near.columns:
        near = near.withColumn("country", F.coalesce("country", F.lit("Unknown")))
    return near.withColumn("precipitation", F.coalesce("precipitation", F.lit(0.0))).orderBy("ts")


def read_obs(spark: SparkSession, path: str, lat: float, lon: float, start, end, *, tol: float = 0.1) -> DataFrame:
    return select_obs(spark.read.parquet(path), lat, lon, start, end, tol=tol)


def new_rows(incoming: DataFrame, stored: DataFrame, *, source: str, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Incoming rows whose key is not stored, one per key, tagged with their source."""
    rest = [c for c in incoming.columns if c not in key and c != "data_source"]
    one = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*")
    return one.join(stored.select(*key), list(key), "left_anti").withColumn("data_source", F.lit(source))


def upsert_obs(spark: SparkSession, incoming: DataFrame, path: str, *, source: str) -> None:
    """Append the rows that are new. The stored side is cut to the days of the batch before the join."""
    fs, place = _fs(spark, path)
    there = fs.exists(place) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(place))
    stored = spark.read.parquet(path) if there else None
    if stored is None:
        fresh = new_rows(incoming, incoming.limit(0), source=source)
    else:
        days = incoming.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
        fresh = new_rows(incoming, stored.filter(F.col("day").between(days["a"], days["b"])).drop("day"), source=source)
    fresh.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


# ---- training snapshots -------------------------------------------------------------------------------------------


def write_snapshot(
    samples: DataFrame, path: str, *, snapshot_id: str, model: str, lat: float, lon: float, created_at,
    features: Sequence[str], config: dict[str, str] | None = None,
) -> None:
    """Samples as real columns under the snapshot's own partition, and one header row."""
    spark = samples.sparkSession
    samples.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(f"{path}/samples")
    head = spark.createDataFrame(
        [(snapshot_id, model, lat, lon, created_at, list(features), dict(config or {}))],
        "snapshot_id string, model string, latitude double, longitude double, created_at timestamp, features array<string>,"
        " config map<string,string>",
    )
    head.write.mode("append").parquet(f"{path}/headers")


def active_snapshots(headers: DataFrame) -> DataFrame:
    """The newest snapshot of each model and place; every older one is inactive by that."""
    keys = ["model", "latitude", "longitude"]
    rest = [c for c in headers.columns if c not in keys]
    return headers.groupBy(*keys).agg(F.max_by(F.struct(*rest), "created_at").alias("h")).select(*keys, "h.*")


def read_snapshot(spark: SparkSession, path: str, model: str, lat: float, lon: float) -> DataFrame:
    heads = spark.read.parquet(f"{path}/headers").filter(
        (F.col("model") == model) & (F.col("latitude") == lat) & (F.col("longitude") == lon)
    )
    # One header row; its id prunes the sample partitions.
    newest = active_snapshots(heads).select("snapshot_id")
    return spark.read.parquet(f"{path}/samples").join(F.broadcast(newest), "snapshot_id").drop("snapshot_id")


# ---- model registry -----------------------------------------------------------------------------------------------

REGISTRY = (
    "model_id string, model_type string, version string, latitude double, longitude double, created_at timestamp,"
    " changed_at timestamp, hyperparameters map<string,string>, features array<string>, targets array<string>,"
    " mae double, rmse double, mape double, path string, size_bytes long, is_active boolean, is_trained boolean"
)


def registry_append(spark: SparkSession, rows, path: str) -> None:
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, REGISTRY)
    df.write.mode("append").parquet(path)


def registry_state(log: DataFrame) -> DataFrame:
    """Newest state of each model."""
    rest = [c for c in log.columns if c != "model_id"]
    return log.groupBy("model_id").agg(F.max_by(F.struct(*rest), "changed_at").alias("s")).select("model_id", "s.*")


def registry_active(log: DataFrame, lat: float, lon: float, *, tol: float = 0.1) -> DataFrame:
    """Active and trained models around a point, newest first."""
    return registry_state(bbox_filter(log, lat, lon, tol=tol)).filter("is_active AND is_trained").orderBy(F.desc("created_at"))


def registry_deactivate(log: DataFrame, lat: float, lon: float, at, *, model_type: str | None = None, tol: float = 0.1) -> DataFrame:
    """Tombstone rows to append: the active models around a point, optionally of one type."""
    hit = registry_state(bbox_filter(log, lat, lon, tol=tol)).filter("is_active")
    if model_type is not None:
        hit = hit.filter(F.col("model_type") == model_type)
    return hit.withColumns({"is_active": F.lit(False), "changed_at": F.lit(at).cast(log.schema["changed_at"].dataType)})


def registry_best(models: DataFrame, *, keys: Sequence[str] = ("model_type",)) -> DataFrame:
    """Lowest error per type; a model without an error comes last."""
    rest = [c for c in models.columns if c not in keys]
    rank = F.struct(F.col("mae").isNull().alias("_none"), F.col("mae").alias("_mae"), *_ordered(models, rest))
    return models.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("b")).select(*keys, *[f"b.{c}" for c in rest])


def model_cleanup(log: DataFrame, now, *, days: int = RETENTION_DAYS) -> DataFrame:
    """The log without models that are inactive and older than ``days``."""
    stale = registry_state(log).filter(
        ~F.col("is_active") & (F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    )
    return log.join(stale.select("model_id"), "model_id", "left_anti")


# ---- saved models -------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_model(params: DataFrame, root: str, name: str, metadata: dict[str, str] | None = None) -> None:
    """Coefficients, rules or weights as Parquet with a metadata row beside them."""
    params.write.mode("overwrite").parquet(f"{root}/{name}/params")
    spark = params.sparkSession
    meta = spark.createDataFrame([(name, dict(metadata or {}))], "name string, metadata map<string,string>")
    meta.write.mode("overwrite").parquet(f"{root}/{name}/meta")


def load_model(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict[str, str]]:
    meta = spark.read.parquet(f"{root}/{name}/meta").first()["metadata"]
    return spark.read.parquet(f"{root}/{name}/params"), dict(meta)


def model_exists(spark: SparkSession, root: str, name: str) -> bool:
    fs, p = _fs(spark, f"{root}/{name}/meta/_SUCCESS")
    return fs.exists(p)


def list_models(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if model_exists(spark, root, s.getPath().getName()))


def delete_model(spark: SparkSession, root: str, name: str) -> bool:
    fs, p = _fs(spark, f"{root}/{name}")
    return fs.delete(p, True)


# ---- forecast store -----------------------------------------------------------------------------------------------


def forecast_key(lat: Column, lon: Column, hours: Column) -> Column:
    return F.format_string("pred_%.2f_%.2f_%d", lat, lon, hours)


def forecast_store(stored: DataFrame | None, new: DataFrame, *, ttl: int = FORECAST_TTL) -> DataFrame:
    """Newest entry per place and horizon, with its key and expiry. Needs latitude, longitude, horizon, created_at."""
    keys = ["latitude", "longitude", "horizon"]
    tagged = new.withColumn("cache_key", forecast_key(F.col("latitude"), F.col("longitude"), F.col("horizon"))).withColumn(
        "expires_at", F.col("created_at") + F.expr(f"INTERVAL {ttl} SECONDS")
    )
    both = tagged if stored is None else stored.unionByName(tagged, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col("created_at").alias("_at"), *_ordered(both, rest)))
    return both.groupBy(*keys).agg(newest.alias("e")).select(*keys, *[f"e.{c}" for c in rest])


def read_forecasts(store: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """The unexpired entry of each requested place and horizon; ``hit`` says whether there is one.

    ``requests`` has latitude, longitude and horizon; places count as the same when their keys are. Of several places with
    one key the newest entry is taken.
    """
    key = forecast_key(F.col("latitude"), F.col("longitude"), F.col("horizon"))
    rest = [c for c in store.columns if c not in ("latitude", "longitude", "horizon", "cache_key")]
    alive = store.filter(F.col("expires_at") >= now).groupBy("cache_key").agg(F.max_by(F.struct(*rest), "created_at").alias("e"))
    asked = requests.select("latitude", "longitude", "horizon", key.alias("cache_key"))
    found = asked.join(alive, "cache_key", "left")
    return found.select("latitude", "longitude", "horizon", "cache_key", F.col("e").isNotNull().alias("hit"), *[f"e.{c}" for c in rest])


def cache_key(method: Column, params: Column) -> Column:
    """method|name:value|... with the parameters (a string map) sorted by name."""
    entries = F.array_sort(F.map_entries(params))
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.concat_ws("|", method, parts)


def cache_valid(entries: DataFrame, now: Column, *, ttl: int = CACHE_TTL, at: str = "cached_at") -> DataFrame:
    return entries.filter(_seconds(now) - _seconds(F.col(at)) < ttl)


def cache_stats(entries: DataFrame, now: Column, *, by: Sequence[str] = ()) -> DataFrame:
    """total_entries, recent_hits (last hour), expired_entries, cache_hit_rate in percent (0 when empty)."""
    total = F.count(F.lit(1))
    recent = F.count_if(F.col("last_accessed") > now - F.expr("INTERVAL 1 HOUR"))
    out = entries.groupBy(*by).agg(
        total.alias("total_entries"), recent.alias("recent_hits"), F.count_if(F.col("expires_at") < now).alias("expired_entries")
    )
    rate = F.coalesce(F.try_divide(F.col("recent_hits") * F.lit(100.0), F.col("total_entries").cast("double")), F.lit(0.0))
    return out.withColumn("cache_hit_rate", rate)


def cache_cleanup(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired; write them to a new table."""
    return entries.filter(~(F.col("expires_at") < now))
