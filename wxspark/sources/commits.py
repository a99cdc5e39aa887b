"""Versions of several tables that appear at once.

A writer puts all tables of a version under a folder of its own and writes the version's manifest last. Readers look at manifests
only, so a version whose writer was killed does not exist for them, and one that exists is whole. A version is never written
twice; what killed writers left is removed by ``sweep``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.sources.stores import _fs

MANIFEST = "version string, created_at timestamp, tables array<string>, metadata map<string,string>"


def _manifest(root: str, version: str) -> str:
    return f"{root}/manifests/{version}"


def is_committed(spark: SparkSession, root: str, version: str) -> bool:
    # The marker of a finished write; the row itself is in place before it.
    fs, p = _fs(spark, f"{_manifest(root, version)}/_SUCCESS")
    return fs.exists(p)


def commit(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], *, created_at=None, metadata: dict[str, str] | None = None) -> None:
    """Write ``tables`` and make them visible together. Raises if the version is there already."""
    if is_committed(spark, root, version):
        raise ValueError(f"version {version} is there already")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/tables/{version}/{name}")
    when = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    row = spark.createDataFrame([(version, None, list(tables), dict(metadata or {}))], MANIFEST).withColumn("created_at", when)
    row.coalesce(1).write.mode("overwrite").parquet(_manifest(root, version))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all whole versions."""
    fs, p = _fs(spark, f"{root}/manifests")
    found = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    whole = [_manifest(root, v) for v in found if is_committed(spark, root, v)]
    return spark.read.schema(MANIFEST).parquet(*whole) if whole else spark.createDataFrame([], MANIFEST)


def newest_version(spark: SparkSession, root: str) -> str | None:
    row = versions(spark, root).orderBy(F.desc("created_at"), F.desc("version")).first()
    return None if row is None else row["version"]


def read(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table of one version (default: the newest)."""
    version = version or newest_version(spark, root)
    if version is None or not is_committed(spark, root, version):
        raise LookupError(f"no version {version or ''} under {root}")
    return spark.read.parquet(f"{root}/tables/{version}/{table}")


def read_all(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A table's rows of all whole versions with their ``version``; None without any."""
    rows = versions(spark, root).filter(F.array_contains("tables", table)).select("version").collect()  # one row per version
    parts = [read(spark, root, table, r["version"]).withColumn("version", F.lit(r["version"])) for r in rows]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Remove tables without a manifest and return their versions. Not while a writer is at work."""
    fs, p = _fs(spark, f"{root}/tables")
    found = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    left = [v for v in found if not is_committed(spark, root, v)]
    for v in left:
        fs.delete(_fs(spark, f"{root}/tables/{v}")[1], True)
        fs.delete(_fs(spark, _manifest(root, v))[1], True)
    return left
