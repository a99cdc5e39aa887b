"""Session helpers. Nothing here changes a session that the caller already configured."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a narrow table that make a part file worth its while: one to two megabytes.
PART_ROWS = 50_000


def build(master: str = "local[*]", app: str = "wxspark", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library expects: UTC, adaptive execution, Arrow for the few Python stages."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("WXSPARK_DRIVER_MEMORY", "8g"))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode with the setting unset (tests); elsewhere this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="wxspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so that a lost executor never restarts an iterative job."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Jobs that run inside send Python at most ``rows`` rows or about ``size`` bytes at once; a limit that the caller set stays as it is.

    By default a batch has 10000 rows: of long texts that is a whole input split, which the engine and the Python worker of every
    running task each hold in several copies.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    unset = [k for k in limits if spark.conf.get(k, None) is None]
    for k in unset:
        spark.conf.set(k, str(limits[k]))
    try:
        yield
    finally:
        for k in unset:
            spark.conf.unset(k)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a frame that several passes read to a table in the shared folder and read it back.

    The passes then scan a compact columnar table instead of repeating the work that made it, and survive lost executors.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows: int, label: str = "table") -> DataFrame:
    """``stored`` for a narrow table of about ``rows`` rows that comes out of a shuffle, in no more part files than it can fill.

    A part file costs its writer a folder, two files and a process for the permissions of each on a local disk, however few rows it
    has. Loops over small tables would pay that in every round for every shuffle partition.
    """
    return stored(df.coalesce(max(1, -(-rows // PART_ROWS))), label)
