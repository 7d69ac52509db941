"""Session set-up and the two ways this package cuts a plan in pieces."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import NavigationError

# A side is broadcast by hand only when it was counted and stayed below this.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the session names."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise NavigationError(
            "INVALID_CONFIG", "Set spark.checkpoint.dir to a folder every executor can reach."
        )
    return named.rstrip("/")


def name_scratch(spark: SparkSession) -> None:
    """Give a local session that names no folder one, which goes when Python ends."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if not spark.sparkContext.master.startswith("local["):
        scratch_root(spark)
    made = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Unlike a cached frame the table outlives lost executors, keeps column
    pruning for its readers, and gives the planner its true size.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), "lodestone", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out a scan that is too small to occupy every core.

    Scans of many files already have enough splits and pass through unchanged.
    The deal is by key, so a task that is run again sees the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def collect_bounded(df: DataFrame, max_rows: int) -> list | None:
    """Rows of ``df``, or ``None`` when there are more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
