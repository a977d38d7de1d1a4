"""Session settings this package is measured with."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # build large plans without a stack trace per column
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # mails are large values: few rows per Arrow batch, bounded in bytes as well
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def local_session(cpus: int | str = "*", app: str = "lurewatch", **settings: str) -> SparkSession:
    """A local session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
    )
    spread = {} if cpus == "*" else {"spark.lurewatch.spread": str(cpus)}
    for key, value in {**SETTINGS, **spread, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_settings(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS to a session that was made elsewhere, and gives its workers this package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once: they may run anywhere."""
    context = spark.sparkContext
    if getattr(context, "_lurewatch_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lurewatch-"), "lurewatch.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.join("lurewatch", os.path.relpath(path, here)))
    context.addPyFile(archive)
    context._lurewatch_shipped = True
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder of this application below the cluster's `spark.checkpoint.dir`.

    Where that is unset, below `spark.sql.warehouse.dir`, if that is no folder of one
    machine or the session runs on one machine only. `remove_folders` deletes them all.
    """
    return f"{_own_folder(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def _own_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir")
        one_machine = spark.sparkContext.master.split("[")[0] == "local"
        if not one_machine and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{root.rstrip('/')}/lurewatch/{spark.sparkContext.applicationId}"


def remove_folders(spark: SparkSession) -> None:
    """Deletes this application's shared folders, and with them the tables its results read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
