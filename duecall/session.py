"""Session settings the column functions rely on, and the shared scratch folder."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# All runtime settings: a session handed in by the caller can take them.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # a repeated key keeps its last value instead of making the whole object unreadable
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # what a Python worker holds at once does not grow with the partitions
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name for files and stream checkpoints that all executors must see.

    It lies under ``spark.checkpoint.dir``. Only a local session without that setting gets a
    machine-local folder; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="duecall-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, fixed from then on, and
    safe if an executor that computed a part of it is lost."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Sends Python packages to the executors, whose workers import them by name."""
    context = spark.sparkContext
    for package in packages:
        if (context.applicationId, package) in _shipped:
            continue
        root = os.path.dirname(importlib.import_module(package).__file__)
        target = os.path.join(tempfile.mkdtemp(prefix="duecall-ship-"), package)
        archive = shutil.make_archive(target, "zip", os.path.dirname(root), package)
        context.addPyFile(archive)
        _shipped.add((context.applicationId, package))
