"""Session settings, the shared work folder, and the package on the executors."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyglass")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables, below ``spark.checkpoint.dir``.

    The setting names storage every executor can reach.  Only a local session
    without the setting gets a temporary folder of its own.  All folders of an
    application lie below one with its id: results read from them lazily, so they
    can go once the application has ended.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="tallyglass-")
        context.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/tallyglass/{context.applicationId}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table once and read it back, so that later uses do not recompute it."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@functools.cache
def _package() -> str:
    """A ZIP of this package, built once per driver process."""
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tallyglass-"), "tallyglass.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(here)))
    return target


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application.

    Python workers import it from there, whatever their working folder.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        context.addPyFile(_package())
        _shipped.add(context.applicationId)


def give_back() -> None:
    """Return memory that a Python worker no longer uses to the system, at the end of a task."""
    pa.default_memory_pool().release_unused()
    # Only some C libraries, Linux's usual one among them, keep freed memory and have this call.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
