"""Intermediate tables in the folder that the cluster names in ``spark.checkpoint.dir``.

A table written there cuts lineage and outlives any executor. Columnar files are smaller than
reliable RDD checkpoints and can be pruned when they are read again.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder. Only where none is set (tests, local mode) a temporary one is used."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + os.path.join(tempfile.gettempdir(), "inkwell-scratch")
    return found


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{folder(spark)}/inkwell-{label}-{uuid.uuid4().hex}"
    _LIVE[path] = spark
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables behind frames that save() returned."""
    for df in frames:
        path = getattr(df, "_inkwell_path", None)
        if path in _LIVE:
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)
            _LIVE.pop(path, None)


def free(spark: SparkSession) -> None:
    """Delete the shuffle files and broadcasts of finished jobs: Spark does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop_all() -> None:
    for path, spark in list(_LIVE.items()):
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            pass


atexit.register(_drop_all)
