"""Session settings the jobs are written for, and folders for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.session.timeZone": "UTC",
}


def session(app_name: str = "citetrust") -> SparkSession:
    """A session with the settings above; sizes (executors, shuffle partitions) are the cluster's."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``, which has to be set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/citetrust-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """A folder that ``scratch_folder`` named, if it is there, is deleted with all it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scratch folder for one job, which is removed when the job is done."""
    folder = scratch_folder(spark)
    try:
        yield folder
    finally:
        remove(spark, folder)
