"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only where the session names none and runs on this machine alone, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    found = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(sweep)
    _paths[found] = spark
    return found


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a written table, so that its lineage ends there and a lost executor costs nothing; and its path."""
    to = path(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to), to


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a path through Hadoop's file system; one that isn't there is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _paths.pop(where, None)


def sweep() -> None:
    """Deletes what path() named. Results are lazy and read these tables, so no DataFrame made before may be used after."""
    for where, spark in list(_paths.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone
            remove(spark, where)
        _paths.pop(where, None)
