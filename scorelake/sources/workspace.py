"""Where intermediate tables go: a folder every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; where it names none, one in its warehouse.

    A folder that only one machine sees is never taken: a warehouse on a local disk, which is the default,
    serves only where all of Spark runs on that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_shared"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, as Spark understands it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, possibly with wildcards, exists on its file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(where)
    return found is not None and len(found) > 0
