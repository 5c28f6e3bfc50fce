"""Session defaults."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword (``a__b`` for ``a.b``)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary one is set if all runs in one process (tests); on a
    cluster that is an error, for executors would not see it.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder in the shared one that holds all of this application's intermediate tables."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: once nothing reads a result that is still a plan over them."""
    drop_path(spark, scratch_root(spark))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
