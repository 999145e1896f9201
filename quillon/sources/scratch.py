"""Folders for intermediate tables that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where this session's own temporary folder is kept, if there is no checkpoint folder.
_OWN = "quillon.scratch.dir"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which goes when the application ends. Where that is unset and all runs on one machine (local
    masters), under a temporary folder that goes when Python ends; on a cluster executors wouldn't see such a folder: ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not root:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(_OWN, root)
    own = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (jvm := getattr(spark, "_jvm", None)) is not None:  # a remote session leaves the folder to whoever clears the root
        where = jvm.org.apache.hadoop.fs.Path(own)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{own}/data"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: its lineage is cut, and a second use doesn't work it out again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
