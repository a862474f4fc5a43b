"""Scratch folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import StoreError


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir (where that is unset and all run on one machine, as in tests, under a
    temporary folder), deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wavelark-")
    path = f"{base.rstrip('/')}/wavelark-{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
