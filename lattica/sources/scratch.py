"""A folder for files that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_temporary: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, in local runs only, under a temporary folder that goes with the process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _temporary:
            _temporary.append(tempfile.mkdtemp(prefix="lattica-files-"))
            atexit.register(shutil.rmtree, _temporary[0], ignore_errors=True)
        at = _temporary[0]
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
