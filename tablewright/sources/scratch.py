"""Folders for tables that a plan writes on the way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from tablewright.errors import UserError


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that the driver and all executors reach: under ``spark.checkpoint.dir``, or local in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise UserError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return f"{path}/{name}-{uuid.uuid4().hex}"
