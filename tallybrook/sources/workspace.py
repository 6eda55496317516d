"""Folders for tables that a job writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path not used before, in the folder that all executors share.

    Where none is named, a temporary folder serves in local mode only: on a cluster the executors
    could not see each other's files.
    """
    root = spark.conf.get(SHARED_FOLDER, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED_FOLDER} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
