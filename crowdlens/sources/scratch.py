"""Folders for what a job keeps between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new name below the folder in spark.checkpoint.dir; where none is set, below one of this machine in local mode, else an
    error, as executors wouldn't share it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="crowdlens-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
