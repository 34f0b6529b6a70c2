"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path for new files, in the folder of spark.checkpoint.dir; in a temporary one only where that is unset and all run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if found is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="storyloom-"))
    return f"{sc.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"
