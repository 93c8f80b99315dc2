"""Results that several later steps read, written once."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may do without a set one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """Path of a folder of one's own in the shared one."""
    return f"{shared(spark)}/{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()
