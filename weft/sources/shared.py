"""The folder that driver and executors share, and checkpoints in it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full URI, or a folder of our own where it is unset, as in tests."""
    sc = spark.sparkContext
    to = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(to)
    path = sc._jvm.org.apache.hadoop.fs.Path(to)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
