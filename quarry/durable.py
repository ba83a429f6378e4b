"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session (tests) gets a temporary folder, remembered in the session; on a cluster
    that is an error."""
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key, None) or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df written once and read back, so that its lineage ends in files that outlive an executor."""
    path = f"{shared_dir(df.sparkSession)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
