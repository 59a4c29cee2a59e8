"""Tables between the rounds of an iteration, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's setting. Where nothing is set, a local session gets a folder of its own; a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="refweave-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: its lineage is cut, and what it took to compute is done once."""
    spark = df.sparkSession
    path = f"{folder(spark)}/refweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
