"""Tables, and intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a folder of our own if all runs on one
    machine, and else an error, since other executors wouldn't see it."""
    if path := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return path
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage, and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
