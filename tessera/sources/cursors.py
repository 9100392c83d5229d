"""Logs read in steps: a cursor for each session, batches that are pending until they are confirmed.

A batch is written with the places up to which it reads each session. Until it is confirmed, the next
reader gets the same batch again; after that it reads on from there. So a crash between the two repeats a batch
and loses none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _whole(spark: SparkSession, root: str, kind: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{root}/{kind}") if "_SUCCESS" in _names(spark, f"{root}/{kind}/{n}"))


def cursors(spark: SparkSession, root: str, session: str, seq: str) -> DataFrame | None:
    """(session, seq): the last confirmed place of each session."""
    done = _whole(spark, root, "confirmed")
    return spark.read.parquet(*[f"{root}/confirmed/{n}" for n in done]).groupBy(session).agg(F.max(seq).alias("__at")) if done else None


def pending(log: DataFrame, root: str, session: str, seq: str) -> tuple[int, DataFrame]:
    """The number and rows of the batch that is to be confirmed next: one that was begun before, or else all
    rows of the log behind the cursors."""
    spark = log.sparkSession
    begun, done = _whole(spark, root, "batches"), _whole(spark, root, "confirmed")
    number = len(done) + 1
    if number not in begun:
        at = cursors(spark, root, session, seq)
        new = log if at is None else log.join(at, session, "left").where(F.col("__at").isNull() | (F.col(seq) > F.col("__at"))).drop("__at")
        new.write.mode("overwrite").parquet(f"{root}/batches/{number}")
    return number, spark.read.schema(log.schema).parquet(f"{root}/batches/{number}")


def confirm(spark: SparkSession, root: str, number: int, session: str, seq: str) -> None:
    """Move the cursors to the end of a batch."""
    spark.read.parquet(f"{root}/batches/{number}").groupBy(session).agg(F.max(seq).alias(seq)).write.mode("overwrite").parquet(f"{root}/confirmed/{number}")
