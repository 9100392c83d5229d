"""Versions of a tree of files: commits as manifest tables in a folder, log, show, diff and restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions: those whose manifest was written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[1:]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def commit(files: DataFrame, root: str, message: str, author: str = "") -> int:
    """Write a version of ``files`` (path, content): new contents by digest, once each, and the manifest."""
    spark = files.sparkSession
    before = versions(spark, root)
    number = (before[-1] if before else 0) + 1
    digest = F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("none"))
    rows = files.select("path", digest.alias("digest"), "content")
    known = spark.read.parquet(f"{root}/contents").select("digest") if before else None
    new = rows.select("digest", "content").groupBy("digest").agg(F.first("content").alias("content"))
    new = new if known is None else new.join(known, "digest", "left_anti")
    new.write.mode("append").parquet(f"{root}/contents")
    about = {"version": F.lit(number), "parent": F.lit(before[-1] if before else None).cast("int"), "message": F.lit(message), "author": F.lit(author)}
    rows.select("path", "digest").withColumns(about).write.parquet(f"{root}/manifests/v{number}")
    return number


def show(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(path, digest) of a version."""
    if version not in versions(spark, root):
        raise ValueError(f"no version {version}")
    return spark.read.parquet(f"{root}/manifests/v{version}").select("path", "digest")


def log(spark: SparkSession, root: str) -> DataFrame:
    """(version, parent, message, author, files), newest first."""
    numbers = versions(spark, root)
    if not numbers:
        return spark.createDataFrame([], "version int, parent int, message string, author string, files long")
    rows = spark.read.parquet(*[f"{root}/manifests/v{n}" for n in numbers])
    return rows.groupBy("version", "parent", "message", "author").agg(F.count("*").alias("files")).orderBy(F.desc("version"))


def diff(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """(path, change): what has to be written or deleted to get from one version to another."""
    return changes.diff(show(spark, root, old), show(spark, root, new), "path", "digest")


def restore(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(path, content) of a version; contents are looked up by digest, and none may be missing."""
    rows = show(spark, root, version).join(spark.read.parquet(f"{root}/contents").dropDuplicates(["digest"]).withColumn("__there", F.lit(True)), "digest", "left")
    lost = F.raise_error(F.concat(F.lit("content is missing: "), F.col("path")))
    return rows.select("path", F.when(F.coalesce(F.col("__there"), F.lit(False)), F.col("content")).otherwise(lost).alias("content"))
