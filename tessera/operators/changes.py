"""Tables that change: upserts, partial updates, deletes, expiry, replay, snapshots, copies, packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: one aggregate with partial maxima, so hot keys don't gather."""
    cols = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return one.select(key, *[F.col("r")[c].alias(c) for c in cols])


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    return latest(old.unionByName(new), key, order)


def update(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Fields that the patch has and that aren't null replace those of existing rows."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return old.join(p, key, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])


def fetch(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys, and the keys that have none."""
    return df.join(keys, key, "left_semi"), keys.join(df, key, "left_anti")


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys, key, "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def alive(df: DataFrame, expires: Column, now: Column) -> DataFrame:
    return df.where(expires.isNull() | (expires > now))


def replay(log: DataFrame, key: str, ts: str, op: str, since) -> DataFrame:
    """The rows that a change log leaves (op 0: put, 1: delete) after ``since``."""
    return latest(log.where(F.col(ts) > since), key, [ts]).where(F.col(op) == 0).drop(op)


def diff(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, change) between two snapshots: write, delete or same."""
    a, b = old.select(path, F.col(digest).alias("__a")), new.select(path, F.col(digest).alias("__b"))
    change = F.when(F.col("__b").isNull(), "delete").when(F.col("__a").isNull() | (F.col("__a") != F.col("__b")), "write").otherwise("same")
    return a.join(b, path, "full").select(path, change.alias("change"))


def rewritten(path: Column, source: str, target: str) -> Column:
    """The path moved from under one prefix to another; others are unchanged."""
    return F.when((path == source) | path.startswith(source.rstrip("/") + "/"), F.concat(F.lit(target), F.substring(path, len(source) + 1, 1 << 20))).otherwise(path)


def best(df: DataFrame, key: str, score: str, then: str) -> DataFrame:
    """The row with the best score of each key, the first by ``then`` where scores are equal."""
    cols = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(-F.col(score), F.col(then))).alias("r"))
    return one.select(key, *[F.col("r")[c].alias(c) for c in cols])


def first_of(df: DataFrame, key: Column, then: str) -> DataFrame:
    """One row of each key, the least by ``then``; the key may be a digest."""
    cols = df.columns
    return df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*cols), F.col(then)).alias("r")).select("r.*")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def export_pack(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write rows and a manifest (key, digest of the whole row); gives the manifest."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    df.select(key, digest.alias("digest")).write.parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def import_pack(spark, path: str, key: str) -> DataFrame:
    """Read a pack back; a row that the manifest doesn't have, or has otherwise, fails the import."""
    rows, manifest = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    bad = rows.select(key, digest.alias("digest")).join(manifest, [key, "digest"], "left_anti")
    if not bad.isEmpty():
        raise ValueError(f"{path}: rows differ from the manifest")
    return rows
