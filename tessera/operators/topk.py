"""Sorts, limits and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: list[tuple[str, str]], key: str, k: int, offset: int = 0) -> DataFrame:
    """The first ``k`` rows by fields in given orders, ties by key; rows without the first field drop out."""
    order = [F.asc(c) if o == "asc" else F.desc(c) for c, o in by]
    out = df.where(F.col(by[0][0]).isNotNull()).orderBy(*order, key).limit(k + offset)
    return out.offset(offset) if offset else out


def nearest(df: DataFrame, field: str, center: float, key: str, k: int) -> DataFrame:
    """By distance to ``center``, the smaller value first where two are as near."""
    return df.where(F.col(field).isNotNull()).orderBy(F.abs(F.col(field) - center), field, key).limit(k)


def quota(df: DataFrame, bucket: str, score: Column, key: str, n: int) -> DataFrame:
    """The best ``n`` of each bucket; the limit of the window is applied before the shuffle."""
    w = Window.partitionBy(bucket).orderBy(F.desc("score"), key)
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def scroll(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The page of ``n`` rows behind a key."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(n)


def numbered(df: DataFrame, *key: str) -> DataFrame:
    """``df`` with ``index`` 0.. in the order of some columns. Each range of keys counts its rows, so only a few
    numbers of ranges meet in one place."""
    from tessera.sources.store import stored

    parts = stored(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    return parts.withColumn("index", inside).join(F.broadcast(base), "part").withColumn("index", F.col("index") + F.col("base")).drop("part", "base")  # base: one row for each partition


def spread_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """``limit`` rows at even distances in key order, the first and last among them; all if there are no more."""
    n = df.count()
    rows = numbered(df, key)
    if n <= limit:
        return rows
    wanted = [0] if limit == 1 else [i * (n - 1) // (limit - 1) for i in range(limit)]
    return rows.where(F.col("index").isin(wanted))
