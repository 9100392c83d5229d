"""Counts, statistics and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import topk
from tessera.sources.store import stored


def group_count(df: DataFrame, fields: list[str], *, multi: bool = False, gt: int = -1, max_entry: int | None = None) -> DataFrame:
    """(key, count) by one or two fields, in key order; each element of a list field counts. All keys come,
    unless ``max_entry`` asks for the first ones."""
    if not 1 <= len(fields) <= 2:
        raise ValueError("one or two fields")
    rows = df.select(F.explode(fields[0]).alias("key")) if multi else df.select(F.concat_ws(",", *[F.col(f).cast("string") for f in fields]).alias("key"))
    out = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("count")).where(F.col("count") > gt).orderBy("key")
    return out if max_entry is None else out.limit(max_entry)


def bucketed(value: Column, bounds: list[float]) -> Column:
    """The first bound that isn't less than the value; the last is infinite."""
    out = F.lit("+Inf")
    for b in sorted(bounds, reverse=True):
        out = F.when(value <= b, F.lit(f"{b:g}")).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """(le, count, sum, cumulative) of each bucket that has rows."""
    by, order = by or [], sorted(bounds)
    at = F.when(F.col("le") == "+Inf", len(order)).otherwise(F.array_position(F.array(*[F.lit(f"{b:g}") for b in order]), F.col("le")) - 1)
    out = df.where(F.col(value).isNotNull()).withColumn("le", bucketed(F.col(value), bounds)).groupBy(*by, "le").agg(F.count("*").alias("count"), F.sum(value).alias("sum"))
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy("__at")  # a row for each bucket
    return out.withColumn("__at", at).withColumn("cumulative", F.sum("count").over(w)).drop("__at")


def scores(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.count(score).alias("n"), F.round(F.min(score), 6).alias("min"), F.round(F.max(score), 6).alias("max"), F.round(F.avg(score), 6).alias("mean"))


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (interpolated) of each group, a column for each share: rows are numbered in the order
    of group and value over ranges of both, so no group's values meet in one task or buffer."""
    rows = topk.numbered(df.where(F.col(value).isNotNull()).select(by, value), by, value)
    ends = rows.groupBy(by).agg(F.min("index").alias("base"), F.count("*").alias("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for k, q in shares.items()])
    ends = ends.withColumn("w", F.explode(wanted)).select(by, "w.name", "w.at", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("i"), "base")
    places = ends.select(by, "name", "at", "i", (F.col("base") + F.col("i")).alias("index"))
    got = rows.select("index", F.col(value).alias("x")).join(places, "index")
    part = F.when(F.col("i") == F.floor("at"), 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    return got.groupBy(by).agg(*[F.sum(F.when(F.col("name") == k, F.col("x") * part)).alias(k) for k in shares])


def latency(df: DataFrame, by: str, value: str, ok: Column) -> DataFrame:
    """Count, share of successes, quantiles and maximum of each group."""
    own = df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("double")), 6).alias("success"), F.round(F.max(value), 6).alias("max"))
    q = quantiles(df, by, value, {f"p{p}": p / 100 for p in (50, 95, 99)})
    return own.join(q, by, "left").select(by, "n", "success", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (50, 95, 99)], "max")


def median_mad(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median, and median of the distances to it."""
    m = stored(quantiles(df, by, value, {"median": 0.5}), "median")
    far = df.where(F.col(value).isNotNull()).join(F.broadcast(m) if m.count() <= 10_000 else m, by).select(by, F.abs(F.col(value) - F.col("median")).alias("far"))  # a row for each group
    return m.join(quantiles(far, by, "far", {"mad": 0.5}), by).select(by, F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def token_f1(pairs: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """Precision, recall and F1 of two token lists (arrays), as multisets."""
    def counted(c: Column, name: str) -> DataFrame:
        return pairs.select(key, F.explode(c).alias("t")).groupBy(key, "t").agg(F.count("*").alias(name))

    both = counted(a, "x").join(counted(b, "y"), [key, "t"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("same"))
    sized = pairs.select(key, F.size(a).alias("na"), F.size(b).alias("nb"))
    same = F.coalesce("same", F.lit(0))
    p, r = same / F.nullif(F.col("na"), F.lit(0)), same / F.nullif(F.col("nb"), F.lit(0))
    f1 = F.when(same > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return sized.join(both, key, "left").select(key, F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"), F.round(f1, 6).alias("f1"))
