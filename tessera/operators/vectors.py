"""Vector scores, and exact top-k over them.

Vectors are ``array<float>``; products add up in double, so results don't depend on the plan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import once

#: Rows of either side in one block of a batched search.
BLOCK = 4096


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(inner(v, v))


def l2_score(a: Column, b: Column) -> Column:
    return 1 - squared_l2(a, b)


def cosine(a: Column, b: Column) -> Column:
    return inner(a, b) / (norm(a) * norm(b))


def truncated(v: Column, dim: int) -> Column:
    """The first ``dim`` values, of unit length; vectors that aren't longer, and zeros, stay."""
    cut = F.slice(v, 1, dim)
    unit = once(norm(cut), lambda n: F.when(n == 0, cut.cast("array<double>")).otherwise(F.transform(cut, lambda x: x.cast("double") / n)))
    return F.when(F.size(v) <= dim, v.cast("array<double>")).otherwise(unit)


def scale_of(v: Column) -> Column:
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top <= 1e-8, F.lit(1.0)).otherwise(top / 127)


def int8(v: Column) -> Column:
    """Values over the scale, rounded half away from zero, in -127..127."""
    rounded = lambda x, s: (F.signum(x.cast("double")) * F.least(F.lit(127.0), F.floor(F.abs(x.cast("double")) / s + 0.5))).cast("int")
    return once(scale_of(v), lambda s: F.transform(v, lambda x: rounded(x, s)))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def int8_inner(a: Column, b: Column) -> Column:
    return int_dot(int8(a), int8(b)) * scale_of(a) * scale_of(b)


def int8_l2(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), inner(a, a) + inner(b, b) - 2 * int8_inner(a, b))


def sparse_inner(a: Column, b: Column) -> Column:
    """Over two maps from term to weight, whose keys meet by hash."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)


def sparse_l2(a: Column, b: Column) -> Column:
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return square(a) + square(b) - 2 * sparse_inner(a, b)


def hybrid(dense: Column, sparse: Column | None, alpha: float) -> Column:
    return dense if sparse is None or alpha <= 0 else dense * (1 - alpha) + sparse * alpha


def clean(score: Column, default: float = 0.0) -> Column:
    """Missing, NaN and infinite scores become the default."""
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.lit(default)).otherwise(s)


def top_k(df: DataFrame, score: Column, key: str, k: int, offset: int = 0) -> DataFrame:
    """Best scores first, ties by key; the filter belongs in ``df``, before any score is computed."""
    if k <= 0 or offset < 0:
        raise ValueError("limit is positive, offset is not negative")
    out = df.withColumn("score", score).orderBy(F.desc("score"), F.asc(key)).limit(k + offset)
    return out.offset(offset) if offset else out


def with_query(df: DataFrame, key: str, value, vec: str = "embedding") -> DataFrame:
    """``df`` with ``qvec``, the stored vector of one row: a scalar subquery of one value."""
    one = df.where(F.col(key) == value).select(F.max(vec)).scalar()
    return df.withColumn("qvec", one)


def random_order(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(k)


def knn(queries: DataFrame, rows: DataFrame, *, key: str, vec: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best rows by inner product for every query.

    Both sides are dealt into blocks of about ``block`` rows; each pair of blocks is one matrix product in
    one task, and keeps its own best ``k`` for each query. Ties go to the smaller key. No side is broadcast."""
    kind = rows.schema[key].dataType.simpleString()

    def blocked(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = max(1, math.ceil(df.count() / block))
        return df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias(name)), n

    q, nq = blocked(queries, "qb")
    r, nr = blocked(rows, "rb")
    q = q.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nr - 1).cast("long"))))
    r = r.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))

    def matrix(t: pa.Table) -> np.ndarray:
        v = t.column("v").combine_chunks()
        return v.flatten().to_numpy().reshape(len(v), -1)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], a.schema.field("id").type), "id": pa.array([], b.schema.field("id").type), "score": pa.array([], pa.float64())})
        b = b.sort_by("id")
        x, y, m = matrix(a), matrix(b), min(k, b.num_rows)
        at, score = [], []
        for lo in range(0, len(x), 512):
            s = x[lo : lo + 512] @ y.T
            order = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :m]  # by id where scores are equal
            at.append(order)
            score.append(np.take_along_axis(s, order, 1))
        at = np.concatenate(at)
        return pa.table({"query_id": a.column("id").take(pa.array(np.repeat(np.arange(len(x)), m))), "id": b.column("id").take(pa.array(at.ravel())), "score": pa.array(np.concatenate(score).ravel())})

    got = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(best, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("id", key)
