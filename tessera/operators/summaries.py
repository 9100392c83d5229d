"""Abstracts and overviews of directories, made from those of their children, leaves first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import paths, topk
from tessera.sources.store import stored

#: Children whose abstracts a parent takes up.
SAMPLE = 32


def extractive(abstracts: Column) -> tuple[Column, Column]:
    """The abstract (the first one's first 120 characters) and overview (all of them) where no model is given."""
    return F.substring(F.get(abstracts, F.lit(0)), 1, 120), F.array_join(abstracts, "\n")


def spread(children: DataFrame, parent: str, order: str, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` children of each parent, at even distances in their order, the first and last among
    them. Children are numbered over ranges, so a large directory isn't one task's."""
    rows = topk.numbered(children, parent, order)
    of_parent = rows.groupBy(parent).agg(F.min("index").alias("__base"), F.count("*").alias("__n"))
    i, n = F.col("index") - F.col("__base"), F.col("__n")
    k = F.ceil(i * (most - 1) / (n - 1))  # the first of the wanted places that may be this one
    wanted = (n <= most) | (F.floor(k * (n - 1) / (most - 1)) == i)
    return rows.join(of_parent, parent).where(F.coalesce(wanted, F.lit(True))).drop("index", "__base", "__n")


def bottom_up(files: DataFrame, path: str, abstract: str, *, summarise: Callable[[Column], tuple[Column, Column]] = extractive, most: int = SAMPLE) -> DataFrame:
    """(path, abstract, overview, children) of every directory: level by level from the deepest, a parent is
    made from at most ``most`` of its children's abstracts, which a level's table has written."""
    leaves = files.select(paths.norm(F.col(path)).alias("path"), F.col(abstract).alias("abstract"))
    leaves = stored(leaves.withColumns({"parent": paths.parent(F.col("path")), "depth": paths.depth(F.col("path"))}), "leaves")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    below = leaves.where(F.col("depth") == deepest).select("path", "parent", "abstract")
    out = None
    for depth in range(deepest - 1, -1, -1):
        some = spread(below, "parent", "path", most)
        texts = F.transform(F.array_sort(F.collect_list(F.struct("path", "abstract"))), lambda x: x["abstract"])
        made = some.groupBy("parent").agg(texts.alias("t")).join(below.groupBy("parent").agg(F.count("*").alias("children")), "parent")
        short, long_ = summarise(F.col("t"))
        made = stored(made.select(F.col("parent").alias("path"), short.alias("abstract"), long_.alias("overview"), "children"), f"directories{depth}")
        out = made if out is None else out.unionByName(made)
        up = made.select("path", F.when(F.col("path") != "/", paths.parent(F.col("path"))).alias("parent"), "abstract")
        below = up.unionByName(leaves.where(F.col("depth") == depth).select("path", "parent", "abstract"))
    return out if out is not None else files.sparkSession.createDataFrame([], "path string, abstract string, overview string, children long")
