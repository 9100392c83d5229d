"""Connected components of an edge table, by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, name: str = "labels", most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node of its component.

    A round gives each node the least label among its own and its neighbours', and then that
    node's label. Each round's table goes to the shared folder."""
    both = C.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = C.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), name)
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
        new = low.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("to", "label")).alias("label"))
        new = C.stored(new, name)
        changed = not new.where("label <> was").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components: labels still changed after {most_rounds} rounds")
