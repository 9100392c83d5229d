"""Long-term memory: merge operators as aggregates, link merging, the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_sum(value: Column, order: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def merge_immutable(value: Column, order: Column) -> Column:
    """The first value that isn't null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def merge_replace(value: Column, order: Column) -> Column:
    """The last value that isn't null or empty."""
    return F.max_by(value, F.when(value.isNotNull() & (value.cast("string") != ""), order))


def merge_patch(value: Column, order: Column) -> Column:
    """Fold of ``search=>replacement`` patches over the first full text; other values replace it all."""
    parts = F.array_sort(F.collect_list(F.when(value.isNotNull() & (value != ""), F.struct(order.alias("o"), value.alias("v")))))

    def step(text: Column, p: Column) -> Column:
        v = p["v"]
        at = F.instr(v, "=>")
        return F.when((at > 0) & text.isNotNull(), F.replace(text, F.substring_index(v, "=>", 1), F.substring(v, at + 2, F.length(v)))).otherwise(v)

    return F.aggregate(parts, F.lit(None).cast("string"), step)


#: Merge operators by name.
MERGE = {"sum": merge_sum, "immutable": merge_immutable, "replace": merge_replace, "patch": merge_patch}

#: Types of memory, with the merge operator of each field.
MEMORY_TYPES = {
    "cases": {"case_name": "immutable", "task_signature": "immutable", "input": "immutable", "rubric": "immutable", "evidence": "immutable"},
    "entities": {"name": "immutable", "content": "patch"},
    "events": {"event_name": "immutable", "goal": "patch", "summary": "patch", "ranges": "immutable"},
    "experiences": {"experience_name": "immutable", "content": "replace", "supersedes": "replace"},
    "identity": {"creature": "patch", "name": "immutable", "vibe": "patch", "emoji": "patch", "avatar": "patch", "introduction": "patch"},
    "preferences": {"topic": "immutable", "content": "patch"},
    "profile": {"content": "patch"},
    "skills": {"skill_name": "immutable", "total_executions": "sum", "success_count": "sum", "fail_count": "sum", "best_for": "patch", "recommended_flow": "patch", "key_dependencies": "patch", "common_failures": "patch", "recommendation": "patch", "guidelines": "patch"},
    "soul": {"core_truths": "patch", "boundaries": "patch", "vibe": "patch", "continuity": "patch"},
    "tools": {"tool_name": "immutable", "static_desc": "patch", "call_count": "sum", "success_time": "sum", "when_to_use": "patch", "optimal_params": "patch", "common_failures": "patch", "recommendation": "patch", "guidelines": "patch"},
    "trajectories": {"trajectory_name": "immutable", "outcome": "immutable", "task_query": "immutable", "retrieval_anchor": "immutable", "content": "patch"},
}


def merged_memories(patches: DataFrame, kind: str, key: str, order: str) -> DataFrame:
    """Patches of one type of memory as one row a key, by the merge operators of the type's fields."""
    return merged(patches, key, order, {f: op for f, op in MEMORY_TYPES[kind].items() if f in patches.columns})


def merged(patches: DataFrame, key: str, order: str, ops: dict[str, str]) -> DataFrame:
    """One row a key: every field folded by its merge operator, in the patches' order."""
    return patches.groupBy(key).agg(*[MERGE[op](F.col(f), F.col(order)).alias(f) for f, op in ops.items()])


def merged_links(links: DataFrame) -> DataFrame:
    """One row for each (from_uri, to_uri, match_text): greatest weight, last type and description, first time."""
    return links.groupBy("from_uri", "to_uri", "match_text").agg(
        F.max("weight").alias("weight"), F.max_by("link_type", "created_at").alias("link_type"),
        F.max_by("description", "created_at").alias("description"), F.min("created_at").alias("created_at"),
    )


def valid_edges(edges: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """Edges with both ends among the nodes, the first of each (source, target, link_type)."""
    n = nodes.select("node")
    ok = edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi")
    rest = [c for c in ok.columns if c not in ("source", "target", "link_type")]
    one = ok.groupBy("source", "target", "link_type").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return one.select("source", "target", "link_type", *[F.col("r")[c].alias(c) for c in rest])
