"""What contexts are used for: recall and injection events from tool parts, references to resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import paths

#: Tools by what their results say: an address was found, or a text was put in.
KINDS = {"memory_search": "recall", "memory_list": "recall", "memory_grep": "recall", "memory_read": "injection"}
URI = r"ctx://[^\s<>\[\]()\"',;]+"


def events(parts: DataFrame, kinds: dict[str, str] | None = None, scope: str = "/memories/experiences/") -> DataFrame:
    """(message, kind, uri): each address under ``scope`` once a message and part, of the completed parts of
    known tools. ``parts``: message, tool, status, output."""
    kind = F.lit(None).cast("string")
    for tool, k in (kinds or KINDS).items():
        kind = F.when(F.col("tool") == tool, k).otherwise(kind)
    found = F.array_distinct(F.filter(F.regexp_extract_all("output", F.lit(URI), 0), lambda u: F.contains(u, F.lit(scope))))
    rows = parts.where("status = 'completed'").select("message", kind.alias("kind"), F.explode(found).alias("uri"))
    return rows.where("kind IS NOT NULL")


def counts(used: DataFrame) -> DataFrame:
    return used.groupBy("uri", "kind").agg(F.count("*").alias("n"))


def referencing(memories: DataFrame, resources: DataFrame, *, recursive: bool = True) -> DataFrame:
    """(memory, resource): memories whose references (``refs``, an array of addresses) name a resource or,
    if ``recursive``, something under it. References meet resources by their own prefixes, as in an
    equality join; nothing is compared pairwise."""
    refs = memories.select("memory", F.explode(F.array_distinct("refs")).alias("ref"))
    p = paths.from_uri(F.col("ref"))
    up = F.array_append(paths.ancestors(p), p) if recursive else F.array(p)
    own = resources.select("resource", paths.from_uri(F.col("resource")).alias("__up"))
    return refs.withColumn("__up", F.explode(up)).join(own, "__up").select("memory", "resource").distinct()
