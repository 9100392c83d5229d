"""Files as tables: directory scans, parsers by extension, agent logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import paths

#: Parsers by extension: expressions from a file's text. A plug-in adds its own, e.g. a pandas UDF over bytes.
PARSERS = {"txt": lambda t: t, "md": lambda t: X.frontmatter(t)[1], "html": X.html_markdown, "htm": X.html_markdown, "json": lambda t: t, "csv": lambda t: t}


def scan(spark: SparkSession, root: str, *, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, name, ext, size, mod_time, content) of all files under ``root`` that the globs let through."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    out = files.select(rel.alias("path"), F.element_at(F.split(rel, "/"), -1).alias("name"), F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content")
    keep: Column = F.lit(True)
    if include:
        keep = F.lit(False)
        for g in include:
            keep = keep | F.col("path").rlike(paths.glob_regex("**/" + g))
    for g in exclude or []:
        keep = keep & ~F.col("path").rlike(paths.glob_regex("**/" + g))
    return out.where(keep)


def parsed(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """``files`` with ``text``: by the parser of the extension, null where none is known."""
    out = F.lit(None).cast("string")
    t = X.valid_text(F.col("content"))
    for ext, f in (parsers or PARSERS).items():
        out = F.when(F.col("ext") == ext, f(t)).otherwise(out)
    return files.withColumn("text", out)


def agent_log(rows: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Messages with the roles user, assistant and tool; those without text drop out."""
    r = F.lower(F.col(role))
    known = F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "ai", "model"), "assistant").otherwise("tool")
    return rows.withColumn(role, known).where(F.coalesce(F.btrim(F.regexp_replace(text, r"\s+", " ")) != "", F.lit(False)))


class JsonFields:
    """A parser plug-in: the fields of a JSON object as (name, value) rows. Any class with such an ``eval``
    is one; it runs as a table function, a row in, rows out."""

    def eval(self, text: str):
        import json

        try:
            got = json.loads(text or "")
        except ValueError:
            return
        if isinstance(got, dict):
            for name, value in got.items():
                yield name, value if isinstance(value, str) else json.dumps(value)


def sections(rows: DataFrame, text: str, plugin: type, returns: str = "name string, value string") -> DataFrame:
    """``rows`` with what a plug-in makes of each text, a row for each piece."""
    table_function = F.udtf(plugin, returnType=returns)
    return rows.lateralJoin(table_function(F.col(text).outer()))
