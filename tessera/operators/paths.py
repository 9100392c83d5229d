"""Paths of the virtual tree: normal form, scopes, globs, ancestors, children, URIs.

Everything is an expression on one path column, so it stays in the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = "ctx"
DEEPEST = 50


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def norm(path: Column) -> Column:
    """One leading slash, none at the end, no empty segments."""
    return F.concat(F.lit("/"), F.array_join(segments(path), "/"))


def norm_text(path: str) -> str:
    return "/" + "/".join(s for s in path.split("/") if s)


def in_scope(path: Column, prefix: str, depth: int = -1) -> Column:
    """Whether the path is ``prefix`` or lies under it, ``depth`` levels at most (-1: any); null is outside."""
    depth = max(-1, min(DEEPEST, depth))
    pre = norm_text(prefix)
    p = norm(path)
    under = F.lit(True) if pre == "/" else (p == pre) | p.startswith(pre + "/")
    if depth >= 0:
        under &= F.size(segments(path)) - len([s for s in pre.split("/") if s]) <= depth
    return F.coalesce(under & path.isNotNull(), F.lit(False))


def parent(path: Column) -> Column:
    s = segments(path)
    return F.concat(F.lit("/"), F.array_join(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), "/"))


def leaf(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def depth(path: Column) -> Column:
    return F.size(segments(path))


def relative(path: Column, root: str) -> Column:
    """The path below ``root``, or null if it isn't there."""
    pre = norm_text(root).rstrip("/")
    return F.when(in_scope(path, root), F.substring(norm(path), len(pre) + 2, 1 << 20))


def ancestors(path: Column) -> Column:
    """All directories above the path, from the root."""
    s = segments(path)
    return F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(s, 1, i), "/")))).otherwise(F.array())


def to_uri(path: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://"), F.array_join(segments(path), "/"))


def from_uri(uri: Column) -> Column:
    return norm(F.regexp_replace(uri, f"^{SCHEME}://", "/"))


def url_path(url: Column) -> Column:
    """A web address as a path: host first, without scheme, query and fragment."""
    return norm(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", "/"), r"[?#].*$", ""))


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` don't cross a slash, ``**`` does, ``[...]`` is a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r".^$+{}()|\\" else c)
        i += 1
    return f"^{out}$"


def glob(paths: DataFrame, path: str, pattern: str, root: str = "/") -> DataFrame:
    """Rows whose path below ``root`` fits the pattern, in the order of their segments."""
    return paths.where(relative(F.col(path), root).rlike(glob_regex(pattern))).orderBy(segments(F.col(path)), path)


def contained(rows: DataFrame, path: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows at or under any target: an equality join on each row's own prefixes, not a range join."""
    near = rows.withColumn("__up", F.explode(F.array_append(ancestors(F.col(path)), norm(F.col(path)))))
    own = targets.select(norm(F.col(target)).alias("__up")).distinct()
    return near.join(own, "__up", "left_semi").drop("__up").distinct()


def tree(files: DataFrame, path: str) -> DataFrame:
    """Every directory and file once: path, is_dir, parent, depth, and how many children and files under it."""
    p = norm(F.col(path))
    files = files.select(p.alias("path")).distinct()
    ups = files.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("under"))
    nodes = ups.withColumn("is_dir", F.lit(True)).unionByName(files.join(ups, "path", "left_anti").select("path", F.lit(0).cast("long").alias("under"), F.lit(False).alias("is_dir")))
    nodes = nodes.withColumn("parent", F.when(F.col("path") != "/", parent(F.col("path")))).withColumn("depth", depth(F.col("path")))
    kids = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children"))
    out = nodes.join(kids.withColumnRenamed("parent", "path"), "path", "left")
    return out.select("path", "parent", "is_dir", "depth", F.coalesce("children", F.lit(0)).alias("children"), "under")


def walk(nodes: DataFrame, root: str = "/", levels: int | None = None, hidden: bool = False) -> DataFrame:
    """``tree`` rows under a root, ``levels`` deep, without hidden names, in depth-first order."""
    n = len([s for s in norm_text(root).split("/") if s])
    out = nodes.where(in_scope(F.col("path"), root))
    if levels is not None:
        out = out.where(F.col("depth") - n <= levels)
    if not hidden:
        out = out.where(~F.exists(segments(F.col("path")), lambda s: s.startswith(".")))
    return out.orderBy(segments(F.col("path")))
