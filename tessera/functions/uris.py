"""What a URI says: owner, type, category, safe names, level suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import paths

#: Categories of memories, in the order in which they are looked for.
CATEGORIES = ["patterns", "cases", "profile", "preferences", "entities", "events"]


def category(uri: Column) -> Column:
    out = F.lit("")
    for c in reversed(CATEGORIES):
        out = F.when(uri.contains(f"/{c}"), c).otherwise(out)
    return out


def context_type(uri: Column) -> Column:
    s = paths.segments(F.regexp_replace(uri, r"^[a-z]+://", "/"))
    has = lambda x: F.array_contains(s, x)
    return F.when(has("skills"), "skill").when(has("memories"), "memory").when(F.get(s, F.lit(0)) == "session", "session").otherwise("resource")


def owner(uri: Column) -> Column:
    """The id behind ``user/``; null where there is none."""
    return F.nullif(F.regexp_extract(uri, r"(?:^|/)user/([^/]+)", 1), F.lit(""))


def safe_segment(name: Column) -> Column:
    """Letters, digits and ``_ . -`` of any script, other runs as one ``_``, 50 characters at most."""
    s = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_.-]+", "_"), "_+", "_")
    return F.substring(F.regexp_replace(s, r"^[_.]+|[_.]+$", ""), 1, 50)


def strip_level(uri: Column) -> Column:
    return F.regexp_replace(uri, r"/\.(abstract|overview)\.md$", "")


def level_of(uri: Column) -> Column:
    return F.when(uri.endswith("/.abstract.md"), 0).when(uri.endswith("/.overview.md"), 1).otherwise(2)


def geo_point(text: Column) -> Column:
    """``lon,lat`` as a struct; out of range fails the job."""
    p = F.split(text, ",")
    lon, lat = F.get(p, F.lit(0)).cast("double"), F.get(p, F.lit(1)).cast("double")
    ok = (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.when(text.isNull(), F.lit(None)).when(ok, F.struct(lon.alias("lon"), lat.alias("lat"))).otherwise(F.raise_error(F.concat(F.lit("no geo point: "), text)))
