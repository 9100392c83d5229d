"""The filter language: nested dictionaries, compiled to one Column.

``{"op": "and"|"or", "conds": [...]}``, ``must``/``must_not`` (``field``, ``conds``), ``range``/``range_out``
(``gte gt lte lt``, or ``center`` and ``radius``, also over two fields), ``geo_range``, ``time_range``,
``prefix``, ``contains``, ``regex``, ``label_in``, ``noop``. A missing value never matches a positive
condition and always matches ``must_not``. Native comparisons keep the push-down to Parquet.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import paths

METRES_PER_DEGREE = 111320.0


def never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def must(field: Column, conds: list, kind: str = "string", depth: int = -1) -> Column:
    """One of the values; of a list, any element; of a path, the subtree."""
    if not conds:
        return F.lit(False)
    if kind == "path":
        return reduce(or_, [paths.in_scope(field, str(c), depth) for c in conds])
    if kind.startswith("list"):
        return never_null(F.arrays_overlap(field, F.array(*[F.lit(c) for c in conds])))
    if kind == "multi":  # a string of values joined by ;
        return never_null(F.arrays_overlap(F.split(field, ";"), F.array(*[F.lit(str(c)) for c in conds])))
    if kind == "bool":
        return never_null(field.isin([bool(c) for c in conds]))
    if kind in ("int64", "float32") and all(isinstance(c, (int, float)) for c in conds):
        return never_null(field.isin(conds))
    return never_null(field.cast("string").isin([str(c) for c in conds]))


def interval(field: Column, spec: dict) -> Column:
    """gte beats gt, lte beats lt; or a closed interval around a centre."""
    if "center" in spec:
        return never_null(field.between(spec["center"] - spec["radius"], spec["center"] + spec["radius"]))
    parts = []
    if "gte" in spec or "gt" in spec:
        parts.append(field >= spec["gte"] if "gte" in spec else field > spec["gt"])
    if "lte" in spec or "lt" in spec:
        parts.append(field <= spec["lte"] if "lte" in spec else field < spec["lt"])
    if not parts:
        raise ValueError("range without bounds")
    return never_null(reduce(and_, parts))


def outside(field: Column, spec: dict) -> Column:
    """Outside of the interval; a bound that the interval includes is not outside."""
    lo, hi = spec.get("gte", spec.get("gt")), spec.get("lte", spec.get("lt"))
    if lo is not None and hi is not None and hi < lo:
        lo, hi = hi, lo
    parts = []
    if lo is not None:
        parts.append(field < lo if "gte" in spec else field <= lo)
    if hi is not None:
        parts.append(field > hi if "lte" in spec else field >= hi)
    if not parts:
        raise ValueError("range without bounds")
    return never_null(reduce(or_, parts))


def disc(x: Column, y: Column, center: tuple[float, float], radius: float) -> Column:
    dx, dy = x.cast("double") - center[0], y.cast("double") - center[1]
    return never_null(dx * dx + dy * dy <= radius * radius)


def degrees(radius: str | float) -> float:
    """``"500m"``, ``"3km"`` or metres, as degrees."""
    if isinstance(radius, str):
        m = re.fullmatch(r"\s*([0-9.]+)\s*(km|m)?\s*", radius.lower())
        if not m:
            raise ValueError(f"radius {radius!r}")
        radius = float(m[1]) * (1000 if m[2] == "km" else 1)
    return float(radius) / METRES_PER_DEGREE


def moment(value: str, now: dt.datetime, upper: bool = False) -> dt.datetime:
    """``2h`` before now, a date (its first or, as an upper bound, last moment), or an ISO time."""
    if m := re.fullmatch(r"(\d+)([smhdw])", value):
        unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
        return now - dt.timedelta(**{unit: int(m[1])})
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        day = dt.datetime.fromisoformat(value)
        return day + dt.timedelta(days=1, microseconds=-1) if upper else day
    return dt.datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None)


def since_until(field: Column, now: dt.datetime, since: str | None = None, until: str | None = None) -> Column:
    lo = moment(since, now) if since else None
    hi = moment(until, now, upper=True) if until else None
    if lo and hi and lo > hi:
        raise ValueError("since is after until")
    parts = [field >= F.lit(str(lo)).cast("timestamp_ntz")] * bool(lo) + [field <= F.lit(str(hi)).cast("timestamp_ntz")] * bool(hi)
    return never_null(reduce(and_, parts)) if parts else F.lit(True)


def _time(value: str) -> Column:
    return F.lit(str(moment(value, dt.datetime(1970, 1, 1)))).cast("timestamp_ntz")


def compile_filter(spec: dict | None, kinds: dict[str, str] | None = None, df: DataFrame | None = None) -> Column:
    """The condition of ``spec``. ``kinds``: types of fields as in ``schema``; ``df``: the filtered rows, needed
    for ``ignore_empty_condition`` only, under which conditions that no row meets are left out."""
    kinds = kinds or {}
    if not spec:
        return F.lit(True)
    op = spec["op"]
    if op == "noop":
        return F.lit(True)
    if op in ("and", "or"):
        children = [c for c in spec.get("conds", []) if c]
        cols = [compile_filter(c, kinds, df) for c in children]
        if op == "and" and spec.get("ignore_empty_condition"):
            if df is None:
                raise ValueError("ignore_empty_condition needs the rows")
            cols = [c | ~never_null(df.agg(F.bool_or(c)).scalar()) if _skippable(s) else c for s, c in zip(children, cols, strict=True)]
        return reduce(and_ if op == "and" else or_, cols) if cols else F.lit(True)
    name = spec.get("field")
    if op == "label_in":
        return never_null(F.col(name).isin(spec["labels"]))
    if isinstance(name, list):
        return disc(F.col(name[0]), F.col(name[1]), spec["center"], spec["radius"])
    col, kind = F.col(name), kinds.get(name, "string")
    if op in ("must", "must_not"):
        depth = int(m[1]) if (m := re.search(r"-d=(-?\d+)", spec.get("para", ""))) else -1
        hit = must(col, spec.get("conds", []), kind, depth)
        return hit if op == "must" else ~hit
    if op == "range":
        return interval(col, spec)
    if op == "range_out":
        return outside(col, spec)
    if op == "geo_range":
        lon, lat = (float(x) for x in spec["center"].split(","))
        return disc(col["lon"], col["lat"], (lon, lat), degrees(spec["radius"]))
    if op == "time_range":
        return interval(col, {k: _time(v) for k, v in spec.items() if k in ("gte", "gt", "lte", "lt")})
    if op == "prefix":
        return never_null(paths.norm(col).startswith("/" + spec["prefix"].lstrip("/")) if kind == "path" else col.startswith(spec["prefix"]))
    if op == "contains":
        return never_null(col.contains(spec["substring"]))
    if op == "regex":
        try:
            re.compile(spec["pattern"])
        except re.error:
            return F.lit(False)
        return never_null(col.rlike(spec["pattern"]))
    raise ValueError(f"unknown op {op!r}")


def _skippable(spec: dict) -> bool:
    return spec["op"] in ("range", "prefix", "contains", "regex") or spec["op"] == "must" and len(spec.get("conds", [])) == 1


def levels(value: int | str | list) -> list[int]:
    """Levels out of ``2``, ``"0,1"`` or a list; what isn't a number is left out."""
    items = value if isinstance(value, list) else str(value).split(",")
    return [int(x) for x in items if re.fullmatch(r"\s*\d+\s*", str(x))]


def tag_list(text: str | list[str]) -> list[str]:
    """``k=v`` tags in lower case, the last value of each key."""
    items = text if isinstance(text, list) else text.split(",")
    last: dict[str, str] = {}
    for x in items:
        k, eq, v = x.strip().lower().partition("=")
        if not eq or not k or not v:
            raise ValueError(f"tag {x!r} is not k=v")
        last[k] = v
    return [f"{k}={v}" for k, v in last.items()]


def has_tags(tags: Column, wanted: str | list[str]) -> Column:
    return never_null(reduce(and_, [F.array_contains(tags, t) for t in tag_list(wanted)]))


def merge_tags(old: Column, new: Column) -> Column:
    """Tags of ``old`` whose key ``new`` doesn't have, then those of ``new``."""
    key = lambda t: F.substring_index(t, "=", 1)
    return F.concat(F.filter(old, lambda t: ~F.exists(new, lambda n: key(n) == key(t))), new)


def visible(context_type: str, account: str, targets: list[str], *, path: str, lvls: list[int] | None = None, extra: Column | None = None) -> Column:
    """Tenant scope: type, account, any of the target subtrees, levels, and what else is asked."""
    parts = [F.col("context_type") == context_type, F.col("account_id") == account]
    if targets:
        parts.append(reduce(or_, [paths.in_scope(F.col(path), x) for x in targets]))
    if lvls is not None:
        parts.append(F.col("level").isin(lvls))
    if extra is not None:
        parts.append(extra)
    return never_null(reduce(and_, parts))
