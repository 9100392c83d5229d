"""Typed collections: field types, defaults and validation.

A collection has at most one primary key (int64 or string) and fields of the types below. Fields that a
row lacks get their default; fields that the collection doesn't have are refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The field types, their Spark types and their default values.
TYPES = {
    "int64": ("bigint", 0),
    "float32": ("float", 0.0),
    "string": ("string", ""),
    "text": ("string", ""),
    "bool": ("boolean", False),
    "list<string>": ("array<string>", []),
    "list<int64>": ("array<bigint>", []),
    "vector": ("array<float>", None),
    "sparse_vector": ("map<string,float>", {}),
    "path": ("string", ""),
    "date_time": ("timestamp", None),
    "geo_point": ("struct<lon:double,lat:double>", None),
    "image": ("binary", None),
    "video": ("binary", None),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    primary: bool = False
    dim: int | None = None
    default: Any = None

    def __post_init__(self) -> None:
        if self.kind not in TYPES:
            raise ValueError(f"{self.name}: unknown type {self.kind}")
        if self.kind == "vector" and not (self.dim and 4 <= self.dim <= 4096 and self.dim % 4 == 0):
            raise ValueError(f"{self.name}: a vector's dimension is a multiple of 4 from 4 to 4096")
        if self.primary and self.kind not in ("int64", "string"):
            raise ValueError(f"{self.name}: a primary key is int64 or string")


@dataclass(frozen=True)
class Collection:
    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if sum(f.primary for f in self.fields) > 1:
            raise ValueError(f"{self.name}: more than one primary key")

    @property
    def key(self) -> str:
        return next((f.name for f in self.fields if f.primary), "auto_id")

    def kinds(self) -> dict[str, str]:
        return {f.name: f.kind for f in self.fields}

    def conform(self, df: DataFrame) -> DataFrame:
        """``df`` cast to the collection's types, with defaults; a vector of another length fails the job."""
        if unknown := sorted(set(df.columns) - {f.name for f in self.fields}):
            raise ValueError(f"{self.name} has no fields {', '.join(unknown)}")
        out = []
        for f in self.fields:
            kind, default = TYPES[f.kind]
            fill = f.default if f.default is not None else default
            lit = F.lit(None) if fill is None else F.from_json(F.lit("{}"), kind) if fill == {} else F.array() if fill == [] else F.lit(fill)
            c = F.coalesce(F.col(f.name).cast(kind), lit.cast(kind)) if f.name in df.columns else lit.cast(kind)
            if f.dim:
                c = F.when(c.isNull() | (F.size(c) == f.dim), c).otherwise(F.raise_error(F.lit(f"{f.name}: dimension is not {f.dim}")))
            out.append(c.alias(f.name))
        if self.key == "auto_id":
            out.insert(0, F.monotonically_increasing_id().alias("auto_id"))
        return df.select(*out)
