"""A query's rows next to those of its SQL, by DuckDB."""

import glob
import math
import os

import duckdb

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_integer_ratio"):
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 5) + 0.0
    return str(v)


def connect(sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql, sf=SF):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want), f"{len(got)} rows, SQL has {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, f"{len(bad)} of {len(got)} rows differ: {str(bad[0])[:600]}"
    return len(got)
