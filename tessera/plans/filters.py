"""Filter language (P)."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import filters as X
from tessera.operators import paths
from tessera.plans.registry import query

LINE = {"l_quantity": "float32", "l_returnflag": "string", "l_linenumber": "int64"}
KEYS = "l_orderkey, l_linenumber"


def lines(t, spec):
    return t.lineitem.where(X.compile_filter(spec, LINE, t.lineitem)).select("l_orderkey", "l_linenumber")


@query("p01_and", f"SELECT {KEYS} FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40")  # P1
def _(t):
    return lines(t, {"op": "and", "conds": [{"op": "must", "field": "l_returnflag", "conds": ["R"]}, {"op": "range", "field": "l_quantity", "gte": 40}]})


@query("p02_ignore_empty_condition", "SELECT p_partkey FROM part WHERE p_size <= 10")  # P2
def _(t):
    spec = {"op": "and", "ignore_empty_condition": True, "conds": [{"op": "contains", "field": "p_name", "substring": "no such name"}, {"op": "range", "field": "p_size", "lte": 10}]}
    return t.part.where(X.compile_filter(spec, {"p_size": "int64"}, t.part)).select("p_partkey")


@query("p03_or", f"SELECT {KEYS} FROM lineitem WHERE l_returnflag IN ('R', 'A') OR l_quantity < 3")  # P3, P4
def _(t):
    return lines(t, {"op": "and", "conds": [{"op": "noop"}, {"op": "or", "conds": [{"op": "must", "field": "l_returnflag", "conds": ["R", "A"]}, {"op": "range", "field": "l_quantity", "lt": 3}]}]})


@query("p05_must", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")  # P5
def _(t):
    return t.orders.where(X.compile_filter({"op": "must", "field": "o_orderstatus", "conds": ["F", "P"]})).select("o_orderkey")


@query("p06_must_multi", "SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY user_id) WHERE list_contains(k, 'error') OR list_contains(k, 'signup')")  # P6
def _(t):
    tags = t.events.groupBy("user_id").agg(F.concat_ws(";", F.collect_set("event_type")).alias("tags"))
    return tags.where(X.compile_filter({"op": "must", "field": "tags", "conds": ["error", "signup"]}, {"tags": "multi"})).select("user_id")


@query("p07_must_not", "SELECT o_orderkey FROM orders WHERE coalesce(o_orderstatus NOT IN ('F', 'P'), TRUE)")  # P7
def _(t):
    return t.orders.where(X.compile_filter({"op": "must_not", "field": "o_orderstatus", "conds": ["F", "P"]})).select("o_orderkey")


PAGE = "SELECT page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/'), lambda s: s <> ''), '/') AS path FROM pages"


def pages(t):
    return t.pages.select("page_id", paths.url_path(F.col("url")).alias("path"))


def first_host(t):
    return pages(t).agg(F.min(F.get(paths.segments(F.col("path")), F.lit(0)))).first()[0]


@query("p08_path_scope", f"WITH p AS ({PAGE}), h AS (SELECT min(string_split(path, '/')[2]) AS host FROM p) SELECT page_id FROM p, h WHERE (path = '/' || host || '/en' OR path LIKE '/' || host || '/en/%') AND len(string_split(path, '/')) - 3 <= 1")  # P8
def _(t):
    spec = {"op": "must", "field": "path", "conds": [f"/{first_host(t)}/en"], "para": "-d=1"}
    return pages(t).where(X.compile_filter(spec, {"path": "path"})).select("page_id")


@query("p09_path_exclusion", f"WITH p AS ({PAGE}), h AS (SELECT min(string_split(path, '/')[2]) AS host FROM p) SELECT page_id FROM p, h WHERE NOT (path = '/' || host OR path LIKE '/' || host || '/%')")  # P9
def _(t):
    return pages(t).where(X.compile_filter({"op": "must_not", "field": "path", "conds": ["/" + first_host(t)]}, {"path": "path"})).select("page_id")


@query("p10_range", f"SELECT {KEYS} FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")  # P10
def _(t):
    return lines(t, {"op": "range", "field": "l_quantity", "gte": 10, "gt": 99, "lt": 20})


@query("p11_range_out", f"SELECT {KEYS} FROM lineitem WHERE l_quantity < 10 OR l_quantity >= 40")  # P11
def _(t):
    return lines(t, {"op": "range_out", "field": "l_quantity", "gte": 10, "lt": 40})


@query("p12_range_2d", "SELECT p_partkey FROM part WHERE (p_size - 20.0) * (p_size - 20.0) + (p_retailprice - 910.0) * (p_retailprice - 910.0) <= 144.0")  # P12
def _(t):
    return t.part.where(X.compile_filter({"op": "range", "field": ["p_size", "p_retailprice"], "center": (20.0, 910.0), "radius": 12.0})).select("p_partkey")


@query("p13_geo_range", "SELECT c_custkey FROM (SELECT c_custkey, c_nationkey * 7.0 - 90 AS lon, fmod(abs(c_acctbal), 90.0) AS lat FROM customer) WHERE (lon + 20.0) * (lon + 20.0) + (lat - 45.0) * (lat - 45.0) <= (2500000.0 / 111320.0) * (2500000.0 / 111320.0)")  # P13
def _(t):
    c = t.customer.select("c_custkey", F.struct((F.col("c_nationkey") * 7.0 - 90).alias("lon"), (F.abs("c_acctbal") % 90.0).alias("lat")).alias("geo"))
    return c.where(X.compile_filter({"op": "geo_range", "field": "geo", "center": "-20,45", "radius": "2500km"})).select("c_custkey")


@query("p14_time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")  # P14
def _(t):
    return t.events.where(X.compile_filter({"op": "time_range", "field": "ts", "gte": "2024-01-05", "lt": "2024-01-10"})).select("event_id")


@query("p15_since_until", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' AND ts <= TIMESTAMP '2024-01-20 23:59:59.999999'")  # P15
def _(t):
    return t.events.where(X.since_until(F.col("ts"), dt.datetime(2024, 2, 1), "2w", "2024-01-20")).select("event_id")


@query("p16_prefix", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'cold')")  # P16
def _(t):
    return t.part.where(X.compile_filter({"op": "prefix", "field": "p_name", "prefix": "cold"})).select("p_partkey")


@query("p17_contains", "SELECT p_partkey FROM part WHERE contains(p_name, 'bolt')")  # P17
def _(t):
    return t.part.where(X.compile_filter({"op": "contains", "field": "p_name", "substring": "bolt"})).select("p_partkey")


@query("p18_regex", "SELECT doc_id FROM documents WHERE coalesce(regexp_matches(text, '[0-9]{3}-[0-9]{4}'), FALSE)")  # P18
def _(t):
    return t.documents.where(X.compile_filter({"op": "regex", "field": "text", "pattern": "[0-9]{3}-[0-9]{4}"})).select("doc_id")


@query("p19_label_in", "SELECT vec_id FROM embeddings WHERE vec_id IN (1, 5, 7, 250, 99999999)")  # P19
def _(t):
    return t.embeddings.where(X.compile_filter({"op": "label_in", "field": "vec_id", "labels": [1, 5, 7, 250, 99999999]})).select("vec_id")


@query("p20_nested", f"SELECT {KEYS} FROM lineitem WHERE (l_returnflag = 'N' AND l_quantity > 45) OR (NOT l_returnflag = 'N' AND l_linenumber IN (1, 2))")  # P20
def _(t):
    n = {"field": "l_returnflag", "conds": ["N"]}
    return lines(t, {"op": "or", "conds": [{}, {"op": "and", "conds": [{"op": "must", **n}, {"op": "range", "field": "l_quantity", "gt": 45}]}, {"op": "and", "conds": [{"op": "must_not", **n}, {"op": "must", "field": "l_linenumber", "conds": [1, 2]}]}]})


@query("p21_context_type", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src3')")  # P21, P22
def _(t):
    return t.documents.where(X.must(F.col("source"), [f"src{i}" for i in X.levels("1,3,x")])).select("doc_id")


@query("p23_search_tags", "SELECT event_id FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k') = '7'")  # P23
def _(t):
    tags = F.array(F.concat(F.lit("type="), "event_type"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    return t.events.where(X.has_tags(tags, "TYPE=click, k=7, type=Error")).select("event_id")


@query("p24_tag_merge", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') || ';type=new' AS tags FROM events")  # P24
def _(t):
    old = F.array(F.concat(F.lit("type="), "event_type"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    return t.events.select("event_id", F.array_join(X.merge_tags(old, F.array(F.lit("type=new"))), ";").alias("tags"))


@query("p25_visibility", f"WITH p AS ({PAGE}) SELECT page_id FROM p WHERE page_id % 3 = 0 AND (path LIKE '/%/en' OR path LIKE '/%/en/%') AND len(string_split(path, '/')) - 1 IN (2, 3) AND string_split(path, '/')[3] = 'en'")  # P25
def _(t):
    p = pages(t).withColumns({"context_type": F.lit("resource"), "account_id": (F.col("page_id") % 3).cast("string"), "level": paths.depth(F.col("path"))})
    p = p.withColumn("path", F.concat(F.lit("/"), F.array_join(F.slice(paths.segments(F.col("path")), 2, 100), "/")))
    return p.where(X.visible("resource", "0", ["/en"], path="path", lvls=[2, 3])).select("page_id")


@query("p26_projection", "SELECT vec_id, label FROM embeddings")  # P26, S1
def _(t):
    return t.embeddings.select("vec_id", "label")


@query("p27_uri", f"WITH p AS ({PAGE}) SELECT page_id, 'ctx:/' || path AS uri, path AS back FROM p")  # P27
def _(t):
    p = pages(t).withColumn("uri", paths.to_uri(F.col("path")))
    return p.select("page_id", "uri", paths.from_uri(F.col("uri")).alias("back"))


@query("p28_utf8_cut", """SELECT doc_id, octet_length(encode(x)) BETWEEN 97 AND 100 OR octet_length(encode(text)) <= 100 AS full_, starts_with(text, x) AS is_prefix
FROM (SELECT doc_id, text, CASE WHEN octet_length(encode(text)) <= 100 THEN text ELSE (SELECT max(substr(text, 1, n::BIGINT)) FROM range(20, 101) r(n) WHERE octet_length(encode(substr(text, 1, n::BIGINT))) <= 100) END AS x FROM documents WHERE text IS NOT NULL)""")  # P28
def _(t):
    from tessera.functions.text import utf8_cut

    d = t.documents.where("text IS NOT NULL").withColumn("x", utf8_cut(F.col("text"), 100))
    return d.select("doc_id", (F.octet_length("x").between(97, 100) | (F.octet_length("text") <= 100)).alias("full_"), F.startswith("text", "x").alias("is_prefix"))
