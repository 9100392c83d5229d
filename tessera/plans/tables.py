"""Tables that change (S), joins (J) and sets (U)."""

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import changes as C
from tessera.operators import filters as X
from tessera.operators import memory, paths, snapshots, topk, usage
from tessera.plans.registry import query
from tessera.sources import files
from tessera.sources.store import fresh_path


@query("s02_scroll", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")  # S2, S11
def _(t):
    return topk.scroll(t.orders.where("o_orderstatus = 'F'"), "o_orderkey", 100, 50).select("o_orderkey", "o_totalprice")


@query("s03_fetch", "SELECT k AS c_custkey, c_name FROM (VALUES (1), (7), (149), (10000000)) v(k) LEFT JOIN customer ON c_custkey = k")  # S3
def _(t):
    keys = t.spark.createDataFrame([(1,), (7,), (149,), (10_000_000,)], "c_custkey bigint")
    found, missing = C.fetch(t.customer, keys, "c_custkey")
    return found.select("c_custkey", "c_name").unionByName(missing.withColumn("c_name", F.lit(None).cast("string")))


LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events {}) WHERE rn = 1"


@query("s04_upsert", f"SELECT user_id, event_id, value FROM ({LAST.format('')})")  # S4, S10
def _(t):
    e = t.events.select("user_id", "ts", "event_id", "value")
    return C.upsert(e.where("ts < '2024-01-15'"), e.where("ts >= '2024-01-15'"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("s05_update", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 AND c_acctbal >= 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")  # S5
def _(t):
    patch = t.customer.where("c_custkey % 10 = 0").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return C.update(t.customer, patch, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("s06_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')")  # S6
def _(t):
    keys = t.customer.where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    return C.delete(t.orders, keys, "o_custkey").select("o_orderkey")


@query("s07_delete_by_filter", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value > 50)")  # S7
def _(t):
    spec = {"op": "and", "conds": [{"op": "must", "field": "event_type", "conds": ["error"]}, {"op": "range", "field": "value", "gt": 50}]}
    return C.delete_where(t.events, X.compile_filter(spec)).select("event_id")


@query("s08_expiry", "SELECT event_id FROM events WHERE ts + to_seconds(floor(value)::BIGINT * 3600) > TIMESTAMP '2024-01-20'")  # S8, R7
def _(t):
    ends = F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.floor("value").cast("int"))
    return C.alive(t.events, ends, F.lit("2024-01-20").cast("timestamp_ntz").cast("timestamp")).select("event_id")


@query("s09_replay", f"SELECT user_id, event_id, value FROM ({LAST.format("WHERE ts > TIMESTAMP '2024-01-10'")}) WHERE event_type <> 'error'")  # S9
def _(t):
    log = t.events.select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "value", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("op"))
    return C.replay(log, "user_id", "at", "op", F.struct(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit(1 << 62).cast("bigint"))).select("user_id", "event_id", "value")


PAGE = "SELECT page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/'), lambda s: s <> ''), '/') AS path FROM pages"


def pages(t):
    return t.pages.select("page_id", paths.url_path(F.col("url")).alias("path"))


@query("s12_copy_scope", f"WITH p AS ({PAGE}) SELECT page_id, CASE WHEN path LIKE '/m.%' THEN '/mobile/m.' || substr(path, 4) ELSE path END AS path, 0 AS active_count FROM p")  # S12
def _(t):
    p = pages(t).withColumn("path", F.concat(F.lit("/x"), F.when(F.startswith("path", F.lit("/m.")), F.concat(F.lit("/m"), "path")).otherwise(F.concat(F.lit("/o"), "path"))))
    moved = C.rewritten(C.rewritten(F.col("path"), "/x/m", "/mobile"), "/x/o", "")
    return p.select("page_id", moved.alias("path"), F.lit(0).alias("active_count"))


@query("s13_parse_html", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' \n\r\t') AS title, len(regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"]*)\"', 1)) AS n_links FROM pages")  # S13
def _(t):
    return t.pages.select("page_id", F.btrim(TX.html_title(F.col("html")), F.lit(" \n\r\t")).alias("title"), F.size(TX.html_links(F.col("html"))).alias("n_links"))


@query("s16_pack", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")  # S16
def _(t):
    path = fresh_path(t.spark, "pack")
    C.export_pack(t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice"), path, "o_orderkey")
    return C.import_pack(t.spark, path, "o_orderkey")


@query("s17_snapshot_diff", """WITH a AS (SELECT o_orderkey, md5(o_orderstatus) AS d FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) AS d FROM orders WHERE o_orderkey % 11 <> 0)
SELECT o_orderkey, CASE WHEN b.d IS NULL THEN 'delete' WHEN a.d IS NULL OR a.d <> b.d THEN 'write' ELSE 'same' END AS change FROM a FULL JOIN b USING (o_orderkey)""")  # S17, J6
def _(t):
    old = t.orders.where("o_orderkey % 10 <> 0").select("o_orderkey", F.md5("o_orderstatus").alias("d"))
    new = t.orders.where("o_orderkey % 11 <> 0").select("o_orderkey", F.md5(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("d"))
    return C.diff(old, new, "o_orderkey", "d")


@query("s14_scan", "SELECT r_name AS name, r_regionkey + 1 AS size FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')")  # S14
def _(t):
    """A file for each region, in folders by name; some folders and suffixes are left out."""
    path = fresh_path(t.spark, "scan")
    text = F.expr("repeat('x', r_regionkey)")
    t.region.select(text.alias("text"), F.col("r_name").alias("name")).repartition(5, "name").write.partitionBy("name").text(path)
    found = files.scan(t.spark, path, include=["*.txt"], exclude=["name=ASIA/*", "name=EUR*/*"])
    return found.select(F.regexp_extract("path", "name=([A-Z %0-9]+)/", 1).alias("name"), "size")


@query("s16_pack_vectors", "SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm FROM embeddings")  # S16
def _(t):
    path = fresh_path(t.spark, "backup")
    C.export_pack(t.embeddings, path, "vec_id")
    e = C.import_pack(t.spark, path, "vec_id")
    return e.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


def history(t):
    """Two versions of the orders' states, committed; the second changes, adds and deletes."""
    root = fresh_path(t.spark, "history")
    path = F.concat(F.lit("/orders/"), "o_orderkey")
    snapshots.commit(t.orders.where("o_orderkey % 10 <> 0").select(path.alias("path"), F.col("o_orderstatus").alias("content")), root, "first", "a")
    snapshots.commit(t.orders.where("o_orderkey % 11 <> 0").select(path.alias("path"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("content")), root, "second", "b")
    return root


@query("s17_log", "SELECT 1 AS version, 'first' AS message, count(*) AS files FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 2, 'second', count(*) FROM orders WHERE o_orderkey % 11 <> 0")  # S17
def _(t):
    return snapshots.log(t.spark, history(t)).select("version", "message", "files")


@query("s17_show_diff", """WITH a AS (SELECT o_orderkey, o_orderstatus AS d FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS d FROM orders WHERE o_orderkey % 11 <> 0)
SELECT '/orders/' || o_orderkey AS path, CASE WHEN b.d IS NULL THEN 'delete' WHEN a.d IS NULL OR a.d <> b.d THEN 'write' ELSE 'same' END AS change FROM a FULL JOIN b USING (o_orderkey)""")  # S17
def _(t):
    return snapshots.diff(t.spark, history(t), 1, 2)


@query("s17_restore", "SELECT '/orders/' || o_orderkey AS path, o_orderstatus AS content FROM orders WHERE o_orderkey % 10 <> 0")  # S17
def _(t):
    return snapshots.restore(t.spark, history(t), 1)


@query("s20_agent_log", "SELECT conv_id, turn, CASE role WHEN 'system' THEN 'tool' ELSE role END AS role FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")  # S20
def _(t):
    return files.agent_log(t.conversations).select("conv_id", "turn", "role")


@query("j01_hydrate", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)")  # J1
def _(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "source", "quality")


@query("j02_consistency", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")  # J2
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("j03_graph_edges", """WITH e AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS source, 'r' || (s_nationkey % 7) AS target, 'in' AS link_type FROM supplier), v AS (SELECT 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region)
SELECT source, target, link_type, min(id) AS id FROM e WHERE source IN (SELECT node FROM v) AND target IN (SELECT node FROM v) GROUP BY ALL""")  # J3
def _(t):
    edges = t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("r"), F.col("s_nationkey") % 7).alias("target"), F.lit("in").alias("link_type"), F.col("s_suppkey").alias("id"))
    nodes = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node")).unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node")))
    return memory.valid_edges(edges, nodes, "id")


@query("j04_children", "SELECT n_name, c_custkey, CAST(rank AS INT) AS rank FROM (SELECT n_name, c_custkey, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rank FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE rank <= 3")  # J4
def _(t):
    kids = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return topk.quota(kids, "n_name", F.col("c_acctbal"), "c_custkey", 3).select("n_name", "c_custkey", "rank")


@query("j05_containment", f"WITH p AS ({PAGE}), t AS (SELECT DISTINCT '/' || string_split(path, '/')[2] || '/en' AS target FROM p WHERE page_id % 5 = 0) SELECT DISTINCT page_id FROM p JOIN t ON path = target OR starts_with(path, target || '/')")  # J5
def _(t):
    targets = pages(t).where("page_id % 5 = 0").select(F.concat(F.lit("/"), F.get(paths.segments(F.col("path")), F.lit(0)), F.lit("/en/")).alias("target"))
    return paths.contained(pages(t), "path", targets, "target").select("page_id").distinct()


@query("j08_evidence", "SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")  # J8
def _(t):
    return evidence(t)


def evidence(t):
    """How many documents have an item whole: candidates share the item's rarest-looking line start (an equality
    join on lines), and contain the text."""
    from tessera.operators.text_join import containing

    pairs = containing(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")
    n = pairs.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return t.benchmark.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query("j09_link_pairs", "SELECT a.n_name AS from_name, b.n_name AS to_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")  # J9
def _(t):
    a = t.nation.select("n_regionkey", F.col("n_name").alias("from_name"))
    b = t.nation.select("n_regionkey", F.col("n_name").alias("to_name"))
    return a.join(b, "n_regionkey").where("from_name <> to_name").select("from_name", "to_name")


@query("j10_resource_refs", """WITH m AS (SELECT c_custkey AS memory, unnest(['/docs/n' || c_nationkey || '/f' || c_custkey, '/docs/n' || (c_custkey % 25)]) AS ref FROM customer), r AS (SELECT '/docs/n' || n_nationkey AS resource FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT '/docs/n1/f' || c_custkey FROM customer WHERE c_nationkey = 1)
SELECT DISTINCT memory, 'ctx:/' || resource AS resource FROM m JOIN r ON ref = resource OR starts_with(ref, resource || '/')""")  # J10
def _(t):
    ref = lambda *x: F.concat(F.lit("ctx://docs/n"), *x)
    m = t.customer.select(F.col("c_custkey").alias("memory"), F.array(ref("c_nationkey", F.lit("/f"), "c_custkey"), ref(F.col("c_custkey") % 25)).alias("refs"))
    r = t.nation.where("n_nationkey % 2 = 0").select(ref("n_nationkey").alias("resource")).unionByName(t.customer.where("c_nationkey = 1").select(ref("c_nationkey", F.lit("/f"), "c_custkey").alias("resource")))
    return usage.referencing(m, r)


@query("d10_plugin", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events")  # D10
def _(t):
    return files.sections(t.events.select("event_id", "props"), "props", files.JsonFields).select("event_id", "name", "value")


@query("u01_set_algebra", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10) EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")  # U1, U2
def _(t):
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = t.customer.where("c_nationkey < 10").select(F.col("c_custkey").alias("k"))
    return a.intersect(b).subtract(t.events.where("event_type = 'error' AND value > 90").select(F.col("user_id").alias("k")))


@query("u03_keep_best", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")  # U3
def _(t):
    return C.best(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


@query("u04_buckets", "SELECT event_type, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 100) GROUP BY 1")  # U4
def _(t):
    hits = t.events.orderBy(F.desc("value"), "event_id").limit(100)
    return hits.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("ids"))


@query("u05_exact_body_dedupe", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))")  # U5, U6
def _(t):
    return C.first_of(t.documents.select("doc_id", "text"), TX.body_key(F.col("text")), "doc_id").select("doc_id")
