"""Vector search (V) and sorts (T)."""

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import filters as X
from tessera.operators import topk, vectors
from tessera.plans.registry import query

E = "embedding::DOUBLE[]"
Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
IP, L2 = f"list_inner_product({E}, q)", f"(1 - list_sum(list_transform(list_zip({E}, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def asked(t):
    """Embeddings with the vector of row 0 as the query."""
    return vectors.with_query(t.embeddings, "vec_id", 0)


def top(df, score, k=10, offset=0):
    return vectors.top_k(df, F.round(score, 6), "vec_id", k, offset).select("vec_id", "score")


def ranked(score: str, k: int = 10, where: str = "TRUE", offset: int = 0) -> str:
    return f"SELECT vec_id, round({score}, 6) AS score FROM embeddings, {Q} WHERE {where} ORDER BY 2 DESC, 1 LIMIT {k} OFFSET {offset}"


@query("v01_inner_product", ranked(IP))  # V1, V12, V16
def _(t):
    return top(asked(t), vectors.inner(F.col("embedding"), F.col("qvec")))


@query("v02_l2", ranked(L2))  # V2
def _(t):
    return top(asked(t), vectors.l2_score(F.col("embedding"), F.col("qvec")))


@query("v03_cosine", ranked(f"{IP} / (sqrt(list_inner_product({E}, {E})) * sqrt(list_inner_product(q, q)))"))  # V3
def _(t):
    return top(asked(t), vectors.cosine(F.col("embedding"), F.col("qvec")))


@query("v04_truncate", f"SELECT vec_id, round(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])))), 6) AS total FROM embeddings")  # V4
def _(t):
    v = vectors.truncated(F.col("embedding"), 16)
    return t.embeddings.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


Q8 = f"list_transform({E}, lambda x: (sign(x) * least(127, floor(abs(x) / (list_max(list_transform({E}, lambda y: abs(y))) / 127) + 0.5)))::INT)"


@query("v05_int8", f"SELECT vec_id, CAST(list_sum({Q8}) AS BIGINT) AS total, CAST(list_max({Q8}) AS INT) AS most FROM embeddings")  # V5
def _(t):
    v = vectors.int8(F.col("embedding"))
    return t.embeddings.select("vec_id", F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(v).alias("most"))


@query("v06_int8_inner_product", f"""WITH z AS (SELECT vec_id, {Q8} AS v, list_max(list_transform({E}, lambda y: abs(y))) / 127 AS s FROM embeddings), o AS (SELECT v AS qv, s AS qs FROM z WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(v::DOUBLE[], qv::DOUBLE[]) * s * qs, 6) AS score FROM z, o ORDER BY 2 DESC, 1 LIMIT 10""")  # V6
def _(t):
    return top(asked(t), vectors.int8_inner(F.col("embedding"), F.col("qvec")))


TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents"
SPARSE = f"WITH s AS (SELECT doc_id, t, count(*) AS c FROM ({TOKENS}) GROUP BY ALL), q AS (SELECT t, c FROM s WHERE doc_id = 1)"


def sparse(t):
    """Documents that have words as maps from word to count, with the map of document 1 as the query."""
    docs = t.documents.select("doc_id", "text")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that share an id are one document
        docs = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    maps = docs.where(F.lower("text").rlike("[a-z]")).select("doc_id", TX.word_counts(F.col("text")).alias("sparse"))
    return maps.withColumn("q", maps.where("doc_id = 1").select("sparse").scalar())


@query("v07_sparse_dot", f"{SPARSE} SELECT doc_id, CAST(sum(s.c * coalesce(q.c, 0)) AS DOUBLE) AS score FROM s LEFT JOIN q USING (t) GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 20")  # V7
def _(t):
    score = F.coalesce(vectors.sparse_inner(F.col("q"), F.col("sparse")), F.lit(0.0))
    return vectors.top_k(sparse(t), score, "doc_id", 20).select("doc_id", "score")


@query("v08_sparse_l2", f"{SPARSE}, n AS (SELECT sum(c * c) AS n FROM q) SELECT doc_id, CAST(sum(s.c * s.c) - 2 * sum(s.c * coalesce(q.c, 0)) + max(n.n) AS DOUBLE) AS distance FROM s LEFT JOIN q USING (t), n GROUP BY doc_id ORDER BY 2, 1 LIMIT 20")  # V8
def _(t):
    d = sparse(t).withColumn("distance", vectors.sparse_l2(F.col("q"), F.col("sparse")))
    return d.orderBy("distance", "doc_id").limit(20).select("doc_id", "distance")


@query("v09_hybrid", ranked(f"(0.7 * {IP} + 0.3 * (label / 10.0))"))  # V9
def _(t):
    return top(asked(t), vectors.hybrid(vectors.inner(F.col("embedding"), F.col("qvec")), F.col("label") / 10.0, 0.3))


@query("v10_filtered_topk", ranked(IP, where="label IN (1, 3)"))  # V10
def _(t):
    keep = X.compile_filter({"op": "must", "field": "label", "conds": [1, 3]}, {"label": "int64"})
    return top(asked(t).where(keep), vectors.inner(F.col("embedding"), F.col("qvec")))


@query("v11_pagination", ranked(IP, k=10, offset=20))  # V11
def _(t):
    return top(asked(t), vectors.inner(F.col("embedding"), F.col("qvec")), 10, 20)


@query("v13_random", "SELECT vec_id FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 10")  # V13
def _(t):
    return vectors.random_order(t.embeddings, "vec_id", 7, 10).select("vec_id")


BM = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, len(w)::DOUBLE AS len, len(list_filter(w, lambda x: x = 'that'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'estion'))::DOUBLE AS b FROM w),
s AS (SELECT (SELECT count(*) FROM documents) AS n, avg(len) AS avg, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM x)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avg)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / avg)), 6) AS score
FROM x, s WHERE a > 0 OR b > 0"""


@query("v14_bm25", BM)  # V14
def _(t):
    return TX.bm25(t.documents, "doc_id", "text", ["that", "estion"]).withColumn("score", F.round("score", 6))


@query("v17_clean_scores", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS score FROM events")  # V17
def _(t):
    return t.events.select("event_id", vectors.clean(F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))).alias("score"))


@query("v19_batched_knn", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.{E}, b.{E}) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")  # V19
def _(t):
    q = t.embeddings.where("vec_id % 20 = 0")
    return vectors.knn(q, t.embeddings, key="vec_id", vec="embedding", k=10).withColumn("score", F.round("score", 6))


@query("t01_scalar_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")  # T1
def _(t):
    return topk.top(t.orders, [("o_totalprice", "desc")], "o_orderkey", 25).select("o_orderkey", "o_totalprice")


@query("t02_multi_sort", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")  # T2, T4
def _(t):
    return topk.top(t.orders, [("o_orderpriority", "asc"), ("o_totalprice", "desc")], "o_orderkey", 25).select("o_orderkey", "o_orderpriority")


@query("t03_center", "SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 950.05), p_retailprice, p_partkey LIMIT 15")  # T3
def _(t):
    return topk.nearest(t.part, "p_retailprice", 950.05, "p_partkey", 15).select("p_partkey", "p_retailprice")


@query("t05_search_by_scalar", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10 OFFSET 5")  # T5
def _(t):
    return t.lineitem.where("l_returnflag = 'R'").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").offset(5).limit(10).select("l_orderkey", "l_linenumber")


@query("t06_quota", "SELECT lang, doc_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")  # T6
def _(t):
    return topk.quota(t.documents, "lang", F.col("n_chars"), "doc_id", 5).select("lang", "doc_id", "rank")


@query("t07_spread_sample", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, i AS "index" FROM r WHERE i IN (SELECT (k * (n - 1)) // 31 FROM range(32) x(k))""")  # T7
def _(t):
    return topk.spread_sample(t.documents.select("doc_id"), "doc_id", 32).select("doc_id", F.col("index").cast("long"))
