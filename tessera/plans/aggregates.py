"""Counts and statistics (A)."""

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import aggregates as A
from tessera.operators import usage
from tessera.operators import retrieval
from tessera.plans.registry import query


@query("a01_total_count", "SELECT count(*) AS n FROM orders")  # A1
def _(t):
    return t.orders.agg(F.count("*").alias("n"))


@query("a02_filtered_count", "SELECT count(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24")  # A2
def _(t):
    return t.lineitem.where("l_discount >= 0.05 AND l_quantity < 24").agg(F.count("*").alias("n"))


@query("a03_group_count", "SELECT l_returnflag AS key, count(*) AS count FROM lineitem GROUP BY 1")  # A3, A7
def _(t):
    return A.group_count(t.lineitem, ["l_returnflag"])


@query("a03_group_count_multi", "SELECT t AS key, count(*) AS count FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS t FROM documents) GROUP BY 1 HAVING count(*) > 100")
def _(t):
    d = t.documents.select(F.array_distinct(TX.words(F.col("text"))).alias("w"))
    return A.group_count(d, ["w"], multi=True, gt=100)


@query("a04_group_count_two", "SELECT l_returnflag || ',' || l_linestatus AS key, count(*) AS count FROM lineitem GROUP BY 1")  # A4
def _(t):
    return A.group_count(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("a05_having", "SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 12")  # A5
def _(t):
    return A.group_count(t.orders, ["o_custkey"], gt=12)


@query("a06_max_entry", "SELECT CAST(c_nationkey AS VARCHAR) AS key, count(*) AS count FROM customer GROUP BY 1 ORDER BY 1 LIMIT 10")  # A6
def _(t):
    return A.group_count(t.customer, ["c_nationkey"], max_entry=10)


HOT = "1 / (1 + exp(-ln(1 + n::DOUBLE))) * exp(-ln(2) / 7 * age)"
USERS = "SELECT user_id, count(*) AS n, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01') / 86400.0 AS age FROM events GROUP BY user_id"


def users(t):
    age = (F.unix_seconds(F.lit("2024-02-01").cast("timestamp_ntz").cast("timestamp")) - F.unix_seconds(F.max("ts").cast("timestamp"))) / 86400.0
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), age.alias("age"))


@query("a08_memory_stats", f"""SELECT count(*) FILTER (h < 0.2) AS cold, count(*) FILTER (h >= 0.2 AND h <= 0.6) AS warm, count(*) FILTER (h > 0.6) AS hot, count(*) FILTER (age > 7) AS stale_7, round(max(age), 1) AS oldest
FROM (SELECT *, round({HOT}, 9) AS h FROM ({USERS}))""")  # A8
def _(t):
    u = users(t).withColumn("h", F.round(retrieval.hotness(F.col("n"), F.col("age")), 9))
    return u.agg(F.count_if(F.expr("h < 0.2")).alias("cold"), F.count_if(F.expr("h >= 0.2 AND h <= 0.6")).alias("warm"), F.count_if(F.expr("h > 0.6")).alias("hot"), F.count_if(F.expr("age > 7")).alias("stale_7"), F.round(F.max("age"), 1).alias("oldest"))


@query("a09_retrieval_stats", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value < 1 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg FROM events GROUP BY 1")  # A9
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") < 1, 1.0).otherwise(0.0)), 6).alias("zero_rate"), F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"), F.round(F.avg("value"), 6).alias("avg"))


@query("a10_scores", "SELECT count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM events")  # A10
def _(t):
    return A.scores(t.events, "value")


@query("a11_histogram", """WITH b AS (SELECT CASE WHEN value <= 1 THEN '1' WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' ELSE '+Inf' END AS le, CASE WHEN value <= 1 THEN 0 WHEN value <= 10 THEN 1 WHEN value <= 50 THEN 2 WHEN value <= 100 THEN 3 ELSE 4 END AS o, event_type, value FROM events)
SELECT event_type, le, count(*) AS count, round(sum(value), 4) AS sum, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY o) AS BIGINT) AS cumulative FROM b GROUP BY event_type, le, o""")  # A11, A19
def _(t):
    return A.histogram(t.events, "value", [1, 10, 50, 100], ["event_type"]).withColumn("sum", F.round("sum", 4))


@query("a12_latency", """SELECT event_type, count(*) AS n, round(avg(CASE WHEN value < 100 THEN 1.0 ELSE 0.0 END), 6) AS success, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events GROUP BY 1""")  # A12
def _(t):
    return A.latency(t.events, "event_type", "value", F.col("value") < 100)


@query("a13_median_mad", "SELECT event_type, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM events GROUP BY 1")  # A13
def _(t):
    return A.median_mad(t.events, "event_type", "value")


@query("a14_token_f1", """WITH p AS (SELECT b.item_id, regexp_extract_all(lower(b.text), '[a-z]+') AS a, regexp_extract_all(lower(d.text), '[a-z]+') AS g FROM benchmark b JOIN documents d ON b.item_id = d.doc_id WHERE d.text IS NOT NULL),
x AS (SELECT item_id, t, count(*) AS x FROM (SELECT item_id, unnest(a) AS t FROM p) GROUP BY ALL), y AS (SELECT item_id, t, count(*) AS y FROM (SELECT item_id, unnest(g) AS t FROM p) GROUP BY ALL),
s AS (SELECT item_id, sum(least(x, y)) AS same FROM x JOIN y USING (item_id, t) GROUP BY item_id), r AS (SELECT p.item_id, coalesce(same, 0) / nullif(len(a), 0)::DOUBLE AS pr, coalesce(same, 0) / nullif(len(g), 0)::DOUBLE AS re FROM p LEFT JOIN s USING (item_id))
SELECT item_id, round(coalesce(pr, 0), 6) AS precision, round(coalesce(re, 0), 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM r""")  # A14
def _(t):
    p = t.benchmark.select("item_id", F.col("text").alias("a")).join(t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("g")).where("g IS NOT NULL"), "item_id")
    return A.token_f1(p, "item_id", TX.words(F.col("a")), TX.words(F.col("g")))


@query("a15_usage_counters", "SELECT c_custkey, c_nationkey + coalesce(n, 0) AS active_count FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey")  # A15
def _(t):
    n = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", (F.col("c_nationkey") + F.coalesce("n", F.lit(0))).alias("active_count"))


@query("a16_queue_status", "SELECT user_id % 5 AS queue, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS in_progress, count(*) FILTER (event_type = 'purchase') AS processed, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")  # A16
def _(t):
    kinds = {"pending": "view", "in_progress": "click", "processed": "purchase", "errors": "error"}
    return t.events.groupBy((F.col("user_id") % 5).alias("queue")).agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])


@query("a17_rollouts", """WITH e AS (SELECT doc_id % 4 AS epoch, avg(quality) AS pass FROM labels GROUP BY 1)
SELECT a.epoch, round(a.pass, 6) AS pass_rate, round(a.pass - b.pass, 6) AS delta FROM e a LEFT JOIN e b ON b.epoch = a.epoch - 1""")  # A17
def _(t):
    e = t.labels.groupBy((F.col("doc_id") % 4).alias("epoch")).agg(F.avg("quality").alias("rate"))
    b = e.select((F.col("epoch") + 1).alias("epoch"), F.col("rate").alias("before"))
    return e.join(b, "epoch", "left").select("epoch", F.round("rate", 6).alias("pass_rate"), F.round(F.col("rate") - F.col("before"), 6).alias("delta"))


@query("a18_io_records", "SELECT event_type AS operation, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) FILTER (value < 100) AS ok, round(100.0 * count(*) FILTER (value < 100) / count(*), 4) AS ok_percent, CAST(min(ts)::DATE AS VARCHAR) AS first, CAST(max(ts)::DATE AS VARCHAR) AS last FROM events GROUP BY 1")  # A18
def _(t):
    ok = F.count_if(F.expr("value < 100"))
    return t.events.groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), ok.alias("ok"), F.round(100.0 * ok / F.count("*"), 4).alias("ok_percent"), F.min("ts").cast("date").cast("string").alias("first"), F.max("ts").cast("date").cast("string").alias("last"))


PART = "CASE WHEN turn % 3 = 0 THEN 'memory_search' WHEN turn % 3 = 1 THEN 'memory_read' ELSE 'shell' END"


@query("a20_usage_events", f"""WITH p AS (SELECT conv_id, turn, {PART} AS tool, turn % 5 <> 4 AS done, [conv_id % 7, turn, turn % 2] AS ids FROM conversations WHERE role <> 'user'),
u AS (SELECT conv_id, turn, CASE tool WHEN 'memory_search' THEN 'recall' ELSE 'injection' END AS kind, unnest(list_distinct(ids)) AS id FROM p WHERE done AND tool <> 'shell')
SELECT 'ctx://user/u1/memories/experiences/e' || id || '.md' AS uri, kind, count(*) AS n FROM u GROUP BY ALL""")  # A20
def _(t):
    m = t.conversations.where("role <> 'user'")
    links = F.transform(F.array(F.col("conv_id") % 7, F.col("turn"), F.col("turn") % 2), lambda i: F.concat(F.lit("see <ctx://user/u1/memories/experiences/e"), i, F.lit(".md>, not ctx://user/u1/memories/cases/c.md")))
    parts = m.select(F.concat_ws("-", "conv_id", "turn").alias("message"), F.expr(PART).alias("tool"), F.when(F.col("turn") % 5 != 4, "completed").otherwise("error").alias("status"), F.array_join(links, "; ").alias("output"))
    return usage.counts(usage.events(parts))


@query("ax_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
