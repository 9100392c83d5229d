"""Retrieval and context assembly (H), sessions (H16-H18, R1-R4), memory (D)."""

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import assembly, memory, retrieval, sessions, summaries, topk, vectors
from tessera.plans.aggregates import HOT, USERS, users
from tessera.plans.registry import query

IP = "list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
SCORED = f"SELECT vec_id, label, round({IP}, 6) AS score FROM embeddings"


def scored(t):
    return vectors.with_query(t.embeddings, "vec_id", 0).select("vec_id", "label", F.round(vectors.inner(F.col("embedding"), F.col("qvec")), 6).alias("score"))


@query("h01_quick", f"SELECT label AS uri, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM ({SCORED}) WHERE score > 0.1) WHERE rn = 1 ORDER BY score DESC, vec_id LIMIT 10")  # H1
def _(t):
    return retrieval.quick(scored(t).withColumnRenamed("label", "uri"), uri="uri", score="score", limit=10, threshold=0.1, key="vec_id")


NODES = """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS uri, NULL AS parent_uri, 0.5 AS score FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, (n_nationkey % 5) / 5.0 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, (c_custkey % 100) / 100.0 FROM customer),"""


def nodes(t):
    r = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("uri"), F.lit(None).cast("string").alias("parent_uri"), F.lit(0.5).alias("score"), F.lit(False).alias("is_leaf"))
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("uri"), F.concat(F.lit("r"), "n_regionkey").alias("parent_uri"), ((F.col("n_nationkey") % 5) / 5.0).alias("score"), F.lit(False).alias("is_leaf"))
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("uri"), F.concat(F.lit("n"), "c_nationkey").alias("parent_uri"), ((F.col("c_custkey") % 100) / 100.0).alias("score"), F.lit(True).alias("is_leaf"))
    return r.unionByName(n).unionByName(c)


@query("h03_expand_all", NODES + """ x AS (SELECT uri, 0 AS level, CAST(score AS DOUBLE) AS final FROM n WHERE parent_uri IS NULL UNION ALL
SELECT n.uri, x.level + 1, CASE WHEN x.final <> 0 THEN 0.5 * n.score + 0.5 * x.final ELSE n.score END FROM n JOIN x ON n.parent_uri = x.uri) SELECT uri, level, round(final, 6) AS final FROM x""")  # H3, H4
def _(t):
    n = nodes(t)
    return retrieval.expand_all(n, n.where("parent_uri IS NULL").select("uri", F.col("score").alias("final"))).withColumn("final", F.round("final", 6))


@query("h02_best_first")  # H2, H3: stops early, tested by brute force
def _(t):
    n = nodes(t)
    return retrieval.best_first(n, n.where("parent_uri IS NULL").select("uri", F.col("score").alias("final")), limit=10)


@query("h05_hotness", f"SELECT user_id, round({HOT}, 6) AS hot FROM ({USERS})")  # H5
def _(t):
    return users(t).select("user_id", F.round(retrieval.hotness(F.col("n"), F.col("age")), 6).alias("hot"))


@query("h06_blend", f"SELECT vec_id, round(0.8 * s.score + 0.2 * coalesce({HOT}, 0), 5) AS score FROM ({SCORED}) s LEFT JOIN ({USERS}) u ON u.user_id = s.vec_id")  # H6
def _(t):
    u = users(t).select(F.col("user_id").alias("vec_id"), retrieval.hotness(F.col("n"), F.col("age")).alias("hot"))
    both = scored(t).join(u, "vec_id", "left")
    return both.select("vec_id", F.round(retrieval.blended(F.col("score"), F.coalesce("hot", F.lit(0.0)), 0.2), 5).alias("score"))


@query("h07_rerank", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN -1.0 ELSE round(len(list_intersect(['estion', 'that', 'zzz'], regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) / 3.0, 6) END AS score FROM documents")  # H7, D8
def _(t):
    d = t.documents.select("doc_id", "text", F.lit(-1.0).alias("score"))
    return retrieval.reranked(d, "text", "score", lambda c: F.round(retrieval.overlap(["That", "estion", "zzz"], c), 6)).select("doc_id", "score")


@query("h09_peer_penalty", f"SELECT vec_id, round(score - CASE WHEN vec_id % 2 = 1 AND label = 3 THEN 0.2 WHEN vec_id % 2 = 1 AND label = 5 THEN 0.1 ELSE 0 END, 6) AS ranked FROM ({SCORED})")  # H9
def _(t):
    origin = F.when(F.col("vec_id") % 2 == 1, "other_peer").otherwise("self")
    return scored(t).select("vec_id", F.round(retrieval.penalised(F.col("score"), origin, F.col("label").cast("string"), {"3": 0.2, "5": 0.1}), 6).alias("ranked"))


def candidates(t):
    """The 20 longest documents of each language, with the tokens of their tiers."""
    d = topk.quota(t.documents.where("text IS NOT NULL"), "lang", F.col("n_chars").cast("double"), "doc_id", 20)
    tiers = {"a": assembly.abstract(F.col("text")), "o": assembly.overview(F.col("text")), "f": F.col("text")}
    return d.select("lang", "doc_id", "score", *[X.estimate_tokens(c).alias(n) for n, c in tiers.items()])


@query("h10_pack")  # H10: an ordered fold, tested by brute force
def _(t):
    return assembly.pack(candidates(t), query="lang", key="doc_id", score="score", sizes=["a", "o", "f"], budget=4000)


@query("h11_tiers", r"SELECT doc_id, substr(regexp_extract(text, '(?m)^\s*(\S.*?)\s*$', 1), 1, 120) AS abstract FROM documents")  # H11
def _(t):
    return t.documents.select("doc_id", assembly.abstract(F.col("text")).alias("abstract"))


@query("h11_overview", r"""SELECT doc_id, substr(regexp_extract(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '(?s)^(.*?)(\n\s*\n|$)', 1), 1, 400) AS overview FROM documents WHERE NOT regexp_matches(text, '(?m)^#{1,6} ')""")  # H11
def _(t):
    return t.documents.select("doc_id", assembly.overview(F.col("text")).alias("overview"))


@query("h12_prune", "SELECT event_id % 700 AS uri, max(user_id) AS turn FROM events WHERE user_id > 2 GROUP BY 1 ORDER BY turn DESC, uri LIMIT 500")  # H12
def _(t):
    return assembly.pruned(t.events.select((F.col("event_id") % 700).alias("uri"), F.col("user_id").alias("turn")), uri="uri", turn="turn", now=10, turns=2)


@query("h13_overfetch", f"WITH x AS (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 3), s AS (SELECT * FROM ({SCORED}) ORDER BY score DESC, vec_id LIMIT 12 + least((SELECT count(*) FROM x), 24)) SELECT vec_id, score FROM s WHERE vec_id NOT IN (SELECT vec_id FROM x) ORDER BY score DESC, vec_id LIMIT 12")  # H13
def _(t):
    left_out = t.embeddings.where("vec_id % 20 = 3").select("vec_id")
    return retrieval.without(scored(t), left_out, key="vec_id", score="score", want=12).select("vec_id", "score")


LEAVES = f"SELECT path, '/' || string_split(path, '/')[2] AS d1, '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3] AS d2, 'page ' || path AS abstract FROM (SELECT DISTINCT '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/'), lambda s: s <> ''), '/') AS path FROM pages)"
KIDS = "list_filter(list_transform(generate_series(0, least(len({x}), 32) - 1), lambda k: {x}[1 + CASE WHEN len({x}) <= 32 THEN k ELSE k * (len({x}) - 1) // 31 END]), lambda v: v IS NOT NULL)"


@query("h22_bottom_up", f"""WITH l AS ({LEAVES}), a AS (SELECT d2 AS path, list(abstract ORDER BY path) AS c FROM l GROUP BY d2), b AS (SELECT path, len(c) AS children, {KIDS.format(x="c")} AS c FROM a), b2 AS (SELECT path, '/' || string_split(path, '/')[2] AS up, children, substr(c[1], 1, 120) AS abstract, array_to_string(c, chr(10)) AS overview FROM b),
d AS (SELECT up AS path, list(abstract ORDER BY path) AS c FROM b2 GROUP BY up), e AS (SELECT path, len(c) AS children, {KIDS.format(x="c")} AS c FROM d), e2 AS (SELECT path, children, substr(c[1], 1, 120) AS abstract, array_to_string(c, chr(10)) AS overview FROM e),
r AS (SELECT list(abstract ORDER BY path) AS c FROM e2), r2 AS (SELECT '/' AS path, len(c) AS children, {KIDS.format(x="c")} AS c FROM r)
SELECT path, abstract, overview, children FROM b2 UNION ALL SELECT path, abstract, overview, children FROM e2 UNION ALL SELECT path, substr(c[1], 1, 120), array_to_string(c, chr(10)), children FROM r2""")  # H22
def _(t):
    from tessera.plans.texts import pages

    leaves = pages(t).select("path").distinct().withColumn("abstract", F.concat(F.lit("page "), "path"))
    return summaries.bottom_up(leaves, "path", "abstract")


@query("h12_ledger", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT event_id FROM events WHERE event_type <> 'view' AND user_id > 90)")  # H12, J7
def _(t):
    ledger = t.events.select(F.col("event_id").alias("doc_id"), "user_id", F.when(F.col("event_type") == "view", "uri").otherwise("full").alias("detail"))
    return assembly.cooled(t.documents, ledger, uri="doc_id", turn="user_id", now=100, turns=10).select("doc_id")


@query("h14_render", """SELECT item_id, '<memory uri="ctx://b/' || item_id || '" score="0.5" detail="full">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</memory>' AS xml FROM benchmark""")  # H14
def _(t):
    return t.benchmark.select("item_id", assembly.rendered(F.concat(F.lit("ctx://b/"), "item_id"), F.lit(0.5), F.lit("full"), F.col("text")).alias("xml"))


TURN = "SELECT *, sum((role = 'user')::INT) OVER w AS turn_id, sum((role = 'assistant')::INT) OVER w AS steps, ceil(length(text) * 0.25)::BIGINT AS tok FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


@query("h16_turns", f"SELECT conv_id, turn, CAST(turn_id AS BIGINT) AS turn_id, CAST(steps - min(steps - (role = 'assistant')::INT) OVER (PARTITION BY conv_id, turn_id) AS BIGINT) AS step_id FROM ({TURN})")  # H16, H17
def _(t):
    return sessions.turns(t.conversations).select("conv_id", "turn", "turn_id", "step_id")


@query("h18_retention", f"""WITH x AS (SELECT conv_id, turn_id, sum(tok) AS tokens FROM ({TURN}) GROUP BY ALL), y AS (SELECT *, sum(tokens) OVER w AS tail, row_number() OVER w AS age FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id DESC))
SELECT conv_id, CAST(turn_id AS BIGINT) AS turn_id, CAST(tokens AS BIGINT) AS tokens, age = 1 OR (age <= 3 AND tail <= 300) AS kept FROM y""")  # H18
def _(t):
    return sessions.retention(t.conversations, F.ceil(F.char_length("text") * 0.25), keep_turns=3, budget=300).select("conv_id", "turn_id", "tokens", "kept")


@query("h19_newest_turn", f"""WITH x AS (SELECT *, steps - min(steps - (role = 'assistant')::INT) OVER (PARTITION BY conv_id, turn_id) AS step_id, max(turn_id) OVER (PARTITION BY conv_id) AS newest FROM ({TURN})),
s AS (SELECT conv_id, turn_id, step_id, sum(tok) AS tokens FROM x WHERE turn_id = newest GROUP BY ALL), y AS (SELECT *, sum(tokens) OVER w AS tail, row_number() OVER w AS age FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY step_id DESC))
SELECT conv_id, CAST(turn_id AS BIGINT) AS turn_id, CAST(step_id AS BIGINT) AS step_id, CAST(tokens AS BIGINT) AS tokens, step_id = 0 OR age <= 1 OR tail <= 150 AS kept FROM y""")  # H19
def _(t):
    return sessions.newest_turn_tail(t.conversations, F.ceil(F.char_length("text") * 0.25), budget=200)


@query("h23_freshness", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'click') = 0 THEN 'noop' WHEN count(*) < 5 OR count(*) FILTER (event_type = 'click') >= 0.3 * count(*) THEN 'refresh' ELSE 'mark_pending' END AS action FROM events GROUP BY 1")  # H23
def _(t):
    n = t.events.groupBy("user_id").agg(F.count_if(F.expr("event_type = 'click'")).alias("pending"), F.count("*").alias("total"))
    action = F.when(F.col("pending") == 0, "noop").when((F.col("total") < 5) | (F.col("pending") >= 0.3 * F.col("total")), "refresh").otherwise("mark_pending")
    return n.select("user_id", action.alias("action"))


@query("r01_micro_batches", "SELECT user_id, CAST((rn - 1) // 8 AS BIGINT) AS batch, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY ALL")  # R1
def _(t):
    e = sessions.running(t.events.select("user_id", "event_id"), "user_id", "event_id", {"rn": F.lit(1).cast("long")})
    return e.groupBy("user_id", F.floor((F.col("rn") - 1) / 8).alias("batch")).agg(F.count("*").alias("n"))


@query("r01_age_batches", """WITH RECURSIVE m AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, event_id, 0::BIGINT AS batch, 1::BIGINT AS n, t AS first FROM m WHERE i = 1 UNION ALL SELECT f.user_id, m.i, m.event_id, f.batch + (n >= 8 OR m.t - f.first >= 86400000000)::BIGINT, CASE WHEN n >= 8 OR m.t - f.first >= 86400000000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 8 OR m.t - f.first >= 86400000000 THEN m.t ELSE f.first END FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i + 1)
SELECT user_id, event_id, batch FROM f""")  # R1
def _(t):
    return sessions.micro_batches(t.events, "user_id", "ts", "event_id", most=8, seconds=86_400)


@query("r02_idle_commits", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, count(*) AS n, CAST(min(ts)::DATE AS VARCHAR) AS first FROM s GROUP BY user_id, sid""")  # R2
def _(t):
    return sessions.idle_sessions(t.events, "user_id", "ts").select("user_id", "n", F.col("first").cast("date").cast("string").alias("first"))


@query("r03_threshold_commits", """WITH RECURSIVE m AS (SELECT conv_id, ceil(coalesce(length(text), 0) * 0.25)::BIGINT AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS commits, 0::BIGINT AS pending, 0::BIGINT AS pending_tokens FROM m WHERE i = 1 UNION ALL
SELECT f.conv_id, m.i, f.commits + (pending_tokens + t >= 200 OR pending + 1 >= 3)::BIGINT, CASE WHEN pending_tokens + t >= 200 OR pending + 1 >= 3 THEN 0 ELSE pending + 1 END, CASE WHEN pending_tokens + t >= 200 OR pending + 1 >= 3 THEN 0 ELSE pending_tokens + t END FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1)
SELECT conv_id, max_by(commits, i) AS commits, max_by(pending, i) AS pending, max_by(pending_tokens, i) AS pending_tokens FROM f GROUP BY 1""")  # R3
def _(t):
    return sessions.threshold_commits(t.conversations, F.ceil(F.char_length("text") * 0.25), most_tokens=200, most_messages=3)


@query("r04_dedupe_window", """WITH RECURSIVE m AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, t AS last, 1::BIGINT AS n FROM m WHERE i = 1 UNION ALL SELECT f.user_id, m.i, CASE WHEN m.t - f.last >= 86400000000 THEN m.t ELSE f.last END, f.n + (m.t - f.last >= 86400000000)::BIGINT FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i + 1)
SELECT user_id, max(n) AS n_accepted, CAST(max(i) - max(n) AS BIGINT) AS n_dropped FROM f GROUP BY 1""")  # R4
def _(t):
    return sessions.accepted(t.events, "user_id", "ts", "event_id", 86_400)


@query("d01_merge", """SELECT user_id, sum(value::INT) AS call_count, min_by(event_type, event_id) AS name, max_by(props, event_id) FILTER (event_type <> 'error') AS content FROM events GROUP BY 1""".replace("value::INT", "CAST(floor(value) AS BIGINT)").replace("sum(CAST", "CAST(sum(CAST").replace("AS BIGINT)) AS call_count", "AS BIGINT)) AS BIGINT) AS call_count"))  # D1, D2, D3, D11
def _(t):
    p = t.events.select("user_id", "event_id", F.floor("value").alias("call_count"), F.col("event_type").alias("name"), F.when(F.col("event_type") != "error", F.col("props")).otherwise("").alias("content"))
    return memory.merged(p, "user_id", "event_id", {"call_count": "sum", "name": "immutable", "content": "replace"})


@query("d04_patch", "SELECT n_regionkey AS r, replace('NATION_' || min(n_nationkey), 'NATION', 'N') AS text FROM nation GROUP BY 1")  # D4
def _(t):
    first = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    p = first.select(F.col("n_regionkey").alias("r"), F.lit(1).alias("o"), F.concat(F.lit("NATION_"), "k").alias("text"))
    p = p.unionByName(first.select(F.col("n_regionkey").alias("r"), F.lit(2).alias("o"), F.lit("NATION=>N").alias("text")))
    return memory.merged(p.unionByName(first.select(F.col("n_regionkey").alias("r"), F.lit(3).alias("o"), F.lit("").alias("text"))), "r", "o", {"text": "patch"})


@query("d05_links", "SELECT 'u' || user_id AS from_uri, event_type AS to_uri, json_extract_string(props, '$.k')::INT % 3 AS match_text, max(value) AS weight, max_by(event_id, event_id) AS description, min(event_id) AS created_at FROM events GROUP BY ALL")  # D5
def _(t):
    links = t.events.select(F.concat(F.lit("u"), "user_id").alias("from_uri"), F.col("event_type").alias("to_uri"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("match_text"), F.col("value").alias("weight"), F.lit("x").alias("link_type"), F.col("event_id").alias("description"), F.col("event_id").alias("created_at"))
    return memory.merged_links(links).drop("link_type")


@query("d06_tools", """SELECT event_type AS tool, min_by('t' || user_id, event_id) AS tool_name, count(*) AS call_count, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS success_time, max_by(props, event_id) AS guidelines FROM events GROUP BY 1""")  # D6
def _(t):
    p = t.events.select(F.col("event_type").alias("tool"), "event_id", F.concat(F.lit("t"), "user_id").alias("tool_name"), F.lit(1).cast("long").alias("call_count"), F.floor("value").alias("success_time"), F.col("props").alias("guidelines"))
    return memory.merged_memories(p, "tools", "tool", "event_id")
