"""Text functions (F) and the virtual tree (H20, H21, T8)."""

from pyspark.sql import functions as F

from tessera.functions import repair
from tessera.functions import text as X
from tessera.functions import uris
from tessera.operators import paths
from tessera.plans.registry import query

PAGE = "SELECT page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/'), lambda s: s <> ''), '/') AS path FROM pages"
ONE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def pages(t):
    return t.pages.select("page_id", paths.url_path(F.col("url")).alias("path"))


@query("f01_estimate_tokens", r"""SELECT doc_id, coalesce(CAST(ceil(1.5 * c + 2 * a + 0.25 * (n - c - a)) AS BIGINT), 0) AS tokens FROM (SELECT doc_id, length(text) AS n,
len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}]')) AS c, len(regexp_extract_all(text, '[\x{10000}-\x{1FFFF}\x{2EBF0}-\x{10FFFF}]')) AS a FROM documents)""")  # F1
def _(t):
    return t.documents.select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("f02_truncate", "SELECT doc_id, CASE WHEN ceil(length(text) * 0.25) <= 100 THEN text ELSE substr(text, 1, 297) || chr(10) || '…' || chr(10) || right(text, 100) END AS text FROM documents WHERE NOT regexp_matches(text, '[\\x{3040}-\\x{10FFFF}]')")  # F2
def _(t):
    return t.documents.select("doc_id", X.truncated(F.col("text"), 100).alias("text"))


WORDS = {
    "en": "a an and are as be document for from in is of on please project that the this to user with",
    "it": "che con da del della di documento e il la le non per preferenze progetto questo questa un una utente",
    "fr": "avec ce cette de des document du et la le les pour préférences projet que un une utilisateur",
    "es": "con de del documento el esta este la las los para preferencias proyecto que un una usuario y",
    "de": "benutzer das der die diese dieser dokument ein eine für ist mit nicht projekt und zu",
    "pt": "a as com da de do documento e este esta o os para preferências preferencias projeto que um uma usuário usuario",
}
LETTERS = {"en": "\x01", "it": "àèéìòù", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíóúüñ¿¡", "de": "äöüß", "pt": "áâãàçéêíóôõú"}
SCORES = ", ".join(
    f"{{'s': len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v.split())}))) + len(regexp_extract_all(l, '[{LETTERS[k]}]')), 'i': {-i}, 'g': '{k}', 'stop': len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v.split())}))), 'acc': len(regexp_extract_all(l, '[{LETTERS[k]}]'))}}"
    for i, (k, v) in enumerate(WORDS.items())
)


@query("f03_detect_language", rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\b(?:\w+)://[^\s<>\])"'']+', ' ', 'g') AS t FROM documents),
c AS (SELECT doc_id, lower(t) AS l, list_filter(regexp_split_to_array(lower(t), '[^a-z\x{{00C0}}-\x{{024F}}]+'), lambda x: x <> '') AS w, len(regexp_extract_all(t, '[\x{{4E00}}-\x{{9FFF}}]')) AS zh, len(regexp_extract_all(t, '[\x{{3040}}-\x{{30FF}}\x{{31F0}}-\x{{31FF}}\x{{FF66}}-\x{{FF9F}}]')) AS kana,
  len(regexp_extract_all(t, '[\x{{AC00}}-\x{{D7AF}}]')) AS ko, len(regexp_extract_all(t, '[\x{{0400}}-\x{{04FF}}]')) AS ru, len(regexp_extract_all(t, '[\x{{0600}}-\x{{06FF}}]')) AS ar, len(regexp_extract_all(t, '[A-Za-z\x{{00C0}}-\x{{024F}}]')) AS latin FROM t),
d AS (SELECT *, zh + kana + ko + ru + ar + latin AS total, greatest(zh, ko, ru, ar) AS most, list_sort([{SCORES}], 'DESC') AS s FROM c),
e AS (SELECT *, s[1] AS best, list_filter(s, lambda x: x.g = 'en')[1].s AS en, CASE WHEN most = zh THEN 'zh-CN' WHEN most = ko THEN 'ko' WHEN most = ru THEN 'ru' ELSE 'ar' END AS script FROM d)
SELECT doc_id, CASE WHEN total = 0 THEN 'en' WHEN kana >= 10 AND zh + kana >= 0.95 * total AND kana >= 0.3 * (zh + kana) THEN 'ja'
  WHEN most >= 2 AND most >= 0.20 * total AND (script = 'zh-CN' OR (most >= 10 AND most >= 0.95 * total)) THEN script WHEN latin = 0 OR len(w) < 6 OR best.g = 'en' THEN 'en'
  WHEN (best.acc > 0 OR best.stop >= 4) AND best.s >= 3 AND best.s >= en + 2 AND len(w) >= 20 AND best.s >= 6 AND best.s >= en + 4 THEN best.g ELSE 'en' END AS lang_pred FROM e""")  # F3
def _(t):
    return t.documents.select("doc_id", X.detect_language(F.col("text")).alias("lang_pred"))


@query("f04_decode_text", "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 'utf-16' WHEN doc_id % 3 = 1 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding, md5(text) AS digest FROM documents WHERE length(text) > 0")  # F4
def _(t):
    mark = lambda h: F.unhex(F.lit(h))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(mark("FFFE"), F.encode("text", "UTF-16LE"))).when(F.col("doc_id") % 3 == 1, F.concat(mark("EFBBBF"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    got = t.documents.where("length(text) > 0").select("doc_id", repair.decode_text(raw).alias("d"))
    return got.select("doc_id", "d.encoding", F.md5("d.text").alias("digest"))


@query("f05_looks_binary", r"SELECT doc_id, coalesce(contains(substr(text, 1, 1000), chr(0)) OR len(regexp_extract_all(substr(text, 1, 1000), '[\x01-\x08\x0B\x0C\x0E-\x1F]')) > 0.05 * least(length(text), 1000), FALSE) AS is_binary FROM documents")  # F5
def _(t):
    return t.documents.select("doc_id", F.coalesce(X.looks_binary(F.col("text")), F.lit(False)).alias("is_binary"))


def replaced(x, *steps):
    """SQL: some regular expressions replaced, one after another."""
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return x


NL = "chr(10)"
PLAIN = [("(?s)<[^>]*>", "' '"), ("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'"), ("[ \\t\\r]+", "' '"), (" ?\\n ?", NL), ("\\n{3,}", f"{NL} || {NL}")]
ASIDE = [(rf"(?is)<{n}\b[^>]*>.*?</{n}\s*>", "' '") for n in ("script", "style", "head", "title", "nav", "header", "footer", "noscript", "svg", "form")] + [("(?s)<!--.*?-->", "' '")]
TRIM = f"' ' || {NL}"
LINK = (r"\[ ?([^\[\]]*?) ?\]\(", r"'[\1]('")
MARKUP = [
    (r"""(?i)<img\b[^>]*?src\s*=\s*[''"]data:image/[^>]*>""", "''"), (r"""(?is)<img\b[^>]*?src\s*=\s*[''"]([^''"]*)[''"][^>]*>""", r"'![](\1)'"),
    (r"""(?is)<a\b[^>]*?href\s*=\s*[''"]([^''"]*)[''"][^>]*>\s*(.*?)\s*</a\s*>""", r"'[\2](\1)'"),
    *((rf"(?is)<h{i}\b[^>]*>\s*(.*?)\s*</h{i}\s*>", rf"{NL} || {NL} || '{'#' * i} \1' || {NL} || {NL}") for i in range(1, 7)),
    *((rf"(?is)<{n}(?:\s[^>]*)?>\s*(.*?)\s*</{n}\s*>", rf"'{m}\1{m}'") for n, m in (("b", "**"), ("strong", "**"), ("i", "*"), ("em", "*"), ("code", "`"))),
    (r"(?i)<li\b[^>]*>\s*", f"{NL} || '- '"), (r"(?i)<br\b[^>]*>", NL), (r"(?i)</(p|div|ul|ol|section|article|blockquote|pre)\s*>", f"{NL} || {NL}"),
]


@query("f06_html_text", f"""SELECT page_id, trim({replaced("html", *ASIDE, ("(?i)<(br|/p|/div|/li|/tr|/h[1-6])\\b[^>]*>", NL), *PLAIN)}, {TRIM}) AS text FROM pages""")  # F6
def _(t):
    return t.pages.select("page_id", X.html_text(F.col("html")).alias("text"))


@query("f06_html_markdown", f"""WITH m AS (SELECT page_id, html, {replaced(f"trim({replaced('html', *ASIDE, *MARKUP, *PLAIN)}, {TRIM})", LINK)} AS body, trim(regexp_replace(trim({replaced("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)", *PLAIN)}, {TRIM}), '\\s+', ' ', 'g')) AS title FROM pages WHERE NOT regexp_matches(html, '(?i)<(table|noscript)'))
SELECT page_id, CASE WHEN title = '' OR contains(body, title) THEN body WHEN body = '' THEN '# ' || title ELSE '# ' || title || {NL} || {NL} || body END AS markdown FROM m""")  # tables and notices are tested on a fixture, no page has any
def _(t):
    return t.pages.select("page_id", X.html_markdown(F.col("html")).alias("markdown"))


@query("f07_split", """SELECT doc_id, length(text) AS n_chars, TRUE AS fits, sha256(text) AS digest, ceil(length(text) * 0.25) <= 1024 AS whole FROM documents""")  # which pieces there are is tested by brute force
def _(t):
    p = F.col("p")
    fits = F.forall(p, lambda c: X.estimate_tokens(c) <= 1024)
    own = t.documents.select("doc_id", X.pieces(F.col("text")).alias("p"))
    return own.select("doc_id", F.aggregate(p, F.lit(0).cast("long"), lambda n, c: n + F.char_length(c)).alias("n_chars"), F.coalesce(fits, F.lit(True)).alias("fits"), F.sha2(F.array_join(p, ""), 256).alias("digest"), (F.array_size(p) <= 1).alias("whole"))


@query("f08_markdown_table", "SELECT r_regionkey, '| key | name' || repeat(' ', length(r_name) - 4) || ' |' || chr(10) || '| --- | ' || repeat('-', length(r_name)) || ' |' || chr(10) || '| ' || rpad(r_regionkey::VARCHAR, 3, ' ') || ' | ' || r_name || ' |' AS md FROM region")  # F8
def _(t):
    rows = F.array(F.array(F.lit("key"), F.lit("name")), F.array(F.col("r_regionkey").cast("string"), F.col("r_name")))
    return t.region.select("r_regionkey", X.markdown_table(rows).alias("md"))


@query("f09_media_strategy", "SELECT p_partkey, CASE WHEN p_retailprice % 1 > 0.3 OR p_size >= 25 THEN 'full_page' WHEN p_size > 10 THEN 'extract' ELSE 'text_only' END AS strategy FROM part")  # F9
def _(t):
    n = F.when(F.col("p_size") >= 25, 5).when(F.col("p_size") > 10, 1).otherwise(0)
    return t.part.select("p_partkey", X.media_strategy(n, F.col("p_retailprice") % 1).alias("strategy"))


@query("f10_uri_parts", f"WITH p AS ({PAGE}), s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM p) SELECT page_id, '/' || array_to_string(s[1:len(s) - 1], '/') AS parent, s[len(s)] AS leaf, len(s) AS depth FROM s")  # F10
def _(t):
    p = F.col("path")
    return pages(t).select("page_id", paths.parent(p).alias("parent"), paths.leaf(p).alias("leaf"), paths.depth(p).alias("depth"))


@query("f11_classify_uri", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'skill' ELSE 'resource' END AS kind, CASE WHEN user_id % 3 = 0 THEN 'cases' ELSE '' END AS category, CASE WHEN user_id % 3 < 2 THEN CAST(user_id AS VARCHAR) END AS owner FROM events")  # F11, F12, F14
def _(t):
    u = F.col("user_id")
    uri = F.when(u % 3 == 0, F.concat(F.lit("ctx://user/"), u, F.lit("/memories/cases/a.md"))).when(u % 3 == 1, F.concat(F.lit("ctx://user/"), u, F.lit("/skills/b.md"))).otherwise(F.lit("ctx://resources/docs/c.md"))
    return t.events.select("event_id", uris.context_type(uri).alias("kind"), uris.category(uri).alias("category"), uris.owner(uri).alias("owner"))


@query("f13_safe_segment", r"SELECT p_partkey, substr(regexp_replace(replace(replace(p_name || ' / ' || p_brand || ' ..', '#', '_'), ' / ', '_'), '[ ]+', '_', 'g'), 1, 50) AS x FROM (SELECT p_partkey, p_name, p_brand FROM part)".replace("|| ' ..'", ""))  # F13
def _(t):
    return t.part.select("p_partkey", uris.safe_segment(F.concat_ws("", "p_name", F.lit(" / "), "p_brand", F.lit(" .."))).alias("x"))


@query("f15_digest", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")  # F15
def _(t):
    return t.documents.select("doc_id", X.digest(F.col("text")).alias("digest"))


@query("f16_frontmatter", "SELECT doc_id, 'source: ' || source AS head, text AS body FROM documents WHERE text IS NOT NULL")  # F16
def _(t):
    d = t.documents.where("text IS NOT NULL").withColumn("m", F.concat(F.lit("---\nsource: "), "source", F.lit("\n---\n"), "text"))
    head, body = X.frontmatter(F.col("m"))
    return d.select("doc_id", head.alias("head"), body.alias("body"))


@query("f17_json_shape", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'OBJECT<k: BIGINT>' WHEN 1 THEN 'ARRAY<STRING>' WHEN 2 THEN 'OBJECT<a: OBJECT<b: DECIMAL(2,1)>, t: STRING>' END AS shape FROM events")  # F17
def _(t):
    kind = F.to_json(F.array("event_type"))
    text = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, kind).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"a": {"b": 1.5}, "t": "'), "event_type", F.lit('"}'))).otherwise("no json")
    return t.events.select("event_id", X.json_shape(text).alias("shape"))


@query("f32_repair_json", "SELECT event_id, CASE WHEN event_id % 8 < 7 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")  # F32
def _(t):
    k, way = F.get_json_object("props", "$.k"), F.col("event_id") % 8
    broken = (
        F.when(way == 0, F.col("props")).when(way == 1, F.concat(F.lit("Here it is:\n```json\n{'k': "), k, F.lit(",}\n```\nDone.")))
        .when(way == 2, F.concat(F.lit("{k: "), k, F.lit(", ok: True}"))).when(way == 3, F.concat(F.lit('{"k": '), k, F.lit(', "l": [1, 2, {"m": "x'))).when(way == 4, F.concat(F.lit("[{'k': "), k, F.lit("}, None]")))
        .when(way == 5, F.concat(F.lit('Sure! {"k": '), k, F.lit(', // the key\n "t": "a {b"} I hope it helps.'))).when(way == 6, F.concat(F.lit('{"k": '), k, F.lit(', "l": [1, 2,')))
        .otherwise("nothing of the kind")
    )
    v = F.try_parse_json(repair.repaired_json(broken))
    got = F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.try_variant_get(v, "$[0].k", "bigint"))
    return t.events.select("event_id", got.alias("k"))


@query("f33_surrogates", r"""SELECT event_id, '{"a": "' || event_type || CASE event_id % 3 WHEN 0 THEN '\ufffd' WHEN 1 THEN '\ud83d\ude00' ELSE 'x\ufffdy' END || '"}' AS json FROM events""")  # F33
def _(t):
    tail = F.when(F.col("event_id") % 3 == 0, r"\ud800").when(F.col("event_id") % 3 == 1, r"\ud83d\ude00").otherwise(r"x\udc00y")
    return t.events.select("event_id", repair.without_lone_surrogates(F.concat(F.lit('{"a": "'), "event_type", tail, F.lit('"}'))).alias("json"))


@query("f25_snowflake", "SELECT event_id, ((epoch_us(ts) // 1000 - 1704067200000) << 22) + (5 << 12) + row_number() OVER (PARTITION BY epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS id FROM events")  # F25
def _(t):
    return repair.snowflakes(t.events.select("event_id", "ts"), F.unix_millis(F.col("ts").cast("timestamp")), "event_id", worker=5).select("event_id", "id")


@query("f18_kind", "SELECT event_id, 'json' AS kind, 'csv' AS table_kind FROM events")  # F18, F19
def _(t):
    return t.events.select("event_id", X.kind_of(F.col("props")).alias("kind"), X.kind_of(F.concat(F.lit("id,type\n"), "event_id", F.lit(","), "event_type")).alias("table_kind"))


@query("f20_one_line", f"SELECT doc_id, CASE WHEN length(l) > 60 THEN substr(l, 1, 57) || '...' ELSE l END AS line FROM (SELECT doc_id, {ONE} AS l FROM documents)")  # F20
def _(t):
    return t.documents.select("doc_id", X.one_line(F.col("text"), 60).alias("line"))


@query("f21_normal_answer", r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(replace(text, ',', '')), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the', 'and')), ' ') AS answer FROM benchmark")  # F21
def _(t):
    return t.benchmark.select("item_id", X.normal_answer(F.col("text")).alias("answer"))


@query("f22_refusal", """SELECT conv_id, turn, p <> 'fine' AND p <> 'noon' AS refuses FROM (SELECT conv_id, turn, ['not mentioned', 'no information', 'cannot be answered', 'none', 'unknown', 'don''t know', 'fine', 'noon'][1 + (conv_id + turn) % 8] AS p FROM conversations)""")  # F22
def _(t):
    said = F.array(*[F.lit(x) for x in ("It is Not Mentioned.", "NO INFORMATION here", "this cannot be answered", "None.", "Unknown", "I don't know", "fine", "at noon")])
    return t.conversations.select("conv_id", "turn", X.refuses(F.get(said, ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))).alias("refuses"))


@query("f23_date_time", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")  # F23
def _(t):
    return t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("f24_geo_point", "SELECT c_custkey, c_nationkey * 7.0 - 90 AS lon, CAST(c_nationkey AS DOUBLE) AS lat FROM customer")  # F24
def _(t):
    g = uris.geo_point(F.concat_ws(",", F.col("c_nationkey") * 7.0 - 90, "c_nationkey"))
    return t.customer.select("c_custkey", g["lon"].alias("lon"), g["lat"].alias("lat"))


@query("f26_grep", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM l WHERE regexp_matches(line, '[0-9]{4}')""")  # F26
def _(t):
    return X.grep(t.documents.select("doc_id", "text"), "text", "[0-9]{4}").select("doc_id", "line_no", "line")


@query("f27_glob", f"WITH p AS ({PAGE}) SELECT page_id FROM p WHERE regexp_matches(path, '^/[^/]*/[ed][^/]*/[0-9][^/]$')")  # F27
def _(t):
    return paths.glob(pages(t), "path", "*/[ed]*/[0-9]?").select("page_id")


@query("f28_read_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS piece FROM documents WHERE text IS NOT NULL")  # F28
def _(t):
    piece = F.regexp_replace(X.read_slice(F.col("text"), 1, 2), "\n$", "")
    return t.documents.where("text IS NOT NULL").select("doc_id", F.when(F.size(F.split("text", "\n")) > 1, piece).otherwise("").alias("piece"))


@query("f30_strip_level", "SELECT page_id, page_id % 3 AS level, url AS uri FROM pages")  # F30, H8
def _(t):
    from tessera.operators.retrieval import display_uri

    shown = display_uri(F.col("url"), F.col("page_id") % 3)
    return t.pages.select("page_id", uris.level_of(shown).cast("long").alias("level"), uris.strip_level(shown).alias("uri"))


@query("f31_link", r"SELECT item_id, regexp_replace(text, '\bthe\b', '[the](ctx://x)') AS text FROM benchmark")  # F31
def _(t):
    return t.benchmark.select("item_id", X.link_first(F.col("text"), "the", "ctx://x").alias("text"))


@query("f34_snippets", "SELECT doc_id, CAST(least(20, len(string_split(text, 'tion')) - 1) AS BIGINT) AS n, CAST(strpos(text, 'tion') - 1 AS INT) AS first FROM documents WHERE contains(text, 'tion')")  # F34
def _(t):
    s = X.snippets(t.documents.select("doc_id", "text"), "text", "tion", around=20)
    ok = F.contains("snippet", F.lit("tion"))
    return s.where(ok).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("offset").alias("first"))


@query("f35_content_id", "SELECT doc_id, 'tr_' || substr(sha256(text), 1, 24) AS id FROM documents")  # F35
def _(t):
    return t.documents.select("doc_id", X.content_id(F.col("text")).alias("id"))


TREE = f"""WITH p AS (SELECT DISTINCT path FROM ({PAGE})), s AS (SELECT path, string_split(path, '/') AS s FROM p), u AS (SELECT path, unnest(range(1, len(s))) AS n, s FROM s),
d AS (SELECT CASE WHEN n = 1 THEN '/' ELSE array_to_string(s[1:n], '/') END AS path, count(*) AS under FROM u GROUP BY 1), x AS (SELECT path, TRUE AS is_dir, under FROM d UNION ALL SELECT path, FALSE, 0 FROM p WHERE path NOT IN (SELECT path FROM d)),
y AS (SELECT *, CASE WHEN path = '/' THEN NULL WHEN len(string_split(path, '/')) = 2 THEN '/' ELSE array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') END AS parent FROM x),
k AS (SELECT parent AS path, count(*) AS children FROM y WHERE parent IS NOT NULL GROUP BY 1) SELECT y.path, is_dir, under, coalesce(children, 0) AS children FROM y LEFT JOIN k USING (path)"""


@query("h20_tree", f"SELECT path, is_dir FROM ({TREE}) WHERE len(list_filter(string_split(path, '/'), lambda s: s <> '')) <= 2")  # H20, T8
def _(t):
    return paths.walk(paths.tree(pages(t), "path"), "/", levels=2).select("path", "is_dir")


@query("h21_stat", TREE)  # H21
def _(t):
    return paths.tree(pages(t), "path").select("path", "is_dir", "under", "children")
