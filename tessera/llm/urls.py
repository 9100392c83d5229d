"""URL filter by a path-template tree, in DataFrame functions only.

The tree is built level by level until no path has a segment left. Per host, a level is a wildcard
where its segments vary (many distinct values, few urls each), in that branch or in the same branch
over all hosts. Branches whose labelled block rate can't be told from that of what they branch from
are merged, with all below them. A url (host and path) counts once, however many rows it has. A
template is rejected when its smoothed rate of blocked labelled urls is over one half: its own counts are smoothed
towards the same template over all hosts, and those towards the rate of all pages. The
labels are the verdicts of the explicit rules, which always win for their own pages.

Rules are ``(action, host suffix + path prefix)``; a rule fits its host and all subdomains if
the path starts with the rule's, and the longest fitting rule wins.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, and is
judged as the template of the empty host; without any label the rate is one half and nothing is
rejected; an empty table gives an empty result; repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The contract's rules.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: A level is variable from this many distinct segments, if each has fewer urls than REPEAT on average.
VARIABLE, REPEAT = 6, 4
#: Labelled urls that a smoothing prior counts as.
PRIOR = 5
#: Squared z of the test by which branches are merged.
Z2 = 4
#: Parts of a host's rows in a join with the host's one row.
SALT = 32


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action; null where none fits."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _with_host(nodes: DataFrame, hosts: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Join many rows of a key with the key's one row, the key's rows dealt out over SALT parts."""
    left = nodes.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALT)))
    right = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return left.join(right, [*keys, "salt"]).drop("salt")


def varies(kinds: Column, n: Column) -> Column:
    return F.coalesce((kinds >= VARIABLE) & (n < REPEAT * kinds), F.lit(False))


def _level(nodes: DataFrame, level: int) -> DataFrame:
    """``nodes`` one level down: ``t``, the template so far, gets this level's ``leaf``; ``m``, the merged
    branches so far, gets what the ``leaf`` of the level before is merged to."""
    nodes = nodes.withColumn("s", F.coalesce(F.get("segs", F.lit(level - 1)), F.lit("")))
    # which branches vary here; one too small to tell by itself follows what it does over all hosts
    kinds = nodes.groupBy("host", "t", "s").agg(F.count(F.when(F.col("s") != "", 1)).alias("n"))
    over_all = kinds.groupBy("t", "s").agg(F.sum("n").alias("n")).groupBy("t").agg(varies(F.count(F.when(F.col("s") != "", 1)), F.sum("n")).alias("vary_all"))
    kinds = kinds.groupBy("host", "t").agg(varies(F.count(F.when(F.col("s") != "", 1)), F.sum("n")).alias("vary"))
    # which branches are like what they branch from
    branches = nodes.groupBy("host", "m", "leaf").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    whole = branches.groupBy("host", "m").agg(F.sum("l").alias("wl"), F.sum("b").alias("wb"))
    branches = _with_host(branches, whole, ["host", "m"], ["leaf"])
    # |b/l - wb/wl| <= z*sqrt(p(1-p)/l), without division: (b*wl - l*wb)^2 <= z^2 * l * wb * (wl - wb)
    apart = F.pow(F.col("b").cast("double") * F.col("wl") - F.col("l").cast("double") * F.col("wb"), F.lit(2)) > F.lit(Z2) * F.col("l").cast("double") * F.col("wb") * (F.col("wl") - F.col("wb"))
    branches = branches.select("host", "m", "leaf", F.concat("m", F.lit("/"), F.when(apart, F.col("leaf")).otherwise("~")).alias("merged"))
    nodes = _with_host(nodes, kinds, ["host", "t"], ["path"])
    nodes = _with_host(nodes, over_all, ["t"], ["host", "path"])
    nodes = _with_host(nodes, branches, ["host", "m", "leaf"], ["path"])
    leaf = F.when((F.col("vary") | F.col("vary_all")) & (F.col("s") != ""), "*").otherwise(F.col("s"))
    nodes = nodes.withColumn("leaf", leaf).withColumn("t", F.concat("t", F.when(F.col("leaf") != "", F.concat(F.lit("/"), "leaf")).otherwise("")))
    return nodes.select("host", "path", "segs", "labelled", "blocked", "t", F.col("merged").alias("m"), "leaf")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, *, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``template``, ``block_rate`` and ``verdict``."""
    base = C.without(pages, ["host", "path", "rule", "template", "block_rate", "verdict", "action"])
    host, path = host_path(F.col(url))
    rows = base.withColumn("host", host).withColumn("path", path)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    labelled, blocked = F.col("action").isNotNull().cast("int"), F.coalesce(F.col("action") == "block", F.lit(False)).cast("int")
    leaves = rows.select("host", "path", labelled.alias("labelled"), blocked.alias("blocked")).distinct()
    leaves = C.stored(leaves.withColumn("segs", F.filter(F.split("path", "/"), lambda s: s != "")), "urls")
    depth = leaves.agg(F.max(F.size("segs"))).first()[0] or 0

    # level 1: which hosts vary there
    s1 = F.coalesce(F.get("segs", F.lit(0)), F.lit(""))
    hosts = leaves.groupBy("host", s1.alias("s")).agg(F.count("*").alias("n")).groupBy("host").agg(varies(F.count("*"), F.sum("n")).alias("vary"))
    nodes = _with_host(leaves, hosts, ["host"], ["path"]).withColumn("leaf", F.when(F.col("vary"), "*").otherwise(s1)).drop("vary")
    nodes = nodes.withColumns({"t": F.col("leaf"), "m": F.lit("")})

    # level 2 and each deeper one, of the urls that reach it
    done = None
    for level in range(2, max(depth, 2) + 1):
        nodes = _level(nodes, level)
        if depth > 2:
            nodes = C.stored(nodes, f"level{level}")
        ended = nodes.where(F.size("segs") <= level)
        done = ended if done is None else done.unionByName(ended)
        nodes = nodes.where(F.size("segs") > level)
    done = done.drop("segs")

    own = done.groupBy("host", "m", "leaf").agg(F.sum("labelled").alias("own_l"), F.sum("blocked").alias("own_b"))
    shared = done.groupBy("t").agg(F.sum("labelled").alias("tpl_l"), F.sum("blocked").alias("tpl_b"))
    total = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("all_l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("all_b"))
    nodes = _with_host(done.drop("labelled", "blocked"), own, ["host", "m", "leaf"], ["path"])
    nodes = _with_host(nodes, shared, ["t"], ["host", "path"]).crossJoin(F.broadcast(total))  # total: one row
    p_all = (F.col("all_b") + 1) / (F.col("all_l") + 2)
    p_tpl = (F.col("tpl_b") + PRIOR * p_all) / (F.col("tpl_l") + PRIOR)
    rate = (F.col("own_b") + PRIOR * p_tpl) / (F.col("own_l") + PRIOR)
    nodes = nodes.select("host", "path", F.concat("host", F.lit("/"), "t").alias("template"), rate.alias("block_rate"))
    out = rows.join(nodes, ["host", "path"])
    verdict = F.coalesce(F.col("action"), F.when(F.col("block_rate") > 0.5, "block").otherwise("allow"))
    return out.select(*base.columns, "host", "path", "rule", "template", "block_rate", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH u0 AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u1 AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u0),
u2 AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM u1),
u3 AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM u2),
u4 AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM u3),
rows_ AS (SELECT page_id, host, path, rule, action, coalesce(segs[1], '') AS s1, coalesce(segs[2], '') AS s2, len(segs) > 2 AS deep FROM u4),
leaves AS (SELECT host, s1, s2, deep, count(*) AS n, count(action) AS labelled, count(CASE WHEN action = 'block' THEN 1 END) AS blocked FROM rows_ GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT s1) >= 6 AND sum(n) < 4 * count(DISTINCT s1) AS vary1, sum(labelled) AS hl, sum(blocked) AS hb FROM leaves GROUP BY host),
l1 AS (SELECT l.*, CASE WHEN vary1 THEN '*' ELSE s1 END AS t1, hl, hb FROM leaves l JOIN hosts USING (host)),
branches AS (SELECT host, t1, count(DISTINCT CASE WHEN s2 <> '' THEN s2 END) AS kinds, sum(CASE WHEN s2 <> '' THEN n END) AS kinds_n,
  CAST(sum(labelled) AS DOUBLE) AS l, CAST(sum(blocked) AS DOUBLE) AS b, CAST(max(hl) AS DOUBLE) AS hl, CAST(max(hb) AS DOUBLE) AS hb FROM l1 GROUP BY host, t1),
over_all AS (SELECT t1, count(DISTINCT s2) >= 6 AND sum(n) < 4 * count(DISTINCT s2) AS vary_all FROM l1 WHERE s2 <> '' GROUP BY t1),
l2 AS (SELECT x.host, x.s1, x.s2, x.deep, x.labelled, x.blocked, x.t1,
  CASE WHEN (b * y.hl - l * y.hb) * (b * y.hl - l * y.hb) > 4 * l * y.hb * (y.hl - y.hb) THEN x.t1 ELSE '~' END AS m1,
  CASE WHEN (coalesce(kinds >= 6 AND kinds_n < 4 * kinds, FALSE) OR coalesce(vary_all, FALSE)) AND x.s2 <> '' THEN '*' ELSE x.s2 END AS t2
  FROM l1 x JOIN branches y ON x.host = y.host AND x.t1 = y.t1 LEFT JOIN over_all z ON x.t1 = z.t1),
own AS (SELECT host, m1, t2, deep, sum(labelled) AS own_l, sum(blocked) AS own_b FROM l2 GROUP BY ALL),
shared AS (SELECT t1, t2, deep, sum(labelled) AS tpl_l, sum(blocked) AS tpl_b FROM l2 GROUP BY ALL),
total AS (SELECT coalesce(sum(labelled), 0) AS all_l, coalesce(sum(blocked), 0) AS all_b FROM l2),
nodes AS (SELECT l2.host, s1, s2, l2.deep, (own_b + 5 * ((tpl_b + 5 * ((all_b + 1) / (all_l + 2))) / (tpl_l + 5))) / (own_l + 5) AS rate
  FROM l2 JOIN own ON l2.host = own.host AND l2.m1 = own.m1 AND l2.t2 = own.t2 AND l2.deep = own.deep
  JOIN shared ON l2.t1 = shared.t1 AND l2.t2 = shared.t2 AND l2.deep = shared.deep CROSS JOIN total)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.action, CASE WHEN rate > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM rows_ r JOIN nodes n ON r.host = n.host AND r.s1 = n.s1 AND r.s2 = n.s2 AND r.deep = n.deep
"""
