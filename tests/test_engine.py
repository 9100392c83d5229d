"""Operators that no SQL expresses, against brute force; text functions on rows that the tables don't have; recovery."""

import heapq
import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import repair
from tessera.functions import text as X
from tessera.operators import assembly, retrieval, snapshots, summaries
from tessera.plans import retrieval as plans
from tessera.plans.registry import Tables
from tessera.streaming import jobs
from tests.oracle import SF


def one(spark, values, kind, column):
    """A column's value of each given one."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


PAGES = {
    "<html><head><title>A page</title></head><body><h1>A page</h1><p>Some <b>bold</b> &amp; <i>thin</i> text.</p></body></html>": "# A page\n\nSome **bold** & *thin* text.",
    "<title>T</title><p>x <a href='/y' class='z'>a <span>link</span></a></p><ul><li>one</li><li>two</li></ul>": "# T\n\nx [a link](/y)\n\n- one\n- two",
    "<table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>x</td></tr></table><p>after</p>": "| k | v |\n| --- | --- |\n| 1 | x |\n\nafter",
    "<nav>menu</nav><img src='data:image/png;base64,AA'><img alt='q' src='/p.png'><script>var x;</script>": "![](/p.png)",
    "<title>App</title><body><noscript>You need  JavaScript.</noscript><div></div></body>": "# App\n\nYou need JavaScript.",
    "<title>Only</title>": "# Only",
    "": "",
}


def test_html_becomes_markdown(spark):
    assert one(spark, list(PAGES), "string", X.html_markdown) == list(PAGES.values())


def tokens(t):
    return math.ceil(0.25 * len(t))


def brute_split(text, most, least):
    """The splitting rules, one text at a time."""

    def packed(parts, until):
        done, last = [], ""
        for p in parts:
            if tokens(last) < until and tokens(last + p) <= most:
                last += p
            else:
                done.append(last)
                last = p
        return [*done, last]

    def small(p):
        step = max(1, most // 2)
        return [p] if tokens(p) <= most else [p[i : i + step] for i in range(0, len(p), step)]

    if tokens(text) <= most:
        return [text] if text else []
    parts = []
    for section in re.split(r"(?m)(?=^#{1,6} )", text):
        parts += [section] if tokens(section) <= most else packed([y for x in re.split("(?<=\n)", section) for y in small(x)], most)
    return [p for p in packed(parts, least) if p]


def test_texts_are_split_at_headings(spark):
    texts = ["", "short", "# a\n" + "x y\n" * 20 + "## b\n" + "z " * 200 + "\n# c\nend", "no heading " * 300, "l\n" * 500, "# h\n" * 100 + "w" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = X.smart_split(df, "t", most=64, least=32).orderBy("i", "n").collect()
    for i, t in enumerate(texts):
        mine = [r.chunk for r in got if r.i == i]
        assert mine == brute_split(t, 64, 32) and "".join(mine) == t and all(tokens(c) <= 64 for c in mine)


def test_languages_by_script(spark):
    texts = ["это русский текст и больше ничего", "日本語のテキストです、かなもあります", "中文文本没有假名", "한국어 텍스트 입니다 그리고 더", "", "12 34", "two words", "der die das und nicht mit dem Projekt für das Dokument ist ein und zu der Benutzer von hier aus und da", "see ctx://a/über/ärger now"]
    assert one(spark, texts, "string", X.detect_language) == ["ru", "ja", "zh-CN", "ko", "en", "en", "en", "de", "en"]


def test_legacy_encodings(spark):
    texts = {"gb18030": "这是一个简体中文的句子，没有别的。", "cp932": "これは日本語の文章です。カタカナもあります。", "cp949": "이것은 한국어 문장입니다.", "cp1252": "Füße über Äpfel, déjà vu à Noël", "utf-16": "any text", "utf-8": "plain"}
    got = one(spark, [t.encode(e) for e, t in texts.items()] + [b"\0\1\0\2" * 50, None], "binary", repair.decode_text)
    assert [g.text for g in got] == [*texts.values(), None, None]


def test_broken_json(spark):
    want = {'{"a": 1}': '{"a": 1}', "x {a: 'b'} y": '{"a":"b"}', '[1, 2,': "[1, 2]", '{"a": "it\'s", "b": [': None, "none": None}
    got = one(spark, list(want), "string", lambda c: F.to_json(F.try_parse_json(repair.repaired_json(c))))
    assert got[0] == '{"a":1}' and got[1] == '{"a":"b"}' and got[2] == "[1,2]" and got[3] == '{"a":"it\'s","b":[]}' and got[4] is None


def test_best_first_is_the_plain_search(spark):
    nodes = plans.nodes(Tables(spark, SF))
    kids = {}
    for r in nodes.collect():
        kids.setdefault(r.parent_uri, []).append(r)
    for limit in (3, 10):
        open_ = {r.uri: r.score for r in kids[None]}
        seen, hits, before, still = set(open_), {}, None, 0
        while open_ and still < 3:
            for u in heapq.nsmallest(4, open_, key=lambda u: (-open_[u], u)):
                up = open_.pop(u)
                final = {r.uri: (0.5 * r.score + 0.5 * up if up else r.score) for r in kids.get(u, [])}
                for v in sorted(final, key=lambda v: (-final[v], v))[: max(2 * limit, 20)]:
                    if v not in seen:
                        seen.add(v)
                        (hits if v.startswith("c") else open_)[v] = final[v]
            top = sorted(hits, key=lambda u: (-hits[u], u))[:limit]
            still, before = (still + 1, before) if top == before else (0, top)
        got = retrieval.best_first(nodes, nodes.where("parent_uri IS NULL").select("uri", F.col("score").alias("final")), limit=limit).collect()
        assert [(r.uri, round(r.final, 9)) for r in got] == [(u, round(hits[u], 9)) for u in sorted(hits, key=lambda u: (-hits[u], u))[:limit]]


def brute_pack(items, budget):
    """The packing rules over (key, score, sizes) of one query."""
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    cap, left, out = 2 * max(1, budget // len(items)), budget, []
    for key, _, sizes in items:
        fit = [i for i, s in enumerate(sizes) if s <= cap and s + 1 <= left]
        if fit:
            out.append([key, fit[-1], sizes])
            left -= sizes[fit[-1]] + 1
    for x in out:
        better = [i for i in range(x[1] + 1, len(x[2])) if x[2][i] - x[2][x[1]] <= left]
        if better:
            left -= x[2][better[-1]] - x[2][x[1]]
            x[1] = better[-1]
    return [(k, t, s[t]) for k, t, s in out]


def test_packing_is_greedy(spark):
    rows = plans.candidates(Tables(spark, SF)).collect()
    for budget in (200, 4000):
        df = spark.createDataFrame(rows)
        got = assembly.pack(df, query="lang", key="doc_id", score="score", sizes=["a", "o", "f"], budget=budget).collect()
        want = [(lang, *x) for lang in {r.lang for r in rows} for x in brute_pack([(r.doc_id, r.score, (r.a, r.o, r.f)) for r in rows if r.lang == lang], budget)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_directories_sample_their_children(spark):
    files = spark.createDataFrame([(f"/a/f{i:03d}", f"t{i}") for i in range(100)] + [("/a/b/c/x", "deep"), ("/z", "top")], "path string, text string")
    got = {r.path: r for r in summaries.bottom_up(files, "path", "text").collect()}
    assert set(got) == {"/", "/a", "/a/b", "/a/b/c"} and got["/a"].children == 101
    names = sorted(["/a/b", *(f"/a/f{i:03d}" for i in range(100))])
    want = [names[k * 100 // 31] for k in range(32)]
    assert got["/a"].overview.split("\n") == ["deep" if w == "/a/b" else f"t{int(w[4:])}" for w in want]
    assert got["/"].abstract == "deep" and got["/"].overview == "deep\ntop"


def test_snapshots_keep_versions(spark, tmp_path):
    root = f"file://{tmp_path}/h"
    assert snapshots.log(spark, root).count() == 0
    make = lambda rows: spark.createDataFrame(rows, "path string, content string")
    assert snapshots.commit(make([("/a", "1"), ("/b", "1"), ("/c", None)]), root, "one") == 1
    assert snapshots.commit(make([("/a", "2"), ("/d", "1")]), root, "two") == 2
    assert sorted(map(tuple, snapshots.restore(spark, root, 1).collect())) == [("/a", "1"), ("/b", "1"), ("/c", None)]
    assert sorted(map(tuple, snapshots.restore(spark, root, 2).collect())) == [("/a", "2"), ("/d", "1")]
    assert spark.read.parquet(f"{root}/contents").count() == 3  # each content once
    with pytest.raises(ValueError):
        snapshots.show(spark, root, 3)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    src, out, state = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    rows = [(i % 5, i, f"v{i}") for i in range(40)]
    put = lambda some: spark.createDataFrame(some, "k int, n int, v string").coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema("k int, n int, v string").option("maxFilesPerTrigger", 1).parquet(src)
    put(rows[:15])
    put(rows[15:20])
    first = jobs.merged(read(), "k", ["n"], out=out, checkpoint=state)
    assert sorted(map(tuple, first.collect())) == [(k, 15 + k, f"v{15 + k}") for k in range(5)]
    put(rows[20:])  # a new driver knows the folders only
    again = jobs.merged(read(), "k", ["n"], out=out, checkpoint=state)
    assert sorted(map(tuple, again.collect())) == [(k, 35 + k, f"v{35 + k}") for k in range(5)]
