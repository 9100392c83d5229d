"""Queries on tables of other shapes than the given ones, against their SQL."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text as X
from tests.oracle import compare
from tests.test_texts import weight


def put(df, folder, name):
    """``df`` as one file, which DuckDB reads by the same path as Spark."""
    df.coalesce(1).write.parquet(f"{folder}/{name}_parts")
    next(folder.glob(f"{name}_parts/*.parquet")).rename(folder / f"{name}.parquet")


def same(spark, name, folder):
    return compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], str(folder))


def test_groups_beyond_ten_thousand(spark, tmp_path):
    put(spark.range(10_050 * 13).select((F.col("id") % 10_050).alias("o_custkey")), tmp_path, "orders")
    assert same(spark, "a05_having", tmp_path) == 10_050


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ODD = [None, "", "\n", "short", "# a\n" + "x y\n" * 900 + "## b\n" + "z " * 3000 + "\n# c\nend", "é ä\r\n" * 2000, "中文 字\n" * 900, "w" * 9000 + "\n", "中" * 3000, "\U0001f600\U00020000 a\n" * 700, "# 標題\n" * 800 + "\U0001f600" * 1500, "l\n" * 5000]


def test_pieces_of_odd_texts(spark, tmp_path):
    put(spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string"), tmp_path, "documents")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["f07_split"](spark, str(tmp_path))
    assert "Exchange" not in plan(got)  # no text leaves its row
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].n_chars for i in range(len(ODD))] == [None if x is None else len(x) for x in ODD]
    assert all(r.fits and r.digest == (None if ODD[i] is None else hashlib.sha256(ODD[i].encode()).hexdigest()) for i, r in rows.items())
    assert [rows[i].whole for i in range(len(ODD))] == [None if x is None else weight(x) <= 1024 for x in ODD]
    for most, least in ((64, 32), (1024, 512)):
        mine = {r.doc_id: r.p for r in d.select("doc_id", X.pieces(F.col("text"), most=most, least=least).alias("p")).collect()}
        assert mine == {i: None if x is None else brute_split(x, most, least) for i, x in enumerate(ODD)}
    chunks = X.split_chunks(d, "text", 64).orderBy("doc_id", "n").collect()
    for i, x in enumerate(ODD):
        own = [c.chunk for c in chunks if c.doc_id == i]
        assert "".join(own) == (x or "") and all(tokens(c) <= 64 for c in own)


def tokens(x):
    return math.ceil(weight(x))


def brute_split(x, most, least):
    def packed(parts, until):
        done, last, held = [], "", 0.0
        for p in parts:
            w = weight(p)
            if math.ceil(held) < until and held + w <= most:
                last, held = last + p, held + w
            else:
                done.append(last)
                last, held = p, w
        return [*done, last]

    def small(p):
        return [p] if tokens(p) <= most else [p[i : i + most // 2] for i in range(0, len(p), most // 2)]

    if tokens(x) <= most:
        return [x] if x else []
    parts = []
    for section in re.split(r"(?m)(?=^#{1,6} )", x):
        parts += [section] if tokens(section) <= most else packed([y for line in re.split("(?<=\n)", section) for y in small(line)], most)
    return [p for p in packed(parts, least) if p]


GERMAN = "der die das und nicht mit dem Projekt für das Dokument ist ein und zu der Benutzer von hier aus und da "
SPOKEN = [
    None, "", "12 34", "Ⱥ", "a b", "ñ", GERMAN, GERMAN.upper(), GERMAN * 300, "see ftp://für.ist/über " * 30 + "the end", "le projet est pour les utilisateurs et la préférence avec des documents que une " * 3, "\n\tder die das und nicht\n",
    "это русский текст " * 9 + "ok", "كلمة " * 30, "한국어 텍스트 " * 20, "かな漢字です" * 9, "かな the words here are more than that " * 3, "中文 in the text " * 4, "中 " + "plain words " * 40, "\U0001f600 über die Straße " * 20, "K İ ΣΑΣ ſ the und", "ﾊﾟﾋﾟﾌﾟ" * 9,
]


def test_languages_of_odd_texts(spark, tmp_path):
    put(spark.createDataFrame(list(enumerate(SPOKEN)), "doc_id bigint, text string"), tmp_path, "documents")
    got = plan(catalog.queries()["f03_detect_language"](spark, str(tmp_path)))
    assert (got.count("://["), got.count("lower("), got.count("split(")) == (1, 1, 1)  # each text is read once for each
    assert same(spark, "f03_detect_language", tmp_path) == len(SPOKEN)


COUNTED = [(0, "a b b"), (1, "B c, c! d1d\nthe The THE"), (2, None), (3, "12 中"), (4, ""), (5, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} c" for i in range(5000))), (6, "the " * 300), (7, "K k \xe4b")]


def test_sparse_maps_of_odd_texts(spark, tmp_path):
    for case, rows in enumerate((COUNTED, COUNTED[2:], [*COUNTED, (0, "b c"), (1, "c the e"), (6, None), (None, "c"), (None, "c d")], [(1, None), (2, "a")])):
        folder = tmp_path / str(case)
        folder.mkdir()
        put(spark.createDataFrame(rows, "doc_id bigint, text string"), folder, "documents")
        for name in ("v07_sparse_dot", "v08_sparse_l2"):
            assert same(spark, name, folder) > 0
            assert case == 2 or "Exchange" not in plan(catalog.queries()[name](spark, str(folder)))  # no word leaves its row
