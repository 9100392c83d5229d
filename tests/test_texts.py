"""Text queries on rows that the given tables don't have, against brute force."""

import math

from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text as X

CJK = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2EBEF)]


def weight(text):
    return sum(1.5 if any(a <= ord(c) <= b for a, b in CJK) else 2.0 if ord(c) > 0xFFFF else 0.25 for c in text)


def prefix(text, room):
    return max(n for n in range(min(len(text), int(4 * room)) + 1) if weight(text[:n]) <= room)


def brute(text, budget, marker="\n…\n"):
    if text is None or math.ceil(weight(text)) <= budget:
        return text
    marker = "" if weight(marker) >= budget else marker
    quarters = max(0, int(4 * (budget - weight(marker))))
    head, tail = quarters * 3 // 4 / 4, (quarters - quarters * 3 // 4) / 4
    n = prefix(text[::-1], tail)
    return text[: prefix(text, head)] + marker + text[len(text) - n :]


def test_truncation_keeps_to_the_budget(spark, tmp_path):
    texts = [None, "", "中" * 66, "中" * 67, "中文字" * 200, "かな漢字 mixed with words " * 40, "\U0001f600" * 300, "\U00020000a" * 200, "한국어 " * 200, "ＦＵＬＬ" * 200, "plain words " * 300, "a" * 500 + "中" * 300, "中" * 300 + "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in catalog.queries()["f02_truncate"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t, 100) for i, t in enumerate(texts)}
    assert all(weight(t or "") <= 100 for t in got.values())
    for budget in (0, 1, 7):
        cut = {r.doc_id: r.text for r in df.select("doc_id", X.truncated(F.col("text"), budget).alias("text")).collect()}
        assert cut == {i: brute(t, budget) for i, t in enumerate(texts)}
