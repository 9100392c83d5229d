"""Values mended or made: broken JSON, lone surrogates, ids by time, bytes in unknown encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 2024-01-01 UTC in milliseconds, and the bits of worker and sequence.
EPOCH, WORKER_BITS, SEQUENCE_BITS = 1_704_067_200_000, 10, 12
#: Encodings that are tried, in this order, after byte order marks and UTF-8.
ENCODINGS = ["gb18030", "gbk", "gb2312", "big5", "cp950", "cp932", "shift_jis", "euc_jp", "euc_kr", "cp949", "cp1252", "latin_1"]
MARKS = [(b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")]


def repaired_json(text: Column) -> Column:
    """JSON as models write it, made parseable: a fence or words around it, comments, single quotes, bare
    keys, Python's constants, commas before a closing bracket, brackets never closed. What is JSON already
    stays as it is; what can't be mended is null."""
    t = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), text)
    t = F.regexp_extract(t, r"(?s)[{\[].*", 0)
    t = F.regexp_replace(t, r"(?m)(^|[\s,{\[])//[^\n]*$", "$1")
    t = F.when(F.contains(t, F.lit('"')), t).otherwise(F.replace(t, F.lit("'"), F.lit('"')))
    t = F.regexp_replace(t, r"([{,]\s*)'?([A-Za-z_][A-Za-z0-9_]*)'?\s*:", '$1"$2":')
    t = F.regexp_replace(t, r":\s*'([^'\"]*)'", ':"$1"')
    for a, b in (("True", "true"), ("False", "false"), ("None", "null")):
        t = F.regexp_replace(t, rf"([:,\[]\s*){a}\b", f"$1{b}")
    whole = F.try_parse_json(text)
    # what comes after the last bracket that closes is no JSON; brackets left open are closed
    ends = F.regexp_replace(t, r"(?s)([}\]])[^}\]\"]*$", "$1")
    stripped = F.regexp_replace(t, r'"(?:[^"\\]|\\.)*"', "")
    marks = F.split(F.regexp_replace(stripped, r"[^\[\]{}]", ""), "")

    def nest(held: Column, m: Column) -> Column:
        opened = F.when(m == "{", "}").when(m == "[", "]")
        return F.when(opened.isNotNull(), F.concat(opened, held)).when(m == F.substring(held, 1, 1), F.substring(held, 2, 1 << 20)).otherwise(held)

    close = F.aggregate(marks, F.lit(""), nest)
    open_string = F.when(F.regexp_count(F.regexp_replace(t, r"\\\\.", ""), F.lit('"')) % 2 == 1, F.lit('"')).otherwise(F.lit(""))
    mended = F.when((close == "") & (open_string == ""), ends).otherwise(F.concat(t, open_string, close))
    mended = F.regexp_replace(mended, r",(\s*[}\]])", "$1")
    return F.when(whole.isNotNull(), text).when(F.try_parse_json(mended).isNotNull(), mended)


def without_lone_surrogates(json: Column) -> Column:
    """JSON text in which an escaped surrogate without its other half is the replacement character."""
    high, low = r"\\u[dD][89aAbB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    out = F.regexp_replace(json, rf"(?<!\\){high}(?!{low})", "\\\\ufffd")
    return F.regexp_replace(out, rf"(?<!\\u[dD][89aAbB][0-9a-fA-F]{{2}})(?<!\\){low}", "\\\\ufffd")


def snowflakes(df: DataFrame, millis: Column, order: str, worker: int = 0) -> DataFrame:
    """``df`` with ``id``: 41 bits of time, 10 of worker, 12 of the place among the rows of a millisecond."""
    if not 0 <= worker < 1 << WORKER_BITS:
        raise ValueError("worker ids have ten bits")
    rows = df.withColumn("__ms", millis)
    nth = F.row_number().over(Window.partitionBy("__ms").orderBy(order)) - 1
    since = F.col("__ms") - EPOCH
    ok = (nth < 1 << SEQUENCE_BITS) & (since >= 0)
    id_ = F.shiftleft(since, WORKER_BITS + SEQUENCE_BITS) + F.lit(worker << SEQUENCE_BITS) + nth
    return rows.withColumn("id", F.when(ok, id_).otherwise(F.raise_error(F.lit("no snowflake id: over 4096 rows in a millisecond, or before 2024")).cast("long"))).drop("__ms")


def _readable(text: str) -> bool:
    head = text[:1000]
    odd = sum((ord(c) < 32 and c not in "\t\n\r") or 0x7F <= ord(c) <= 0x9F for c in head)
    return "\ufffd" not in head and odd <= 0.05 * len(head)


def _decoded(raw: bytes) -> tuple[str | None, str | None]:
    for mark, encoding in MARKS:
        if raw.startswith(mark):
            try:
                return raw.decode(encoding), encoding
            except UnicodeDecodeError:
                return None, None
    if raw[:8192].count(0) > 0.05 * min(len(raw), 8192):
        return None, None
    try:
        return raw.decode(), "utf-8"
    except UnicodeDecodeError:
        pass
    found = []
    for rank, encoding in enumerate(ENCODINGS):
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        if _readable(text):
            found.append((-_fit(text, encoding), rank, text, encoding))
    return min(found)[2:] if found else (None, None)


def _fit(text: str, encoding: str) -> float:
    """Share of the characters beyond ASCII that texts in an encoding's language are mostly made of; text
    all in Hangul fits best, since its bytes would be common Chinese characters too."""
    high = [c for c in text if ord(c) > 0x7F]
    han = [c for c in high if "\u4e00" <= c <= "\u9fff"]

    def common(codec: str, last: int) -> int:
        return sum(len(b := c.encode(codec, "ignore")) == 2 and b[0] <= last for c in han)

    if encoding in ("euc_kr", "cp949"):
        own = sum("\uac00" <= c <= "\ud7a3" for c in high) * (1.5 if not han else 1)
    elif encoding in ("cp932", "shift_jis", "euc_jp"):
        own = sum("\u3040" <= c <= "\u30ff" for c in high) * 1.5 + common("euc_jp", 0xCF)
    elif encoding in ("big5", "cp950"):
        own = common("big5", 0xC6)
    elif encoding in ("cp1252", "latin_1"):
        own = sum("\u00c0" <= c <= "\u024f" and c not in "×÷" for c in high)
    else:
        own = common("gb2312", 0xF7)
    rare = sum(0xE000 <= ord(c) <= 0xF8FF or 0xFF61 <= ord(c) <= 0xFF9F for c in high)
    return (own - rare) / max(1, len(high))


def decode_text(raw: Column) -> Column:
    """(text, encoding) of bytes: by byte order mark, as UTF-8, or in the legacy encoding whose script
    they fit best; both null for binary data. Bytes in legacy encodings need Python's codecs."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            got = [(None, None) if x is None else _decoded(x) for x in a.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["text", "encoding"])

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "text string, encoding string")(raw)
