"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned
over the token windows of every document.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A benchmark
item gives each window of ``n`` consecutive words (one window of all its words if it has
fewer, none if it has none). Hashes find candidate windows; the words themselves are
compared before anything counts as a hit.

Defined results: null or wordless text has no words, no hits and is not contaminated; null
or wordless items give no window; the windows of an item without an id hit, but there is no id to
list; an empty benchmark hits nothing; repeated rows are judged one by one. ``scan`` replaces input
columns named like one of its own; ``drop_contaminated`` and ``cut_hits`` keep all input columns as
they are. A very long text is hashed in steps and takes about ten times its words' count in bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Broadcast windows per scan. A larger benchmark is scanned in blocks, one after another: each block's
#: hits are written before the next block's windows come to the driver.
BLOCK_WINDOWS = 200_000

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SPAN = "array<struct<start:int,end:int>>"
HITS = "array<struct<start:int,end:int,from:int,to:int>>"


def split_words(text: bytes) -> list[bytes]:
    data = LOWER[np.frombuffer(text, np.uint8)]
    s, e, _ = C.words(data, np.array([0, len(data)]), IS_WORD)
    low = data.tobytes()
    return [low[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def item_windows(bench: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """One row per distinct (window, item): ``n`` words joined by a space."""

    def run(batches):
        for b in batches:
            ids, out_w, out_i = b.column(0).to_pylist(), [], []
            for k, t in zip(ids, b.column(1).to_pylist(), strict=True):
                w = split_words((t or "").encode())
                for i in range(max(1, len(w) - n + 1) if w else 0):
                    out_w.append(b" ".join(w[i : i + n]))
                    out_i.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.binary()), pa.array(out_i, b.schema.field(0).type)], names=["window", "item"])

    kind = bench.schema[item].dataType
    schema = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("item", kind)])
    return bench.select(item, text).mapInArrow(run, schema).distinct()


class Scanner:
    """The windows of one block, by length and hash."""

    def __init__(self, rows: list[tuple[bytes, object]]) -> None:
        self.items: dict[bytes, list] = {}
        for w, i in rows:
            self.items.setdefault(bytes(w), []).append(i)
        by_len: dict[int, list[bytes]] = {}
        for w in self.items:
            by_len.setdefault(w.count(b" ") + 1, []).append(w)
        self.sets = []
        for n, ws in sorted(by_len.items()):
            blob = np.frombuffer(b" ".join(ws), np.uint8)
            hashes = self.hashes(blob, *C.words(blob, np.array([0, len(blob)]), IS_WORD)[:2])
            lo = np.arange(len(ws)) * n
            h = np.unique(C.slices(C.running(hashes), lo, lo + n))
            seen = np.zeros(1 << 20, bool)
            seen[h >> C.U64(44)] = True
            self.sets.append((n, h, seen))

    @staticmethod
    def hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return C.word_hashes(low, s, e)

    def scan(self, data: np.ndarray, off: np.ndarray):
        """Per row: number of words, hit word ranges as (row, first, last) and items."""
        low = LOWER[data]
        s, e, wo = C.words(low, off, IS_WORD)
        run = C.running(self.hashes(low, s, e))
        row_of = np.repeat(np.arange(len(off) - 1), np.diff(wo))
        found = []
        raw = low.tobytes() if len(s) else b""
        for n, h, seen in self.sets:
            if len(s) < n:
                continue
            i = np.arange(len(s) - n + 1)
            win = C.slices(run, i, i + n)
            c = np.flatnonzero(seen[win >> C.U64(44)])
            c = c[row_of[c] == row_of[c + n - 1]]
            at = np.minimum(np.searchsorted(h, win[c]), len(h) - 1)
            for k in c[h[at] == win[c]].tolist():
                key = b" ".join(raw[a:b] for a, b in zip(s[k : k + n].tolist(), e[k : k + n].tolist(), strict=True))
                if (ids := self.items.get(key)) is not None:
                    found.append((int(row_of[k]), k, k + n, ids))
        return s, e, wo, found


def hits(docs: DataFrame, bench: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, str]:
    """``docs`` and the name of one more column there: a struct of ``n_words``, ``hits`` (ranges of
    hit words and their bytes, merged where the words are neighbours) and ``items``."""
    spark = docs.sparkSession
    kind = bench.schema[item].dataType
    grams = C.stored(item_windows(bench, item, item_text, n), "grams")
    blocks = -(-max(1, grams.count()) // block_windows)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", T._parse_datatype_string(HITS)), T.StructField("items", T.ArrayType(kind))]
    out, names = docs, []
    for k in range(blocks):
        rows = [tuple(r) for r in grams.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect()]  # at most about block_windows
        held = spark.sparkContext.broadcast(rows)

        def make(held=held):
            s = Scanner(held.value)
            return lambda col: _columns(s, col, kind)

        names.append(C.free_name(out, f"block{k}"))
        out = out.withColumn(names[-1], C.computed(out, text, fields, make))
        if blocks > 1:
            out = C.stored(out, "block")
            held.unpersist()
    if blocks == 1:
        return out, names[0]
    every = F.array_sort(F.flatten(F.array(*[F.col(f"{c}.hits") for c in names])))

    def join(done, h):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"), last["from"].alias("from"), F.greatest(last["to"], h["to"]).alias("to"))
        touches = (F.size(done) > 0) & (h["start"] <= F.get(done, F.size(done) - 1)["end"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(h)))

    merged = F.aggregate(every, F.array().cast(HITS), join)
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{c}.items") for c in names]))))
    name = C.free_name(out, "found")
    return out.withColumn(name, F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), merged.alias("hits"), items.alias("items"))).drop(*names), name


def _n_hit(found: str) -> Column:
    return F.aggregate(f"{found}.hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])


def scan(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans`` (byte ranges of the hit words, merged
    where the words are neighbours), ``hit_words`` (ranges of word numbers) and ``items``."""
    out, found = hits(docs, bench, **options)
    own = {
        "n_words": F.col(f"{found}.n_words"), "n_hit": _n_hit(found),
        "hit_words": F.transform(f"{found}.hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))),
        "spans": F.transform(f"{found}.hits", lambda h: F.struct(h["from"].alias("start"), h["to"].alias("end"))),
        "items": F.col(f"{found}.items"),
    }
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() not in own], *[v.alias(k) for k, v in own.items()])


def _columns(scanner: Scanner, col: pa.Array, kind: T.DataType) -> list[pa.Array]:
    from pyspark.sql.pandas.types import to_arrow_type

    data, off = C.text_buffer(col)
    n_words, hit, items = [], [], []
    for i, j in C.steps(off):
        s, e, wo, found = scanner.scan(data[off[i] : off[j]], off[i : j + 1] - off[i])
        n_words += np.diff(wo).tolist()
        by_row: dict[int, list] = {}
        for row, lo, hi, ids in found:
            by_row.setdefault(row, []).append((lo - int(wo[row]), hi - int(wo[row]), ids))
        for row in range(j - i):
            got = by_row.get(row, [])
            merged: list[list[int]] = []
            for lo, hi, _ in sorted(got, key=lambda x: x[:2]):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            w0, b0 = int(wo[row]), int(off[i + row] - off[i])
            hit.append([{"start": lo, "end": hi, "from": int(s[w0 + lo]) - b0, "to": int(e[w0 + hi - 1]) - b0} for lo, hi in merged])
            items.append(sorted({x for *_, ids in got for x in ids if x is not None}))
    span = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "from", "to")]))
    return [pa.array(n_words, pa.int64()), pa.array(hit, span), pa.array(items, pa.list_(to_arrow_type(kind)))]


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """Hit words are at least a twentieth of all words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    out, found = hits(docs, bench, **options)
    return out.where(~contaminated(_n_hit(found), F.col(f"{found}.n_words"))).drop(found)


def cut_hits(docs: DataFrame, bench: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All documents, with the hit spans cut out of their texts."""
    out, found = hits(docs, bench, text=text, **options)
    raw, spans = F.col(f"`{text}`").cast("binary"), F.col(f"{found}.hits")
    start = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("kept"))
    step = lambda a, h: F.struct(h["to"].alias("at"), F.concat(a["kept"], F.substring(raw, a["at"] + 1, h["from"] - a["at"])).alias("kept"))
    cut = F.aggregate(spans, start, step, lambda a: F.concat(a["kept"], F.substring(raw, a["at"] + 1, F.octet_length(raw))))
    return out.withColumn(text, F.when(F.size(spans) > 0, F.decode(cut, "UTF-8")).otherwise(F.col(f"`{text}`"))).drop(found)


def query(spark, sf_dir: str) -> DataFrame:
    d = scan(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
