"""Substring dedup by repeated-phrase automata, on words.

1. Confirm: windows of 35 words are gathered in intervals (see ``repeats``). A context that is there twice
   is a phrase; where contexts of one k-gram differ, their windows are counted one by one, and each
   that is there twice is a phrase. One place of each stands for it: its words are the phrase, the
   text they are from is its source.
2. Shard: phrases are dealt out by source, so texts that share much meet in few shards. A shard's task
   compiles its phrases into an Aho-Corasick automaton over word numbers.
3. Stream: every text is sent, whole, to each shard that has a phrase of its marks (no other can occur
   in it); a shard that many texts go to is streamed in parts, each with the shard's phrases. The
   automaton alone, which compares words and not hashes, says where phrases are.
4. Every word that a located phrase covers goes; the first copy too.

Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged.

Defined results: null, empty and short texts lose nothing; a text that is there twice and has 35 words
loses all; repeated rows get equal results; an empty table gives an empty result; a very long text is
marked in stretches and streamed whole, as a list of its words. ``dedup`` keeps all columns but the
text as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

#: Words of the phrases that one automaton is made of, and bytes and number of texts in one part of a shard, about.
SHARD_WORDS, PART_BYTES, PART_TEXTS = 250_000, 8 << 20, 512
#: Parts of a shard's rows in joins with the shard's one row.
SALT = 32


def automaton(phrases: list[list[bytes]]):
    """An automaton whose matches give their number of words, and the numbers of its words."""
    import ahocorasick

    number: dict[bytes, int] = {}
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in phrases:
        auto.add_word(tuple([number.setdefault(w, len(number) + 1) for w in p]), len(p))
    if len(auto):
        auto.make_automaton()
    return auto, number


def located(words: list[bytes], auto, number: dict[bytes, int]) -> list[list[int]]:
    """Ranges of words that phrases cover."""
    if not len(auto):
        return []
    got: list[list[int]] = []
    for end, n in auto.iter(tuple([number.get(w, 0) for w in words])):
        lo, hi = end - n + 1, end + 1
        while got and lo <= got[-1][0]:
            got.pop()
        if got and lo <= got[-1][1]:
            got[-1][1] = max(hi, got[-1][1])
        else:
            got.append([lo, hi])
    return got


def _contexts(recurring: DataFrame, u: R.Units) -> DataFrame:
    """(rk, row, a, rep, look, words): the words of the intervals that are to be read, joined by a space."""

    def run(batches):
        for b in batches:
            out = []
            for rk, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = text.encode().split()
                out += [(rk, m["row"], m["a"], m["rep"], m["look"], b" ".join(w[m["a"] : m["b"] + u.length])) for m in own]
            for i in range(0, max(1, len(out)), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out[i : i + 4096]], t) for c, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()))], names=["rk", "row", "a", "rep", "look", "words"])

    return C.map_arrow(recurring.where(F.size("marks") > 0).select("rk", "text", "marks"), run, "rk binary, row long, a int, rep boolean, look boolean, words binary")


def _windows(contexts: DataFrame, u: R.Units) -> DataFrame:
    """(rk, row, a, s, whole, h, h2) of each window in the contexts whose windows are compared."""

    def run(batches):
        for b in batches:
            for i, _, _, units, off in R.each_step(b, 4, u):
                n = np.diff(off) - u.length + 1
                row = np.repeat(np.arange(len(n)), n)
                s = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                h = [pa.array(C.slices(x, off[row] + s, off[row] + s + u.length).view(np.int64)) for x in R.two_runs(units)]
                own = [b.column(c).take(pa.array(row + i)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*own[:3], pa.array((s + own[2].to_numpy()).astype(np.int32)), own[3], *h], names=["rk", "row", "a", "s", "whole", "h", "h2"])

    return C.map_arrow(contexts.where("look").select("rk", "row", "a", F.col("rep").alias("whole"), "words"), run, "rk binary, row long, a int, s int, whole boolean, h long, h2 long")


def confirmed(rows: DataFrame, u: R.Units) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The phrases (source, words, starts, sizes), the texts that may hold any: (rk, bytes, text, sources,
    marks) in buckets by ``rk``, and more sources of those: (rk, source). A source is the ``row`` of the
    text that stands for a phrase, the least of those that have it."""
    held = R.recurring_marks(rows, u)
    ctx = C.stored(held.where("mixed").groupBy("ctx", "ctx2").agg(F.sum("n").alias("of_ctx"), F.min("row").alias("source")), "counts")
    cols = ["rk", "row", "a", "b", "others", "mixed", "of_ctx", "source"]
    plain = held.where("NOT mixed").withColumns({"of_ctx": F.col("of_key"), "source": F.col("least")}).select(cols)
    both = plain.unionByName(held.where("mixed").join(ctx.hint("shuffle_hash"), ["ctx", "ctx2"]).select(cols))
    often, first = F.col("of_ctx") > 1, F.col("row") == F.col("source")
    both = both.withColumns({"rep": often & first, "look": F.col("mixed") & (~often | first)})
    mark = "struct<row:long,a:int,b:int,rep:boolean,look:boolean>"
    own = F.when(F.col("rep") | F.col("look"), F.struct("row", "a", "b", "rep", "look").cast(mark))
    # a context's first place with its mark, and its other places, all with the context's source
    others = F.transform("others", lambda o: F.struct(o["rk"].alias("rk"), F.lit(None).cast(mark).alias("mark")))
    places = both.select(F.when(often, F.col("source")).alias("source"), F.explode(F.concat(F.array(F.struct("rk", own.alias("mark"))), others)).alias("x"))
    of_row = places.select("x.rk", "source", "x.mark").where("source IS NOT NULL OR mark IS NOT NULL").groupBy("rk").agg(F.collect_set("source").alias("sources"), F.collect_set("mark").alias("marks"))
    recurring = C.bucketed(rows.join(of_row, "rk").withColumn("bytes", F.octet_length("text")), "recurring", "rk")
    contexts = C.stored(_contexts(recurring, u), "contexts")

    # a window of a context that is a phrase itself needs no phrase of its own there, but elsewhere
    windows = C.stored(_windows(contexts, u), "windows")
    counts = windows.groupBy("h", "h2").agg(F.count("*").alias("k"), F.min("row").alias("source"), F.count_if(~F.col("whole")).alias("open")).where("k > 1 AND open > 0").select("h", "h2", "source")
    found = windows.join(C.stored(counts, "repeated").hint("shuffle_hash"), ["h", "h2"]).where("NOT whole OR row = source")
    found = C.stored(found.select("rk", "row", "a", "s", "whole", "source"), "found")
    starts = found.where("row = source").groupBy("rk", "a").agg(F.collect_set(F.col("s") - F.col("a")).alias("starts"))
    single = contexts.where("look").join(starts, ["rk", "a"]).select(F.col("row").alias("source"), "words", "starts", F.array_repeat(F.lit(u.length), F.size("starts")).alias("sizes"))
    n = (F.octet_length("words") - F.octet_length(F.translate(F.col("words").cast("string"), " ", "")) + 1).cast("int")
    whole = contexts.where("rep").select(F.col("row").alias("source"), "words", F.array(F.lit(0)).alias("starts"), F.array(n).alias("sizes"))
    return C.stored(whole.unionByName(single), "phrases"), recurring, found.where("NOT whole").select("rk", "source").distinct()


def located_in(docs: DataFrame, u: R.Units) -> tuple[DataFrame, DataFrame]:
    """(rk, spans) as each shard locates them, and the texts in buckets by ``rk``."""
    phrases, recurring, more = confirmed(docs, u)
    spark = docs.sparkSession
    total = phrases.agg(F.sum(F.aggregate("sizes", F.lit(0), lambda a, n: a + n))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_WORDS)
    shard_of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    more = more.groupBy("rk").agg(F.collect_set("source").alias("more"))
    routed = recurring.select("rk", "bytes", "sources").join(more.hint("shuffle_hash"), "rk", "left")
    every = F.array_distinct(F.transform(F.concat("sources", F.coalesce("more", F.array().cast("array<long>"))), shard_of))
    routed = C.stored(routed.select("rk", "bytes", F.explode(every).alias("shard")).distinct(), "routes")
    parts = routed.groupBy("shard").agg(F.ceil(F.greatest(F.sum("bytes") / PART_BYTES, F.count("*") / PART_TEXTS, F.lit(1))).cast("int").alias("parts"))
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    h = F.xxhash64("rk")
    placed = routed.withColumn("salt", F.pmod(h, F.lit(SALT)).cast("int")).join(salted, ["shard", "salt"])
    placed = placed.select("rk", F.struct("shard", F.pmod(F.shiftright(h, 8), F.col("parts")).cast("int").alias("part")).alias("to")).groupBy("rk").agg(F.collect_set("to").alias("to"))
    texts = recurring.select("rk", "text").join(placed.hint("shuffle_hash"), "rk").select("rk", "text", F.explode("to").alias("to")).select("to.shard", "to.part", "rk", "text")
    own = phrases.withColumns({"shard": shard_of("source"), "salt": F.pmod(F.xxhash64("words"), F.lit(SALT)).cast("int")}).join(salted, ["shard", "salt"])
    own = own.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "words", "starts", "sizes")

    def stream(own: pa.Table, texts: pa.Table) -> pa.Table:
        phrases = []
        for w, starts, sizes in zip(*(own.column(c).to_pylist() for c in ("words", "starts", "sizes")), strict=True):
            w = w.split(b" ")
            phrases += [w[s : s + n] for s, n in zip(starts, sizes, strict=True)]
        auto, number = automaton(phrases)
        out = []
        for chunk in texts.select(["rk", "text"]).to_batches(max_chunksize=64):
            for rk, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                if got := located(text.encode().split(), auto, number):
                    out.append((rk, [{"start": a, "end": b} for a, b in got]))
        return pa.table({"rk": pa.array([x[0] for x in out], pa.binary()), "spans": pa.array([x[1] for x in out], R.spans_type())})

    found = own.groupBy("shard", "part").cogroup(texts.groupBy("shard", "part")).applyInArrow(stream, "rk binary, spans array<struct<start:int,end:int>>")
    return found, recurring


def removed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", u: R.Units = R.WORDS) -> DataFrame:
    """(rk, spans, n_removed, kept) of the rows that lose words; spans are ranges of word numbers,
    ``kept`` the words left, joined by one space."""
    C.small_batches(docs.sparkSession)
    found, recurring = located_in(R.keyed(docs, key, text), u)
    spans = found.groupBy("rk").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches):
        for b in batches:
            out = []
            for rk, t, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w, last, left = t.encode().split(), 0, []
                got = R.merged([(x["start"], x["end"]) for x in own])
                for lo, hi in got:
                    left += w[last:lo]
                    last = hi
                left += w[last:]
                out.append((rk, [{"start": lo, "end": hi} for lo, hi in got], len(w) - len(left), b" ".join(left).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.binary(), R.spans_type(), pa.int64(), pa.string()))], names=["rk", "spans", "n_removed", "kept"])

    held = recurring.select("rk", "text").join(spans.hint("shuffle_hash"), "rk")
    return C.map_arrow(held, run, "rk binary, spans array<struct<start:int,end:int>>, n_removed long, kept string")


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut out of their texts; other texts, and all other columns, stay."""
    rk, kept = C.free_name(docs, "row_key"), C.free_name(docs, "kept_text")
    cut = removed(docs, key=key, text=text).dropDuplicates(["rk"]).select(F.col("rk").alias(rk), F.col("kept").alias(kept))
    out = docs.withColumn(rk, R.row_key(key, text)).join(cut, rk, "left")
    return out.withColumn(text, F.coalesce(F.col(kept), F.col(f"`{text}`"))).select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = removed(docs).select("rk", "n_removed", F.sha2("kept", 256).alias("cut_sha256")).dropDuplicates(["rk"])
    one_line = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    whole = docs.select("doc_id", R.row_key("doc_id", "text").alias("rk"), one_line.alias("line"))
    n_words = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    whole = whole.select("doc_id", "rk", n_words.cast("long").alias("n_words"), F.sha2("line", 256).alias("whole_sha256"))
    out = whole.join(cut, "rk", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))
