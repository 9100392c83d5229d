"""N-gram Jaccard self-join by chosen paths.

A text is the set of its shingles of five lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``; a text of fewer
words has one shingle of them all. Texts are near when the Jaccard similarity of their sets is
``threshold`` or more.

1. Each distinct set gets a 128-bit fingerprint and a sketch of ``SKETCH`` min-hashes.
2. Chosen paths: at each node one or two coordinates of the sketch are drawn (1/threshold on
   average), and sets that share a drawn value go on together. Buckets of up to ``SMALL`` sets are
   compared by brute force on the sketches; larger ones are split again, ``DEPTH`` times at most.
   Sets that still stay together agree on so many drawn values that they are simply joined to one
   of them. Repeats bring the chance to miss a pair at the threshold under 1 - ``recall``, even if its
   buckets are split ``DEPTH`` times.
3. What the paths join are loose groups. Inside each, blocks of sets are compared exactly, which
   counts every link and gives the classes; pairs are counted where they are found, not emitted.

Defined results: a null text or one without words has a class of its own and no links; equal sets are one
class; ``class_id`` is the least id in the class (null if all its ids are null; two classes have the
same if one id has two texts); repeated rows of one id get one row each; an empty table gives an
empty result; a very long text is hashed in steps. ``join`` returns its own columns only, so names
can't clash; ``keep_one`` keeps all columns as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
SKETCH, SMALL, DEPTH = 128, 64, 6
#: Sets, and bytes of text, in one block of an exact comparison.
BLOCK_SETS, BLOCK_BYTES = 256, 4 << 20
#: Parts of a large class's sets in a join with the class's one row.
SALT = 32
#: Four standard deviations of a sketch's estimate at the threshold.
SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)

_r = np.random.default_rng(11)
_ODD = _r.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _r.integers(0, 2**63, SKETCH, dtype=np.uint64)
UPPER = np.arange(256, dtype=np.uint8)
UPPER[0x41:0x5B] += 32


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    low = UPPER[data]
    s, e, wo = C.words(low, off, C.SPACE)
    run = C.running(C.word_hashes(low, s, e))
    n = np.diff(wo)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    first = np.cumsum(count) - count
    lo = np.repeat(wo[:-1], count) + np.arange(int(count.sum())) - np.repeat(first, count)
    h = C.slices(run, lo, np.minimum(lo + size, np.repeat(wo[1:], count)))
    return [np.unique(h[a : a + c]) for a, c in zip(first.tolist(), count.tolist(), strict=True)]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashes of each set (none may be empty)."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, first = np.concatenate(sets), np.cumsum(size) - size
    out = np.empty((len(sets), SKETCH), np.int32)
    with np.errstate(over="ignore"):
        for i in range(SKETCH):
            out[:, i] = np.minimum.reduceat(((flat ^ _XOR[i]) * _ODD[i]) >> np.uint64(33), first)
    return out


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sid: the set's fingerprint or null, n: its size, sketch, bytes) of each row."""
    kind = docs.schema[key]

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                data, off = C.text_buffer(b.column(1))
                sids, sizes, parts = [], [], []
                for i, j in C.steps(off, 1 << 18):
                    sets = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    with np.errstate(over="ignore"):
                        prints = [None if not len(s) else np.array([C.mix(s).sum(), C.mix(s ^ C._MULT).sum()], np.uint64).tobytes() for s in sets]
                    sk = np.zeros((j - i, SKETCH), np.int32)
                    full = [k for k, s in enumerate(sets) if len(s)]
                    if full:
                        sk[full] = sketches([sets[k] for k in full])
                    sids += prints
                    sizes += map(len, sets)
                    parts.append(sk)
                flat = np.concatenate(parts or [np.zeros((0, SKETCH), np.int32)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sids, pa.binary()), pa.array(sizes, pa.int32()), C.list_array(pa.array(flat.ravel()), np.full(len(flat), SKETCH)), pa.array(np.diff(off).astype(np.int32))], names=["key", "tkey", "sid", "n", "sketch", "bytes"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", kind.dataType), *T._parse_datatype_string("tkey binary, sid binary, n int, sketch array<int>, bytes int").fields])
    return C.map_arrow(docs.select(F.col(key), F.col(text), text_key(F.col(text)).alias("tkey")), run, schema)


def text_key(text: Column) -> Column:
    """MD5 of a text; of null no bytes."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def _drawn(node: Column) -> Column:
    """The one or two coordinates drawn at a node: two at a quarter of the nodes, 1.25 on average."""
    h = F.xxhash64(node, F.lit(5))
    one = F.pmod(h, F.lit(SKETCH)).cast("int")
    step = F.pmod(F.shiftright(h, 8), F.lit(SKETCH - 1)).cast("int") + 1
    two = F.pmod(F.shiftright(h, 20), F.lit(1000)) < int(1000 * (1 / THRESHOLD - 1))
    return F.when(two, F.array(one, F.pmod(one + step, F.lit(SKETCH)))).otherwise(F.array(one))


def _split(nodes: DataFrame) -> DataFrame:
    """(path, sid) one level down, from (path, sid, sketch)."""
    at = nodes.withColumn("i", F.explode(_drawn(F.col("path"))))
    return at.select(F.xxhash64("path", "i", F.get("sketch", F.col("i"))).alias("path"), "sid")


def _near(sk: np.ndarray, n: np.ndarray, cut: float, threshold: float) -> np.ndarray:
    """Which pairs of rows may be near, by sizes and sketches."""
    agree = np.zeros((len(sk), len(sk)), np.int16)
    for c in sk.T:
        agree += c[:, None] == c[None, :]
    least, most = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    return (agree >= cut * SKETCH) & (least >= threshold * most - 1e-9)


def _labels(near: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(len(near))
    reach = near | np.eye(len(near), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(near)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Repeats after which a pair at the threshold is missed with chance 1 - recall, if its path
    has to live through ``depth`` levels."""
    live = 1.0
    for _ in range(depth):  # a child lives if its value is shared and its own path lives
        p = threshold * live
        live = (2 - 1 / threshold) * p + (1 / threshold - 1) * (1 - (1 - p) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - live))


def loose_edges(sets: DataFrame, *, threshold: float, recall: float) -> DataFrame:
    """Edges (a, b) of sets that may be near, enough to connect every near pair."""
    cut = threshold - SLACK
    nodes = sets.select("sid", "sketch", F.explode(F.sequence(F.lit(1), F.lit(runs_for(recall, threshold)))).alias("run")).select(F.xxhash64("run", F.lit(17)).alias("path"), "sid", "sketch")
    found = []

    def compare(tables: pa.Table) -> pa.Table:
        sids = tables.column("sid").to_pylist()
        sk = tables.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SKETCH)
        label = _labels(_near(sk, tables.column("n").to_numpy(), cut, threshold))
        at = np.flatnonzero(label != np.arange(len(label))).tolist()
        return pa.table({"a": pa.array([sids[i] for i in at], pa.binary()), "b": pa.array([sids[label[i]] for i in at], pa.binary())})

    for level in range(1, DEPTH + 1):
        split = C.stored(_split(nodes), f"paths{level}")
        counts = split.groupBy("path").agg(F.count("*").alias("c")).where("c > 1")
        held = C.stored(split.join(counts, "path"), f"shared{level}")
        small = held.where(f"c <= {SMALL}").select("path", "sid").join(sets.select("sid", "n", "sketch"), "sid")
        found.append(C.stored(small.groupBy("path").applyInArrow(compare, "a binary, b binary").distinct(), f"edges{level}"))
        large = held.where(f"c > {SMALL}").select("path", "sid")
        if large.isEmpty():
            break
        if level == DEPTH:
            pivot = large.groupBy("path").agg(F.min("sid").alias("b"))
            found.append(large.join(pivot, "path").where("sid <> b").select(F.col("sid").alias("a"), "b"))
        else:
            nodes = large.join(sets.select("sid", "sketch"), "sid")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def exact_links(members: DataFrame, *, threshold: float) -> DataFrame:
    """From (grp, sid, texts, blocks, block, text): for each set the links found in each block pair and
    the least set that it is connected to there."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def compare(t: pa.Table) -> pa.Table:
        sids = t.column("sid").to_pylist()
        block, texts = t.column("block").to_numpy(), t.column("texts").to_numpy().astype(np.int64)
        sets = []
        for chunk in t.column("text").chunks:
            sets += shingles(*C.text_buffer(chunk))
        near = exact_near(sets, threshold)
        if t.column("lo")[0] != t.column("hi")[0]:  # of two blocks, only the pairs between them, even if one is empty
            near &= block[:, None] != block[None, :]
        order = np.argsort(np.array(sids, object))
        label = np.empty(len(sids), np.int64)
        label[order] = order[_labels(near[np.ix_(order, order)])]
        links = near.astype(np.int64) @ texts
        at = np.flatnonzero(links > 0).tolist()
        return pa.table({"sid": pa.array([sids[i] for i in at], pa.binary()), "links": pa.array(links[at], pa.int64()), "root": pa.array([sids[label[i]] for i in at], pa.binary())})

    rows = rows.where("blocks = 1 OR lo <> hi OR block = other").select("grp", "lo", "hi", "sid", "texts", "block", "text")
    return rows.groupBy("grp", "lo", "hi").applyInArrow(compare, "sid binary, links long, root binary")


def exact_near(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets are near (not a set and itself), from exact intersections."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = often[column] > 1
    rank = np.cumsum(often > 1) - 1
    row, column = row[shared], rank[column[shared]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        common += x @ x.T
    union = n[:, None] + n[None, :] - common
    near = common >= threshold * union - 1e-6
    np.fill_diagonal(near, False)
    return near


def classed(docs: DataFrame, *, key: str, text: str, threshold: float, recall: float) -> DataFrame:
    """(key, tkey: MD5 of the text, label: the class, class_id, n_links, n_shingles) of every row."""
    rows = C.stored(describe(docs, key, text), "rows")
    full = rows.where("sid IS NOT NULL")
    sets = full.groupBy("sid").agg(F.min("tkey").alias("tkey"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.max("bytes").alias("bytes"), F.min("key").alias("least"))
    sets = C.stored(sets, "sets")
    loose = components(loose_edges(sets, threshold=threshold, recall=recall), "loose").select(F.col("node").alias("sid"), F.col("label").alias("grp"))
    # exact comparison inside the loose groups, block by block
    same = C.stored(full.select("sid", "tkey").distinct().groupBy("sid").agg(F.count("*").alias("texts")), "texts")
    member = loose.join(sets.select("sid", "tkey", "bytes"), "sid").join(same, "sid")
    size = member.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    member = member.join(size, "grp").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    one = docs.select(text_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    member = one.join(member, "tkey").dropDuplicates(["sid"])
    links = C.stored(exact_links(member, threshold=threshold), "links")
    classes = components(links.select(F.col("sid").alias("a"), F.col("root").alias("b")), "classes").select(F.col("node").alias("sid"), "label")
    counts = links.groupBy("sid").agg(F.sum("links").alias("links"))
    # the least id of a class goes to its sets, not to its rows; a large class's sets are dealt over SALT parts
    own = classes.join(sets.select("sid", "least"), "sid").withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALT)).cast("int"))
    least = own.groupBy("label").agg(F.min("least").alias("class_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = own.join(least, ["label", "salt"]).select("sid", "label", "class_id")
    known = sets.select("sid", "least").join(own, "sid", "left").join(counts, "sid", "left").join(same, "sid")
    known = known.select("sid", F.coalesce("label", "sid").alias("label"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"))
    known = C.stored(known, "known")  # so that the join can deal out the rows of a set that very many have
    out = full.select("key", "tkey", "sid", "n").join(known, "sid").select("key", "tkey", "label", "class_id", "n_links", F.col("n").alias("n_shingles"))
    alone = rows.where("sid IS NULL").select("key", "tkey", F.lit(None).cast("binary").alias("label"), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).alias("n_shingles"))
    return out.unionByName(alone)


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links, n_shingles) of every row; ``n_links`` counts the other different texts near it."""
    out = classed(docs, key=key, text=text, threshold=threshold, recall=recall)
    return out.select(F.col("key").alias(key), "class_id", "n_links", "n_shingles")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class, with its own columns: of the rows with the least id that with the least
    text, by MD5, and one of the rows that are equal in both. Rows without an id all stay."""
    found = classed(docs.where(F.col(key).isNotNull()).select(key, text), key=key, text=text, threshold=threshold, recall=recall)
    first = found.where("key = class_id").groupBy(F.coalesce("label", F.concat(F.col("key").cast("string").cast("binary"), F.lit(b":"), "tkey")).alias("label"), "key").agg(F.min("tkey").alias("tkey"))
    # how often each row is there: only those that repeat have to be told apart
    often = found.groupBy("key", "tkey").agg(F.count("*").alias("times"))
    kept = C.stored(first.select("key", "tkey").join(often, ["key", "tkey"]), "kept")
    id_, tk, times = (C.free_name(docs, n) for n in ("kept_key", "kept_text", "kept_times"))
    kept = kept.select(F.col("key").alias(id_), F.col("tkey").alias(tk), F.col("times").alias(times))
    rows = docs.join(kept, (F.col(key) == kept[id_]) & (text_key(F.col(text)) == kept[tk]))
    out = rows.where(F.col(times) == 1).unionByName(rows.where(F.col(times) > 1).dropDuplicates([id_, tk]))
    return out.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(F.col(key).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return join(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
