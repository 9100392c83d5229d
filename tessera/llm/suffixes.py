"""Suffix-array dedup by a distributed merge sort that never compares a known prefix again.

The suffixes that are sorted start at marked places: each 200-byte window is marked by the 40 bytes
of least hash inside it, so equal windows mark suffixes that share 40 bytes at least. Marks whose 40
bytes don't recur are left out, by counts of their hashes (see ``repeats``).

1. A task sorts its suffixes (200 bytes, then the bytes before the mark), makes equal ones one entry,
   front-codes the run against its neighbours and deals it out over shards by mark.
2. A shard merges its runs, ``FAN`` at a time, with a loser tree that keeps, for each run, how much of
   the next suffix it shares with the last one put out: only bytes after that are compared.
3. What comes out is a suffix array with common prefixes. A passage is where these are as long as the
   mark; inside it the common prefixes of neighbours, and those of the reversed bytes before the
   mark, bound which windows of an entry can recur. With two entries that is the answer; among more,
   the bounded windows of one distance are sorted and neighbours with 200 equal bytes recur. Bytes
   decide, not hashes.

A mark with over ``HOT`` entries of differing contexts (a line that a third of all texts have) isn't
one shard's: its windows are marked anew, in cells of ``CELL`` neighbours by the bytes that all of a
cell have in common, and windows of cells that are as hot by all their 200 bytes.

Defined results: null, empty and texts under 200 bytes lose nothing; bytes may be cut inside a
character; a text that is there twice and has 200 bytes loses all; repeated rows get equal results;
an empty table gives an empty result; a very long text is marked in stretches. ``removed`` has its
own columns only, so names can't clash.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

#: Text bytes whose suffixes one shard sorts, about; suffixes in one run of a task; runs merged at once.
SHARD_BYTES, RUN, FAN = 16 << 20, 50_000, 256
#: Entries from which a mark, or a cell, is hot; windows of one cell.
HOT, CELL = 2000, 16
PLACE = np.dtype([("rk", "V16"), ("p", "<i4"), ("near", "<i2"), ("far", "<i2"), ("n", "<i4"), ("left", "<i2"), ("right", "<u2")])


def lcp(s: bytes, t: bytes, p: int) -> int:
    """Bytes that two strings share, of which ``p`` are known."""
    n = min(len(s), len(t))
    while p < n:
        q = min(p + 16, n)
        if s[p:q] != t[p:q]:
            while s[p] == t[p]:
                p += 1
            return p
        p = q
    return n


#: An entry: its suffix from the mark on, the bytes before it, the text's key, the mark's place, the least and
#: greatest distance of its windows' starts before the mark, and how many places have just these bytes.
Entry = tuple[bytes, bytes, bytes, int, int, int, int]


def pack(entries: list[Entry]) -> bytes:
    """A sorted run, front-coded."""
    places = np.zeros(len(entries), PLACE)
    shared, rest, lefts, last = bytearray(), [], [], b""
    for i, (right, left, rk, p, near, far, n) in enumerate(entries):
        k = lcp(last, right, 0)
        shared.append(k)
        rest.append(right[k:])
        lefts.append(left)
        places[i] = (rk, p, near, far, n, len(left), len(right))
        last = right
    return zlib.compress(len(entries).to_bytes(4, "little") + bytes(shared) + places.tobytes() + b"".join(lefts) + b"".join(rest), 1)


class Run:
    """A sorted run, read from front to back."""

    __slots__ = ("at", "head", "left", "n", "places", "raw", "shared")

    def __init__(self, blob: bytes) -> None:
        self.raw = raw = zlib.decompress(blob)
        self.n = n = int.from_bytes(raw[:4], "little")
        self.shared = raw[4 : 4 + n]
        self.left = 4 + n + n * PLACE.itemsize
        places = np.frombuffer(raw[4 + n : self.left], PLACE)
        self.head = self.left + int(places["left"].sum())
        self.places, self.at = places.tolist(), 0

    def next(self, last: bytes) -> tuple[Entry, int] | None:
        """The next entry, and what its suffix shares with ``last``, the one before it."""
        if self.at == self.n:
            return None
        k = self.shared[self.at]
        rk, p, near, far, n, left, right = self.places[self.at]
        a, b = self.left, self.head
        self.left, self.head, self.at = a + left, b + right - k, self.at + 1
        return (last[:k] + self.raw[b : self.head], self.raw[a : self.left], rk, p, near, far, n), k


def merge(runs: list[Run]):
    """(entry, bytes that its suffix shares with the one before) over all runs in order.

    A loser tree: each inner node keeps the run that lost there and what its suffix shares with the
    winner that passed. Of two suffixes compared with the same last output, the one that shares
    more with it comes first; only where they share equally much are bytes compared, from there on."""
    k = len(runs)
    first = [r.next(b"") for r in runs]
    heads: list[Entry | None] = [got[0] if got else None for got in first]
    shared = [0] * k  # with the last suffix put out
    tree = [-1] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's ``shared`` becomes what it shares with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        p, q = shared[x], shared[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        s, t = a[0], b[0]
        p = lcp(s, t, p)
        if s[p : p + 1] < t[p : p + 1] or (p == len(s) == len(t) and a[1] <= b[1]):
            shared[y] = p
            return x, y
        shared[x] = p
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        tree[node] = lose
        return win

    win = build(1) if k > 1 else 0
    common = 0
    while (entry := heads[win]) is not None:
        yield entry, common
        got = runs[win].next(entry[0])
        heads[win], shared[win] = got if got else (None, 0)
        node = (win + k) >> 1
        while node:
            w, lose = play(win, tree[node])
            tree[node] = lose
            win = w
            node >>= 1
        common = shared[win]


def joined(entries):
    """Of sorted (entry, common): equal entries as one, with their count, and the places of the others,
    which recur for sure: yields (entry, common, None) or (None, 0, entry)."""
    held = None
    for e, common in entries:
        if held is not None and common == len(e[0]) == len(held[0][0]) and e[1] == held[0][1] and e[4:6] == held[0][4:6]:
            yield None, 0, e
            held = ((*held[0][:6], held[0][6] + e[6]), held[1])
            continue
        if held is not None:
            yield held[0], held[1], None
        held = (e, common)
    if held is not None:
        yield held[0], held[1], None


def windows_of(group: list[tuple[Entry, int]], length: int) -> list[list[int]]:
    """For each entry of a passage, with what its suffix shares with the one before it, the distances
    of those of its windows that recur."""
    m = len(group)
    right = [0] * m  # the most that an entry's suffix shares with another one
    for i in range(1, m):
        right[i - 1], right[i] = max(right[i - 1], group[i][1]), group[i][1]
    back = [e[1][::-1] for e, _ in group]
    order = sorted(range(m), key=back.__getitem__)
    left = [0] * m
    for i, j in zip(order, order[1:], strict=False):
        n = lcp(back[i], back[j], 0)
        left[i], left[j] = max(left[i], n), max(left[j], n)
    lo = [max(e[4], length - r) for (e, _), r in zip(group, right, strict=True)]
    hi = [min(e[5], n) for (e, _), n in zip(group, left, strict=True)]
    out: list[list[int]] = [list(range(e[4], e[5] + 1)) if e[6] > 1 else [] for e, _ in group]
    if m == 2:  # both prefixes are those of the same pair
        for i in (0, 1):
            out[i] = out[i] or list(range(max(lo), min(hi) + 1))
        return out
    for d in range(min(lo), max(hi) + 1):
        own = sorted((group[i][0][1][-d:] + group[i][0][0][: length - d] if d else group[i][0][0][:length], i) for i in range(m) if lo[i] <= d <= hi[i])
        same = [a[0] == b[0] for a, b in zip(own, own[1:], strict=False)]
        for k, (_, i) in enumerate(own):
            if group[i][0][6] == 1 and ((k and same[k - 1]) or (k < len(same) and same[k])):
                out[i].append(d)
    return out


def ranges(e: Entry, distances: list[int]) -> list[tuple[bytes, int, int]]:
    """(rk, first, last) window starts of ascending distances."""
    out: list[list[int]] = []
    for d in reversed(distances):
        if out and e[3] - d == out[-1][1] + 1:
            out[-1][1] += 1
        else:
            out.append([e[3] - d, e[3] - d])
    return [(e[2], a, b) for a, b in out]


SURE = np.dtype([("rk", "V16"), ("lo", "<i4"), ("hi", "<i4")])
BLOBS = "shard long, anchor int, sure boolean, blob binary"


def _sure(places: list[tuple[bytes, int, int]]) -> bytes:
    return zlib.compress(np.array(places, SURE).tobytes(), 1)


def _blobs(rows: list[tuple[int, int, bool, bytes]]) -> list[pa.Array]:
    return [pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.binary()))]


def sorted_runs(texts: DataFrame, shards: int, length: int) -> DataFrame:
    """BLOBS of (rk, text, marks: p, lo, hi, key, anchor): front-coded runs of the suffixes at ``p`` with
    windows from lo to hi, and the places that recur within a run."""

    def run(batches):
        held: list[tuple[int, int, bytes, bytes, int, int, bytes, int]] = []

        def flush():
            held.sort()
            out, places = [], []
            own: list[Entry] = []
            last = None
            for shard, anchor, right, left, near, far, rk, p in held:
                if last is not None and last[:2] != (shard, anchor):
                    out.append((*last[:2], False, pack(own)))
                    own, last = [], None
                if last is not None and last[2:] == (right, left, near, far):
                    places.append((rk, p - far, p - near))
                    own[-1] = (*own[-1][:6], own[-1][6] + 1)
                else:
                    own.append((right, left, rk, p, near, far, 1))
                    last = (shard, anchor, right, left, near, far)
            out.append((*last[:2], False, pack(own)))
            if places:
                out.append((0, 0, True, _sure(places)))
            held.clear()
            return pa.RecordBatch.from_arrays(_blobs(out), names=["shard", "anchor", "sure", "blob"])

        for b in batches:
            marks_ = b.column(2)
            ends = np.cumsum(pc.list_value_length(marks_).to_numpy()).tolist()
            flat = marks_.flatten()
            each = iter(zip(*(flat.field(c).to_numpy().tolist() for c in ("p", "lo", "hi", "key", "anchor")), strict=True))
            at = 0
            for rk, text, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, strict=True):
                raw = text.encode()
                for p, lo, hi, key, anchor in islice(each, end - at):
                    held.append((key % shards, anchor, raw[p : p + length], raw[lo:p], p - hi, p - lo, rk, p))
                at = end
                if len(held) >= RUN:
                    yield flush()
        if held:
            yield flush()

    return C.map_arrow(texts.select("rk", "text", "marks"), run, BLOBS)


def merged_once(runs: DataFrame, fan: int) -> DataFrame:
    """Runs of a shard, about ``fan`` of them, as one run: an entry that is in many runs is in one then."""

    def some(t: pa.Table) -> pa.Table:
        places, own = [], []
        shard, anchor = t.column("shard")[0].as_py(), t.column("anchor")[0].as_py()
        for e, _, twin in joined(merge([Run(b) for b in t.column("blob").to_pylist()])):
            if twin is not None:
                places.append((twin[2], twin[3] - twin[5], twin[3] - twin[4]))
            else:
                own.append(e)
        out = [(shard, anchor, False, pack(own))]
        if places:
            out.append((0, 0, True, _sure(places)))
        return pa.table(_blobs(out), names=["shard", "anchor", "sure", "blob"])

    dealt = runs.where("NOT sure").withColumn("part", F.pmod(F.xxhash64("blob"), F.lit(fan)))
    return dealt.groupBy("shard", "anchor", "part").applyInArrow(some, BLOBS).unionByName(runs.where("sure"))


def recurring_windows(runs: DataFrame, length: int, fan: int = FAN) -> DataFrame:
    """(rk, lo, hi): windows that start from lo to hi recur, by merging all runs of each shard. Places that
    a run has found to recur take no part in that."""
    most = runs.where("NOT sure").groupBy("shard", "anchor").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while most > fan:
        runs = C.stored(merged_once(runs, -(-most // fan)), "merged")
        most = -(-most // fan)

    def places(x: np.ndarray) -> list[pa.Array]:
        rk = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x["rk"]).tobytes())]).cast(pa.binary())
        return [rk, pa.array(np.ascontiguousarray(x["lo"])), pa.array(np.ascontiguousarray(x["hi"]))]

    def shard(t: pa.Table) -> pa.Table:
        anchor = t.column("anchor")[0].as_py()
        found: list[tuple[bytes, int, int]] = []
        group: list[tuple[Entry, int]] = []

        def close() -> None:
            if len(group) > 1:
                for (e, _), own in zip(group, windows_of(group, length), strict=True):
                    found.extend(ranges(e, own))
            elif group and group[0][0][6] > 1:
                e = group[0][0]
                found.append((e[2], e[3] - e[5], e[3] - e[4]))
            group.clear()

        for e, common, twin in joined(merge([Run(b) for b in t.column("blob").to_pylist()])):
            if twin is not None:
                found.append((twin[2], twin[3] - twin[5], twin[3] - twin[4]))
                continue
            if common < anchor:
                close()
            group.append((e, common if group else 0))
        close()
        return pa.table(places(np.array(found, SURE)), names=["rk", "lo", "hi"])

    def sure(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(places(np.frombuffer(zlib.decompress(blob), SURE)), names=["rk", "lo", "hi"])

    kind = "rk binary, lo int, hi int"
    return runs.where("NOT sure").groupBy("shard", "anchor").applyInArrow(shard, kind).unionByName(C.map_arrow(runs.where("sure").select("blob"), sure, kind))


def cells(texts: DataFrame, length: int, width: int) -> DataFrame:
    """(rk, p, lo, hi, h, h2): from (rk, text, marks) the windows of the marks in cells of ``width``, cut by
    their distance from the mark; the hashes are of the bytes that all of a cell have in common, from ``p`` on."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw = np.frombuffer(b.column(1)[i].as_py().encode(), np.uint8)
                own = b.column(2)[i].as_py()
                for k in range(0, len(own), 2048):
                    m = np.array([(x["p"], x["lo"], x["hi"]) for x in own[k : k + 2048]])
                    first, last = (m[:, 0] - m[:, 2]) // width, (m[:, 0] - m[:, 1]) // width
                    n = last - first + 1
                    row = np.repeat(np.arange(len(m)), n)
                    cell = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[row]
                    p = m[row, 0] - width * cell
                    lo, hi = np.maximum(m[row, 1], p - width + 1), np.minimum(m[row, 2], p)
                    base = int(lo.min())
                    part = C.BYTE_VALUE[raw[base : int(p.max()) + length]]
                    h = [pa.array(C.slices(x, p - base, p - base + length - width + 1).view(np.int64)) for x in R.two_runs(part)]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(p), pa.binary()), *(pa.array(x.astype(np.int32)) for x in (p, lo, hi)), *h], names=["rk", "p", "lo", "hi", "h", "h2"])

    return C.map_arrow(texts.select("rk", "text", "marks"), run, "rk binary, p int, lo int, hi int, h long, h2 long")


def refined(recurring: DataFrame, hot: DataFrame, length: int, width: int) -> tuple[DataFrame, DataFrame | None]:
    """Cells of the hot marks (rk, p, lo, hi) whose common bytes recur: as marks, and those that are hot again."""
    own = hot.groupBy("rk").agg(F.collect_set(F.struct("p", "lo", "hi")).alias("marks"))
    texts = recurring.select("rk", "text").join(own.hint("shuffle_hash"), "rk")
    found = C.stored(cells(texts, length, width), "cells")
    often = found.groupBy("h", "h2").agg(F.count("*").alias("k")).where("k > 1")
    found = C.stored(found.join(often, ["h", "h2"]).select("rk", "p", "lo", "hi", F.col("h").alias("key"), F.lit(length - width + 1).alias("anchor"), (F.col("k") > HOT).alias("hot")), "cells")
    again = found.where("hot") if width > 1 and not found.where("hot").isEmpty() else None
    return (found if again is None else found.where("NOT hot")).drop("hot"), again


def removed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", u: R.Units = R.BYTES) -> DataFrame:
    """(rk, spans, n_removed, kept) of the rows that lose bytes; spans are byte ranges, ``kept`` the
    bytes left."""
    C.small_batches(docs.sparkSession)
    rows = R.keyed(docs, key, text)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES)
    held = R.recurring_marks(rows, u)
    place = F.struct("rk", "a")
    each = held.select("key", "a", "b", "d", (F.col("mixed") & (F.col("entries") > HOT)).alias("hot"), F.explode(F.concat(F.array(place), "others")).alias("x"))
    each = each.select("x.rk", F.struct((F.col("x.a") + F.col("d")).cast("int").alias("p"), F.col("x.a").alias("lo"), (F.col("x.a") + F.col("b") - F.col("a")).alias("hi"), "key", F.lit(u.k).alias("anchor"), "hot").alias("mark"))
    of_row = each.groupBy("rk").agg(F.collect_set("mark").alias("every"))
    recurring = C.bucketed(rows.join(of_row, "rk"), "recurring", "rk")
    cool = F.filter("every", lambda m: ~m["hot"]).cast("array<struct<p:int,lo:int,hi:int,key:long,anchor:int,hot:boolean>>")
    runs = sorted_runs(recurring.select("rk", "text", cool.alias("marks")).where(F.size("marks") > 0), shards, u.length)
    hot = recurring.select("rk", F.explode(F.filter("every", lambda m: m["hot"])).alias("m")).select("rk", "m.p", "m.lo", "m.hi")
    hot = None if hot.isEmpty() else hot
    for width in (CELL, 1):
        if hot is None:
            break
        marks_, hot = refined(recurring, hot, u.length, width)
        own = marks_.groupBy("rk").agg(F.collect_set(F.struct("p", "lo", "hi", "key", "anchor")).alias("marks"))
        runs = runs.unionByName(sorted_runs(recurring.select("rk", "text").join(own.hint("shuffle_hash"), "rk"), shards, u.length))
    found = recurring_windows(C.stored(runs, "runs"), u.length)
    starts = found.groupBy("rk").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))

    def run(batches):
        for b in batches:
            data, off = C.text_buffer(b.column(1))
            out = []
            for r, (rk, own) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                got = R.merged([(x["lo"], x["hi"] + u.length) for x in own])
                x = data[off[r] : off[r + 1]]
                stay = np.ones(len(x), bool)
                for lo, hi in got:
                    stay[lo:hi] = False
                out.append((rk, [{"start": lo, "end": hi} for lo, hi in got], int(len(x) - stay.sum()), x[stay].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.binary(), R.spans_type(), pa.int64(), pa.binary()))], names=["rk", "spans", "n_removed", "kept"])

    last = recurring.select("rk", "text").join(starts.hint("shuffle_hash"), "rk")
    return C.map_arrow(last, run, "rk binary, spans array<struct<start:int,end:int>>, n_removed long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = removed(docs).select("rk", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("cut_sha256")).dropDuplicates(["rk"])
    raw = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select("doc_id", R.row_key("doc_id", "text").alias("rk"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole_sha256"))
    zero = F.lit(0).cast("long")
    return whole.join(cut, "rk", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))
