"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

A text is cut by the tokenizer's pattern into pieces. The distinct pieces of a batch are
put in matrices, one row a piece, padded, one matrix for each bucket of lengths; each round
looks up the rank of every neighbouring pair in a hash table, merges the leftmost pair of
least rank in each row, closes the gap, and drops the rows that have no pair left.
A piece over ``LONG`` bytes takes one row of a linked list with a heap instead, merging in
the same order: a round of the matrix costs the row's width, which would be quadratic.

Defined results: null and empty texts give no ids and decode to no bytes; pieces never cross
rows; special tokens are ordinary text; repeated rows get equal ids; a very long text is matched and
encoded in stretches of ``STRETCH`` pieces, so it takes a few times its own size; columns named like
a new one are replaced, others stay.
"""

from __future__ import annotations

import base64
import functools
import heapq
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LONG = 256
BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONG)
#: Pieces, and their bytes, remembered by a worker; the memory is emptied when either is full.
REMEMBERED, REMEMBERED_BYTES = 300_000, 8 << 20
#: Pieces of a long text that are encoded together.
STRETCH = 1 << 16
NONE = np.int32(2**31 - 1)
NO_IDS = np.zeros(0, np.int32)


class Numbers(dict):
    """Pieces by the order in which they were met; ``new`` are those not encoded yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.size = 0

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        self.size += len(piece)
        return n


def stretches(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of all slices starts:starts+counts, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Ranks:
    """A rank file: bytes by id, and the rank of each pair of ids in a hash table with
    linear probing (a pair's rank is the id of its joined bytes)."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.rank.values()) + 1
        self.bytes = [b""] * size
        for k, v in self.rank.items():
            self.bytes[v] = k
        self.byte_id = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        get = self.rank.get
        halves = ((a * size + b, r) for t, r in self.rank.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None)
        pairs = np.fromiter(halves, np.dtype([("k", "i8"), ("rank", "i4")]))
        self.size = size
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        self.probes, left, at = 0, np.arange(len(pairs)), self._slot(pairs["k"])
        while len(left):  # of the pairs that want a free slot one gets it, the others go on to the next
            self.probes += 1
            open_ = left[self.keys[at[left]] < 0]
            put = open_[np.unique(at[open_], return_index=True)[1]]
            self.keys[at[put]], self.vals[at[put]] = pairs["k"][put], pairs["rank"][put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.forget()

    def forget(self) -> None:
        """Start with no remembered pieces: ``ids`` has those of all pieces joined."""
        self.numbers, self.ids = Numbers(), NO_IDS
        self.starts = self.counts = np.zeros(0, np.int64)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it isn't a token or either side is padding (-1)."""
        k = a.astype(np.int64) * self.size + b
        k[(a < 0) | (b < 0)] = -2
        at = self._slot(k)
        got = self.keys[at]
        out = np.where(got == k, self.vals[at], NONE)
        open_ = np.flatnonzero((got != k) & (got >= 0) & (k >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            hit = got == k[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merge_matrix(self, rows: list[bytes], width: int) -> np.ndarray:
        """Ids of each row, padded with -1."""
        n = len(rows)
        lens = np.fromiter(map(len, rows), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        result = np.full((n, width), -1, np.int32)
        left = np.arange(n)
        rank = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(left):
            at = rank.argmin(1)
            low = rank[np.arange(len(left)), at]
            done = low == NONE
            if done.any():
                result[left[done], : ids.shape[1]] = ids[done]
                keep = ~done
                left, ids, rank, at, low = left[keep], ids[keep], rank[keep], at[keep], low[keep]
                if not len(left):
                    break
            r = np.arange(len(left))
            ids[r, at] = low
            w = ids.shape[1]
            # close the gap at at+1 in the ids, and at at in the ranks
            move = np.arange(w - 1) > at[:, None]
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if w > 2:
                rank[:, :-1] = np.where(move[:, : w - 2], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            for side in (-1, 0):
                q = at + side
                ok = np.flatnonzero((q >= 0) & (q < w - 1))
                rank[ok, q[ok]] = self.pair(ids[ok, q[ok]], ids[ok, q[ok] + 1])
            used = int((ids >= 0).any(0).sum())
            if used < w and used >= 2:
                ids, rank = ids[:, :used], rank[:, : used - 1]
        return result

    def merge_long(self, piece: bytes) -> list[int]:
        ids: list = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        get, tok = self.rank.get, self.bytes
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(tok[ids[i]] + tok[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := get(tok[r] + tok[ids[k]])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (h := before[i]) >= 0 and (q := get(tok[ids[h]] + tok[r])) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def learn(self) -> None:
        """Encode the pieces that were met for the first time."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        raw = [p.encode() for p in new]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.rank.get(x, -1) for x in raw), np.int32, len(raw))
        rest = np.flatnonzero(whole < 0)
        counts = np.ones(len(raw), np.int64)
        got = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        bucket = np.searchsorted(BUCKETS, lens[rest])
        for k, width in enumerate(BUCKETS):
            own = rest[bucket == k]
            for lo in range(0, len(own), 1 << 14):
                part = own[lo : lo + (1 << 14)]
                ids = self.merge_matrix([raw[i] for i in part.tolist()], width)
                full = ids >= 0
                counts[part] = full.sum(1)
                got.append((part, ids[full]))
        for i in rest[bucket == len(BUCKETS)].tolist():
            ids = np.array(self.merge_long(raw[i]), np.int32)
            counts[i] = len(ids)
            got.append((np.array([i]), ids))
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for part, ids in got:
            flat[stretches(starts[part], counts[part])] = ids
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, flat])

    def number(self, cut: list[str]) -> np.ndarray:
        """The numbers of pieces, all of them encoded."""
        at = np.fromiter(map(self.numbers.__getitem__, cut), np.int64, len(cut))
        self.learn()
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and how many each text has."""
        self.make_room()
        cut = [self.pattern.findall(t) for t in texts]
        off = np.cumsum([0, *map(len, cut)])
        at = self.number(list(chain.from_iterable(cut)))
        counts = self.counts[at]
        return self.ids[stretches(self.starts[at], counts)], np.diff(np.concatenate([[0], np.cumsum(counts)])[off])

    def encode_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of one text, some pieces at a time."""
        found, parts = self.pattern.finditer(text), [NO_IDS]
        while cut := [m[0] for m in islice(found, STRETCH)]:
            self.make_room()
            at = self.number(cut)
            parts.append(self.ids[stretches(self.starts[at], self.counts[at])])
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])

    def make_room(self) -> None:
        if len(self.numbers) > REMEMBERED or self.numbers.size > REMEMBERED_BYTES:
            self.forget()


@functools.lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    """One for each worker process."""
    return Ranks(path, pattern)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids, joined, and each one's start and length: all that decoding needs."""
    with open(path, "rb") as f:
        by_id = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    lens = np.zeros(max(by_id) + 1, np.int64)
    lens[list(by_id)] = [len(v) for v in by_id.values()]
    return np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8), np.cumsum(lens) - lens, lens


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text. ``path``: a rank file that every executor has."""

    def make():
        r = ranks(path, pattern)

        def f(col: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in col.to_pylist()]
            flat, n = [NO_IDS], [np.zeros(0, np.int64)]
            sizes = np.cumsum([0, *map(len, texts)])
            for i, j in C.steps(sizes, 1 << 19):
                got, counts = r.encode(texts[i:j]) if sizes[j] - sizes[i] <= 1 << 19 else r.encode_long(texts[i])
                flat.append(got)
                n.append(counts)
            return [C.list_array(pa.array(np.concatenate(flat), pa.int32()), np.concatenate(n))]

        return f

    return C.with_arrow(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], make)


def decode(tokens: DataFrame, path: str, pattern: str, *, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of each list of ids."""

    def make():
        data, starts, lens = token_bytes(path)

        def f(col: pa.Array) -> list[pa.Array]:
            off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy())])
            flat = col.flatten().to_numpy()
            texts = []
            for i, j in C.steps(off, 1 << 18):
                own = flat[off[i] : off[j]]
                raw = data[stretches(starts[own], lens[own])].tobytes()
                ends = np.concatenate([[0], np.cumsum(lens[own])])[off[i : j + 1] - off[i]].tolist()
                texts += [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            return [pa.array(texts, pa.binary())]

        return f

    return C.with_arrow(tokens, ids, [T.StructField(out, T.BinaryType())], make)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    d = encode(C.table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).select("doc_id", "token_ids")
    d = decode(d, path, pattern)
    return d.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
