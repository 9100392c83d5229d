"""Shared first steps of the two substring dedups: where repeated windows of ``length`` units (words
or bytes) may be.

Each window is marked by the ``k``-gram of least hash inside it, so equal windows have equal marks at
equal distances. Neighbouring windows of one mark form an interval; an interval's *context* is all
the text that its windows cover. A window can only repeat if its mark's k-gram does. Equal contexts
of one step are one row with the places of all, so a hot passage sends a row a step, not a text.

Rows are told apart by ``rk``, an MD5 of id and text. Hashes of contexts and windows have 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Text bytes of one step, and units that one search for marks works on; positions have 24 bits there.
STEP, MOST_UNITS = 1 << 18, 1 << 19
PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Units:
    """Words of a text (by their hashes), or its bytes."""

    by_word: bool
    length: int
    k: int

    def split(self, data: np.ndarray, off: np.ndarray):
        """The units, and the rows' offsets in them."""
        if not self.by_word:
            return data, off
        s, e, wo = C.words(data, off, C.SPACE)
        return C.word_hashes(data, s, e), wo

    @staticmethod
    def values(units: np.ndarray) -> np.ndarray:
        """64 random bits for each unit."""
        return C.BYTE_VALUE[units] if units.dtype == np.uint8 else units


WORDS = Units(True, 35, 12)
BYTES = Units(False, 200, 40)


def row_key(key: str, text: str) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")), F.col(text).isNull().cast("string")).cast("binary")))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(row_key(key, text).alias("rk"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def two_runs(values: np.ndarray):
    """For 128-bit hashes of slices."""
    return C.running(values), C.running(C.mix(values ^ C._MULT))


def marks(units: np.ndarray, off: np.ndarray, u: Units):
    """Intervals of windows with one mark: row, first and last window start (in the row), the mark's
    distance from the first, the hash of its k-gram, and two hashes of the context."""
    n, w = len(units), u.length - u.k + 1
    if n < u.length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    if n > MOST_UNITS:
        out = []
        for i, j in C.steps(off, MOST_UNITS):
            lo, hi = int(off[i]), int(off[j])
            if hi - lo <= MOST_UNITS:
                row, *rest = marks(units[lo:hi], off[i : j + 1] - lo, u)
                out.append((row + i, *rest))
            else:  # one very long row: windows by stretches
                for at in range(lo, hi - u.length + 1, MOST_UNITS // 2):
                    part = units[at : min(at + MOST_UNITS // 2 + u.length - 1, hi)]
                    row, a, b, *rest = marks(part, np.array([0, len(part)]), u)
                    out.append((row + i, a + (at - lo), b + (at - lo), *rest))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    values = u.values(units)
    run, run2 = two_runs(values)
    p = np.arange(n - u.k + 1)
    grams = C.slices(run, p, p + u.k)
    v = np.full(-(-len(p) // w) * w, ~np.uint64(0))
    v[: len(p)] = (grams & ~PLACE) | p.astype(np.uint64)
    v = v.reshape(-1, w)
    ahead = np.minimum.accumulate(v, 1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    s = np.arange(n - u.length + 1)
    at = (np.minimum(behind[: len(s)], ahead[w - 1 : w - 1 + len(s)]) & PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = row[: len(s)] == row[u.length - 1 :]
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1] | (row[1 : len(s)] != row[: len(s) - 1])
    first = np.flatnonzero(new & inside)
    end = np.ones(len(s), bool)
    end[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(end & inside)
    d = at[first] - first
    with np.errstate(over="ignore"):
        ctx = [C.mix(C.slices(r, first, last + u.length) + d.astype(np.uint64)) for r in (run, run2)]
    r = row[first]
    return r, first - off[r], last - off[r], d, grams[at[first]], *ctx


def each_step(b: pa.RecordBatch, text: int, u: Units):
    """(first row, data, its offsets, units, their offsets) by steps of a batch."""
    data, off = C.text_buffer(b.column(text))
    for i, j in C.steps(off, STEP):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        yield (i, d, o, *u.split(d, o))


def mark_rows(rows: DataFrame, u: Units) -> DataFrame:
    """(rk, row, a, b, d, key, ctx, ctx2, n, others): a row for each context of a step, with the other places
    (rk, a) where the step has it; ``n`` counts all. ``row``: the first half of ``rk``."""

    def run(batches):
        for batch in batches:
            for i, _, _, units, off in each_step(batch, 1, u):
                r, a, b, d, key, ctx, ctx2 = marks(units, off, u)
                _, first, group = np.unique(ctx, return_index=True, return_inverse=True)
                odd = np.flatnonzero(ctx2 != ctx2[first][group])  # equal in the one hash only
                group[odd] = len(first) + np.arange(len(odd))
                first = np.concatenate([first, odd])
                n = np.bincount(group, minlength=len(first))
                later = np.ones(len(r), bool)
                later[first] = False
                later = np.flatnonzero(later)
                later = later[np.argsort(group[later], kind="stable")]
                rk = lambda at, r=r, i=i, batch=batch: pc.take(batch.column(0), pa.array(r[at] + i))
                others = C.list_array(pa.StructArray.from_arrays([rk(later), pa.array(a[later].astype(np.int32))], names=["rk", "a"]), n - 1)
                half = np.frombuffer(C.text_buffer(batch.column(0))[0].tobytes(), ">i8")[::2].astype(np.int64)
                cols = [rk(first), pa.array(half[r[first] + i]), *(pa.array(x[first].astype(np.int32)) for x in (a, b)), pa.array(d[first].astype(np.int16)), *(pa.array(x[first].view(np.int64)) for x in (key, ctx, ctx2)), pa.array(n.astype(np.int32)), others]
                yield pa.RecordBatch.from_arrays(cols, names=["rk", "row", "a", "b", "d", "key", "ctx", "ctx2", "n", "others"])

    return C.map_arrow(rows, run, "rk binary, row long, a int, b int, d short, key long, ctx long, ctx2 long, n int, others array<struct<rk:binary,a:int>>")


def recurring_marks(rows: DataFrame, u: Units) -> DataFrame:
    """Of ``mark_rows`` those whose k-gram recurs, with ``entries`` (rows of the k-gram), ``mixed`` (its
    contexts differ), ``of_key`` (its places) and ``least`` (its least ``row``), stored. The counts are
    written first, so that the join deals out a hot k-gram's rows anew."""
    every = mark_rows(rows, u)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("ctx", "ctx2") for f in (F.min, F.max)]
    keys = every.groupBy("key").agg(F.sum("n").alias("of_key"), F.count("*").alias("entries"), F.min("row").alias("least"), *ends)
    keys = C.stored(keys.where("of_key > 1").select("key", "of_key", "entries", "least", F.expr("min_ctx <> max_ctx OR min_ctx2 <> max_ctx2").alias("mixed")), "keys")
    return C.stored(every.join(keys.hint("shuffle_hash"), "key"), "marks")


def spans_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal ranges of what the given ones cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
