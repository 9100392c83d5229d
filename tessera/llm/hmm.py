"""LM scoring with a hidden Markov model.

Tokens are lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end. The model has ``STATES``
latent states that emit classes: each of the ``HEAD`` most frequent tokens is a class of its own, the
others fall in ``BUCKETS`` classes by hash, and within a class a token has its smoothed share of the
class's count, which is gathered for every token of the corpus. Baum-Welch runs over all training
tokens; each task gives its expected counts and Spark adds them up. A long text is worked on in
stretches of ``STRETCH``: the scaled product of a stretch's transition-emission matrices carries the
forward and backward vectors from one to the next, so training and scoring are exact for whole texts.

Counts of rare tokens reach the documents by a join, those of the ``KNOWN`` most frequent ones by
broadcast (a histogram of counts says from which count on), so neither the vocabulary nor a hot word
is ever in one place.

Defined results: null and empty texts are just the end token; without training rows all counts are
0 and the model is uniform over the classes; repeated rows get equal scores; rows are told apart
by an own number, so repeated or null ids stay apart; ``score`` returns the columns of ``keep`` and its
own, which mustn't clash; a very long text is tokenised and trained on in steps.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .language import bucket

STATES, HEAD, BUCKETS, STRETCH, ROUNDS = 6, 16_000, 64, 256, 6
#: Tokens whose counts are broadcast, at most: a few MB.
KNOWN = 50_000
#: Distinct words a task counts before it passes them on; tokens of one step of the recursions.
FLUSH, STEP_TOKENS = 200_000, 1 << 20
#: Steps of a recursion between two scalings; emissions are relative to a token's largest one, so little is lost.
EVERY = 8
#: Stretches beside each other in matrix products: a multiple of this.
ALIGN = 16
SMOOTH = 0.1
END = b""
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def tokens_of(col: pa.Array):
    """By steps of a column: the first row, all its words (without ends), and the rows' offsets in them."""
    data, off = C.text_buffer(col)
    for i, j in C.steps(off):
        low = LOWER[data[off[i] : off[j]]]
        s, e, wo = C.words(low, off[i : j + 1] - off[i], C.SPACE)
        ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(low[C.SPACE[low]])])
        yield i, words, wo


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, c) over all rows; the end token is the empty string."""

    def run(batches):
        held: list[pa.Table] = []
        rows = size = 0

        def add_up() -> pa.Table:
            got = pa.concat_tables(held).group_by("token").aggregate([("c", "sum")])
            return pa.table([got.column("token").cast(pa.binary()), got.column("c_sum")], names=["token", "c"])

        for b in batches:
            rows += b.num_rows
            for _, words, _ in tokens_of(b.column(0)):
                got = words.value_counts()
                held.append(pa.table([got.field(0), got.field(1)], names=["token", "c"]))
                size += len(got)
                if size > FLUSH:
                    all_ = add_up()
                    if all_.num_rows > FLUSH // 2:
                        yield from all_.to_batches(max_chunksize=20_000)
                        held, size = [], 0
                    else:
                        held, size = [all_.cast(held[0].schema)], all_.num_rows
        if held:
            yield from add_up().to_batches(max_chunksize=20_000)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([rows], pa.int64())], names=["token", "c"])

    return C.map_arrow(docs.select(text), run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def tail_class(token: Column) -> Column:
    return F.pmod(F.crc32(token), F.lit(BUCKETS)).cast("int")


class Vocabulary:
    """What a worker knows of the tokens: classes, and the counts of the most frequent."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int, sums: dict[int, tuple[int, int]]) -> None:
        """``top``: in falling order of counts, the end token first; ``sums`` of each bucket without the head."""
        self.n, self.v = total, distinct
        self.tokens = pa.array([t for t, _ in top], pa.large_binary())
        c = np.array([c for _, c in top], np.int64)
        self.first_bucket = min(len(top), HEAD + 1)
        self.classes = self.first_bucket + BUCKETS
        #: of each bucket: log10 of the smoothed count of its tokens, one unseen included
        self.bucket_log = np.array([math.log10(s + SMOOTH * (d + 1)) for s, d in (sums.get(i, (0, 0)) for i in range(BUCKETS))])
        self.class_counts = np.full(self.classes, SMOOTH)
        self.class_counts[: self.first_bucket] += c[: self.first_bucket]
        for i, (s, _) in sums.items():
            self.class_counts[self.first_bucket + i] += s
        #: of each token of ``top``: class, log10(c + 0.1), log10 of its share in the class
        self.cls = np.arange(len(top))
        self.log_c = np.log10(c + SMOOTH)
        self.log_share = np.zeros(len(top))
        for i in range(self.first_bucket, len(top)):
            k = zlib.crc32(top[i][0]) % BUCKETS
            self.cls[i] = self.first_bucket + k
            self.log_share[i] = self.log_c[i] - self.bucket_log[k]
        self.end_known = int(c[0] > 0)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c"), F.count("*")).first()
    words = counts.where(F.octet_length("token") > 0)
    # from which count on there are KNOWN words at most: by a histogram of a few hundred cells
    cell = F.floor(8 * F.log2("c"))
    least, seen = math.inf, 0
    for k, n in sorted(((r[0], r[1]) for r in words.groupBy(cell).count().collect()), reverse=True):
        seen += n
        if seen > KNOWN:
            break
        least = k
    top = [] if least == math.inf else [(bytes(r[0]), r[1]) for r in words.where(cell >= int(least)).collect()]
    top.sort(key=lambda r: (-r[1], r[0]))
    end = counts.where(F.octet_length("token") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    sums = {r[0]: [r[1], r[2]] for r in words.groupBy(tail_class(F.col("token"))).agg(F.sum("c"), F.count("*")).collect()}
    for t, c in top[:HEAD]:  # head tokens aren't in the buckets
        k = zlib.crc32(t) % BUCKETS
        sums[k][0] -= c
        sums[k][1] -= 1
    return Vocabulary([(END, end), *top], total[0] or 0, total[1] or 0, {k: tuple(v) for k, v in sums.items()})


def prepare(docs: DataFrame, v: Vocabulary, *, text: str, keep: list[str]) -> DataFrame:
    """Each row's classes, sums over its known tokens, and its rare tokens with their frequencies."""
    held = docs.sparkSession.sparkContext.broadcast(v)
    tail = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("tf", T.IntegerType())]))
    fields = [T.StructField("classes", T.BinaryType()), T.StructField("log_c", T.DoubleType()), T.StructField("log_share", T.DoubleType()), T.StructField("known", T.LongType()), T.StructField("tail", tail)]

    def make():
        v = held.value

        def f(col: pa.Array) -> list[pa.Array]:
            parts = []
            for _, words, off in tokens_of(col):
                n = len(off) - 1
                coded = words.dictionary_encode()
                code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
                at = pc.fill_null(pc.index_in(distinct, value_set=v.tokens), -1).to_numpy()
                rare = np.flatnonzero(at < 0)
                raw, cut = C.text_buffer(distinct.take(pa.array(rare)))
                raw, cut = raw.tobytes(), cut.tolist()
                k = np.array([zlib.crc32(raw[s:e]) for s, e in zip(cut, cut[1:], strict=False)], np.int64) % BUCKETS
                cls, log_c, share = v.cls[at], v.log_c[at], v.log_share[at]
                cls[rare], log_c[rare], share[rare] = v.first_bucket + k, 0, -v.bucket_log[k]
                row = np.repeat(np.arange(n), np.diff(off))
                classes = np.zeros(len(code) + n, "<i2")  # the end token is class 0
                classes[np.arange(len(code)) + row] = cls[code]
                own = at[code] < 0
                pair, tf = np.unique(row[own] * len(distinct) + code[own], return_counts=True)
                struct = pa.StructArray.from_arrays([distinct.take(pa.array(pair % max(1, len(distinct)))).cast(pa.binary()), pa.array(tf.astype(np.int32))], names=["token", "tf"])
                parts.append([
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * (off + np.arange(n + 1))).astype(np.int32)), pa.py_buffer(classes)]),
                    *(pa.array(np.bincount(row, x[code], n) + end) for x, end in ((log_c, v.log_c[0]), (share, 0.0))),
                    pa.array(np.bincount(row, ~own, n).astype(np.int64) + v.end_known),
                    C.list_array(struct, np.bincount(pair // max(1, len(distinct)), minlength=n)),
                ])
            if not parts:
                kinds = (pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int32())])))
                return [pa.array([], t) for t in kinds]
            return [pa.concat_arrays(x) for x in zip(*parts, strict=True)]

        return f

    rows = docs.select(*keep, text).withColumn("row", F.monotonically_increasing_id())
    return C.with_arrow(rows, text, fields, make).drop(text)


class Params:
    """Start, transition and emission probabilities (classes x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(counts: np.ndarray) -> Params:
        r = np.random.default_rng(3)
        emit = counts[:, None] * r.exponential(1.0, (len(counts), STATES))
        move = r.uniform(0.5, 1.5, (STATES, STATES)) + 8 * STATES * np.eye(STATES)  # texts keep to a state at first
        return Params(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def updated(flat: np.ndarray, classes: int) -> Params:
        s, m = STATES, STATES * STATES
        start, move, emit = flat[:s] + 1, flat[s : s + m].reshape(s, s) + 1, flat[s + m :].reshape(classes, s) + SMOOTH
        return Params(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def stretches(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each stretch begins, longest first; their sizes; the row of the input, and the number in it, of each."""
    n = np.diff(off)
    parts = -(-n // STRETCH)
    row = np.repeat(np.arange(len(n)), parts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(n[row] - number * STRETCH, STRETCH)
    order = np.argsort(-size, kind="stable")
    row, number, size = row[order], number[order], size[order]
    return off[row] + number * STRETCH, size, row, number


def _running(size: np.ndarray) -> np.ndarray:
    """How many stretches, from the longest, have a token at each step."""
    return np.searchsorted(-size, -np.arange(int(size[0])), "left")


def _carried(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """``first`` (vectors or matrices: to state, from state or 1) times the emissions and moves of each
    stretch: (to, from, stretch), scaled, and the log10 of the scale without the tokens' largest emissions.
    Stretches lie side by side in memory, so that products and emissions run along them, in whole
    blocks of ``ALIGN``: at the end of one BLAS rounds otherwise, and equal texts would score apart."""
    emit, move = np.ascontiguousarray((p.emit / p.emit.max(1, keepdims=True)).T), np.ascontiguousarray(p.move.T)
    running, n = [*_running(size), 0], len(size)
    begin = np.pad(begin, (0, -n % ALIGN), "edge")
    mat = np.repeat(first[:, :, None], len(begin), 2)
    out, log = np.ones_like(mat), np.zeros(n)
    for t, m in enumerate(running[:-1]):
        if t:
            if t % EVERY == 0:  # only here are those left out that have ended
                mat = mat[:, :, : m + -m % ALIGN]
                s = mat.sum((0, 1))
                mat = mat / s
                log[:m] += np.log10(s[:m])
            mat = (move @ mat.reshape(STATES, -1)).reshape(mat.shape)
        at = begin[: mat.shape[2]] + t
        mat *= emit.take(flat.take(at, mode="clip"), axis=1)[:, None]
        if running[t + 1] < m:
            out[:, :, running[t + 1] : m] = mat[:, :, running[t + 1] : m]
    s = out.sum((0, 1))
    return (out / s)[:, :, :n], log + np.log10(s[:n])


def _by_number(number: np.ndarray):
    """The stretches that are first in their texts, then those that are second, ..."""
    order = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[order], np.arange(int(number.max(initial=-1)) + 2))
    return [order[cut[i] : cut[i + 1]] for i in range(len(cut) - 1)]


def expected_counts(flat: np.ndarray, off: np.ndarray, p: Params) -> np.ndarray:
    """Forward-backward over each row: expected starts, moves and emissions, flattened."""
    begin, size, row, number = stretches(off)
    n, later = len(size), number > 0
    before = np.tile(p.start[:, None], n)  # the forward vector before a stretch, and the backward one after it
    after = np.ones((STATES, n))
    head, rest = np.flatnonzero(~later & (np.bincount(row)[row] > 1)), np.flatnonzero(later)
    if len(rest):
        v = np.empty((STATES, len(off) - 1))
        v[:, row[head]] = _carried(flat, begin[head], size[head], p.start[:, None], p)[0][:, 0]
        mat, _ = _carried(flat, begin[rest], size[rest], p.move.T, p)
        groups = _by_number(number[rest])
        for some in groups:
            at = row[rest[some]]
            before[:, rest[some]] = v[:, at]
            new = (mat[:, :, some] * v[:, at]).sum(1)
            v[:, at] = new / new.sum(0)
        v[:] = 1
        for some in reversed(groups):
            at = row[rest[some]]
            after[:, rest[some]] = v[:, at]
            new = (mat[:, :, some] * v[:, None, at]).sum(0)
            v[:, at] = new / new.sum(0)
        after[:, head] = v[:, row[head]]
    running = _running(size)
    steps, at = len(running), np.concatenate([[0], np.cumsum(running)])
    # tokens by step, and by stretch within it: so each step is a slice
    x = np.concatenate([flat[begin[:m] + t] for t, m in enumerate(running)])
    move = p.move.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    e = np.ascontiguousarray((p.emit / p.emit.max(1, keepdims=True)).T.astype(np.float32)).take(x, axis=1)
    alpha = np.empty((STATES, len(x)), np.float32)
    scale: dict[int, np.ndarray] = {}
    before = before.astype(np.float32)
    a = np.where(later, back @ before, before)
    for t in range(steps):
        now = slice(at[t], at[t + 1])
        if t:
            a = back @ a[:, : running[t]]
        a = np.multiply(a, e[:, now], out=alpha[:, now])
        if t % EVERY == 0:
            scale[t] = s = np.maximum(a.sum(0), 1e-30)
            a /= s
    beta = after.astype(np.float32)
    beta /= np.maximum((alpha[:, at[size - 1] + np.arange(n)] * beta).sum(0), 1e-30)
    moved = np.zeros((STATES, STATES))
    for t in range(steps - 1, -1, -1):
        now = slice(at[t], at[t + 1])
        if t + 1 < steps:
            k = running[t + 1]
            eb = e[:, at[t + 1] : at[t + 2]] * beta[:, :k]
            if t + 1 in scale:
                eb /= scale[t + 1]
            moved += alpha[:, at[t] : at[t] + k] @ eb.T
            np.matmul(move, eb, out=beta[:, :k])
        if t == 0:  # the moves into a stretch from the one before
            moved += before[:, later] @ (e[:, now] * beta / scale[0])[:, later].T
        alpha[:, now] *= beta[:, : running[t]]
    moved *= p.move
    emitted = np.stack([np.bincount(x, weights=g, minlength=len(p.emit)) for g in alpha], 1)
    return np.concatenate([alpha[:, :n][:, ~later].sum(1, dtype=np.float64), moved.ravel(), emitted.ravel()])


def log10_likelihood(flat: np.ndarray, off: np.ndarray, p: Params) -> np.ndarray:
    """Exact log10 probability of each row's classes."""
    begin, size, row, number = stretches(off)
    head, rest = np.flatnonzero(number == 0), np.flatnonzero(number)
    out = np.add.reduceat(np.log10(p.emit.max(1))[flat], off[:-1])
    a = np.empty((STATES, len(out)))
    v, log = _carried(flat, begin[head], size[head], p.start[:, None], p)
    a[:, row[head]] = v[:, 0]
    out[row[head]] += log
    if len(rest):
        mat, log = _carried(flat, begin[rest], size[rest], p.move.T, p)
        for some in _by_number(number[rest]):
            r = row[rest[some]]
            v = (mat[:, :, some] * a[:, r]).sum(1)
            s = v.sum(0)
            a[:, r] = v / s
            out[r] += np.log10(s) + log[some]
    return out


def _class_steps(columns):
    """Classes and offsets of all rows of ``columns``, about STEP_TOKENS at a time, or one row."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for col in columns:
        data, off = C.text_buffer(col)
        for i, j in C.steps(off, 2 * STEP_TOKENS):
            part = data[off[i] : off[j]].view("<i2")
            if size and size + len(part) > STEP_TOKENS:
                yield _together(held)
                held, size = [], 0
            held.append((part, np.diff(off[i : j + 1]) // 2))
            size += len(part)
    if held:
        yield _together(held)


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    flat, n = (np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
    return flat, np.concatenate([[0], np.cumsum(n)])


def baum_welch(prepared: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Params:
    """Fit on all rows of ``prepared``; a round is one pass, whose counts Spark adds up by place."""
    p = Params.first(v.class_counts)
    context = prepared.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(p)

        def run(batches, held=held):
            p, total = held.value, None
            for flat, off in _class_steps(b.column(0) for b in batches):
                got = expected_counts(flat, off, p)
                total = got if total is None else total + got
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "x"])

        flat = np.zeros(STATES + STATES * STATES + STATES * v.classes)
        for at, x in C.map_arrow(prepared.select("classes"), run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            flat[at] = x  # one row for each parameter of the model
        if not flat.any():
            break
        p = Params.updated(flat, v.classes)
    return p


def score(docs: DataFrame, training: Column, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the
    rows where ``training`` is true."""
    spark = docs.sparkSession
    docs = docs.withColumn("__training", F.coalesce(training, F.lit(False)))
    counts = C.stored(count_tokens(docs.where("__training"), text), "counts")
    v = vocabulary(counts)
    rows = C.stored(prepare(docs, v, text=text, keep=[*keep, "__training"]), "classes")
    held = spark.sparkContext.broadcast(baum_welch(rows.where("__training"), v))

    def make():
        p = held.value

        def f(col: pa.Array) -> list[pa.Array]:
            got = [log10_likelihood(flat, off, p) for flat, off in _class_steps([col])]
            return [pa.array(np.concatenate(got or [np.zeros(0)]))]

        return f

    own = C.with_arrow(rows.drop("tail"), "classes", [T.StructField("sequence", T.DoubleType())], make)
    own = own.withColumn("n_tokens", F.expr("octet_length(classes) div 2")).drop("classes")
    # a rare token's share of its bucket is (c + 0.1) / the bucket's sum, which is already in log_share
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.tf").join(counts, "token", "left")
    log_c = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    tail = tail.groupBy("row").agg(F.sum(log_c).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    base_log = math.log10(v.n + SMOOTH * (v.v + 1))
    rare = F.coalesce("tail_log", F.lit(0.0))
    out = own.join(tail, "row", "left")
    return out.select(
        *keep, "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("log_c") + rare - F.col("n_tokens") * F.lit(base_log)).alias("base_score"),
        (F.col("sequence") + F.col("log_share") + rare).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, bucket("doc_id", 10) != 0)
    return out.select("doc_id", (bucket("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
