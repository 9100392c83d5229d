"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from counts of
pairs of character classes and of hashed letter 2-grams; a learned layer gives its embedding h,
gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the document's
label is learned from, and its score computed on, the weighted sum of the embeddings.

Fitting takes a bounded sample of the labelled training rows: about ``PER_CLASS`` a class, of texts of up
to ``LONGEST`` bytes, with every passage of them. Scoring encodes every passage of every text, a
very long one in stretches whose weighted sums are put together.

Defined results: null and empty texts are one passage without counts, so they have a score; without
training rows of both classes the score is the share of label 1 (0.5 without any); labels of a row
that is labelled twice are averaged and rounded; of several texts of one id the least is learned from;
repeated rows get equal scores; input columns ``score`` and ``predicted`` are replaced, others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .language import bucket

PER_CLASS, LONGEST = 1500, 1 << 18
#: Steps that a fit takes at least, so that a few labels are enough.
LEAST_STEPS = 400
PASSAGE = 256
#: Bytes of text that are encoded at once, a multiple of PASSAGE.
STRETCH = 1 << 19
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
KINDS, GRAMS = 16, 256
DIM = KINDS * KINDS + GRAMS
HIDDEN, GATE = 32, 16

#: The class of each byte.
KIND = np.full(256, 15, np.int64)
KIND[0x00:0x20] = 0
KIND[[0x20, 0x0A, 0x09]] = [1, 2, 1]
KIND[0x30:0x3A] = 3
KIND[0x41:0x5B] = 4
KIND[0x61:0x7B] = 5
KIND[0x80:] = 6
for _c, _k in zip(b".,!?$#%*|", (7, 8, 9, 10, 11, 12, 13, 13, 14), strict=True):
    KIND[_c] = _k


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and how many passages each row has (one at least)."""
    size = np.diff(off)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    n = int(count.sum())
    x = np.zeros((n, DIM), np.float32)
    if len(data) > 1:
        row = np.repeat(np.arange(len(size)), size)
        at = first[row] + (np.arange(len(data)) - off[row]) // PASSAGE
        ok = np.flatnonzero(at[:-1] == at[1:])
        at = at[ok]
        k = KIND[data]
        x[:, : KINDS * KINDS] = np.bincount(at * KINDS**2 + k[ok] * KINDS + k[ok + 1], minlength=n * KINDS**2).reshape(n, -1)
        d = data.astype(np.int64)
        gram = ((d[ok] | 32) * 31 + (d[ok + 1] | 32) * 7919) % GRAMS
        x[:, KINDS * KINDS :] = np.bincount(at * GRAMS + gram, minlength=n * GRAMS).reshape(n, -1)
    np.sqrt(x, out=x)
    return x / 8, count


class Model:
    """Weights of the encoder, the gated attention and the output; or one constant score."""

    def __init__(self, constant: float = 0.5) -> None:
        self.constant, self.p = constant, None

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict:
        e, be, v, u, w, c, b = self.p
        first = np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        h = np.maximum(x @ e + be, 0)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -30, 30)))
        g = (tv * su) @ w
        a = np.exp(g - np.maximum.reduceat(g, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return {"first": first, "bag": bag, "h": h, "tv": tv, "su": su, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ c + b, -30, 30)))}

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A score for each text; stretches of one long text are joined by their attention's weights."""
        if self.p is None:
            return np.full(len(off) - 1, self.constant)
        n = len(off) - 1
        top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        e, be, v, u, w, c, b = self.p
        for i, at, o in C.cuts(off, STRETCH):
            x, count = encode(data[at : at + int(o[-1])], o)
            first = np.cumsum(count) - count
            h = np.maximum(x @ e + be, 0)
            g = (np.tanh(h @ v) / (1 + np.exp(-np.clip(h @ u, -30, 30)))) @ w
            own = slice(i, i + len(count))
            new = np.maximum(top[own], np.maximum.reduceat(g, first))
            a = np.exp(g - np.repeat(new, count))
            keep = np.exp(top[own] - new)  # what earlier stretches of the text weigh now
            total[own] = total[own] * keep + np.add.reduceat(a, first)
            z[own] = z[own] * keep[:, None] + np.add.reduceat(h * a[:, None], first, axis=0)
            top[own] = new
        return 1 / (1 + np.exp(-np.clip((z / total[:, None]) @ c + b, -30, 30)))

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rounds: int = 12, batch: int = 64) -> None:
        r = np.random.default_rng(7)
        shapes = [(DIM, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
        self.p = [(r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or s[0] > 1 else np.zeros(s)).astype(np.float32) for s in shapes]
        self.p[1][:] = 0
        rounds = max(rounds, -(-LEAST_STEPS * batch // max(batch, len(bags))))
        m, s2, t = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for k in range(rounds):
            order = r.permutation(len(bags))
            for i in range(0, len(bags), batch):
                some = order[i : i + batch]
                x = np.concatenate([bags[j] for j in some]).astype(np.float32)
                count = np.array([len(bags[j]) for j in some])
                f = self.forward(x, count)
                _, _, v, u, w, c, _ = self.p
                dy = ((f["y"] - labels[some]) * weight[some] / len(some)).astype(np.float32)
                dz = dy[:, None] * c
                da = (dz[f["bag"]] * f["h"]).sum(1)
                dg = f["a"] * (da - np.add.reduceat(da * f["a"], f["first"])[f["bag"]])
                dgate = dg[:, None] * w
                dv, du = dgate * f["su"] * (1 - f["tv"] ** 2), dgate * f["tv"] * f["su"] * (1 - f["su"])
                dh = (dz[f["bag"]] * f["a"][:, None] + dv @ v.T + du @ u.T) * (f["h"] > 0)
                grads = [x.T @ dh, dh.sum(0), f["h"].T @ dv, f["h"].T @ du, (f["tv"] * f["su"]).T @ dg, f["z"].T @ dy, np.array([dy.sum()])]
                t += 1
                rate = 0.004 * (1 - k / rounds) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for q, g, a, b in zip(self.p, grads, m, s2, strict=True):
                    g = g + 1e-4 * q
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Fit on ``docs`` that ``labels`` has. A bounded sample of labels picks the rows; only the
    features of those, some tens of MB, come to the driver."""
    known = docs.where(F.col(key).isNotNull() & (F.coalesce(F.octet_length(text), F.lit(0)) <= LONGEST))
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.round(F.avg(label)).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1)).join(known.select(key), key, "left_semi")
    n = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model(float(next(iter(n))) if n else 0.5)
    u = (F.xxhash64(key) / F.lit(2.0**64)) + 0.5
    share = F.when(F.col("label") == 1, min(1.0, PER_CLASS / n[1])).otherwise(min(1.0, PER_CLASS / n[0]))
    picked = own.withColumn("u", u).where(F.col("u") < share).orderBy("u", key).limit(3 * PER_CLASS).drop("u")  # about 2 * PER_CLASS
    rows = known.select(key, text).join(F.broadcast(picked), key)  # picked: at most 3 * PER_CLASS rows
    rows = rows.groupBy(key).agg(F.min("label").alias("label"), F.min(text).alias("text")).select("label", "text")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 16):
                part = b.slice(i, 16)
                x, count = encode(*C.text_buffer(part.column(1)))
                x, ends = x.astype(np.float16), np.cumsum(count).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[z - c : z].tobytes() for z, c in zip(ends, count.tolist(), strict=True)], pa.binary())], names=["label", "x"])

    got = sorted(C.map_arrow(rows, run, "label int, x binary").collect(), key=lambda r: (r[0], bytes(r[1][:4096])))
    y = np.array([r[0] for r in got])
    model = Model()
    if len(set(y.tolist())) < 2:
        return Model(float(y.mean()) if len(y) else 0.5)
    weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
    model.fit([np.frombuffer(r[1], np.float16).reshape(-1, DIM) for r in got], y, weight / weight.mean())
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct of ``score`` and ``predicted``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # under 100 KB

    def make():
        model = held.value

        def f(col: pa.Array) -> list[pa.Array]:
            s = model.score(*C.text_buffer(col))
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return f

    return C.computed(docs, text, FIELDS, make)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    held = C.free_name(docs, "scored")
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.withColumn(held, scored(docs, model, text)).select(*[f"`{c}`" for c in own], f"{held}.score", f"{held}.predicted")


def accepted(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows that the model takes for label 1, with their own columns."""
    held = C.free_name(docs, "scored")
    return docs.withColumn(held, scored(docs, model, text)).where(f"{held}.predicted = 1").drop(held)


def learned(spark, sf_dir: str, docs: DataFrame) -> Model:
    """A model from the labels of ``sf_dir`` and the contract's training rows of ``docs``."""
    return train(docs.where(bucket("doc_id", 3) != 1).select("doc_id", "text"), C.table(spark, sf_dir, "labels"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learned(spark, sf_dir, docs))
    return out.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
