"""Language ID by hierarchical discrimination: a linear model predicts the language family,
then one-versus-one linear support vector machines tell the family's languages apart.

Every whole text becomes one vector of hashed byte 2-grams and 3-grams (letters lower-cased,
other ASCII one space), log-scaled and of unit length. Learning uses a sample of the labelled
training rows of every language: about ``PER_LANG`` a language and ``MOST`` in all, but of no language
fewer than ``LEAST`` (or all, if it has fewer). Prediction uses the text alone.

Defined results: null or letterless text is ``und`` with score 0; no training rows: all are
``und``; one learned language: it, with score 1; ties go to the first language by name;
repeated rows get equal predictions; input columns ``lang_pred`` and ``score`` are replaced, others
stay; a very long text is counted in stretches, so it takes no more memory than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

PER_LANG, MOST, LEAST = 400, 4000, 16
D3, D2 = 4096, 1024
DIM = D3 + D2

#: Families of languages. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa si ur",
}
FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs.split()}

FOLD = np.full(256, 32, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x41:0x5B] = FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)


def vectors(data: np.ndarray, off: np.ndarray, step: int = C.STEP_BYTES) -> np.ndarray:
    """One unit vector (float32) for each row."""
    out = np.zeros((len(off) - 1, DIM), np.float32)
    for first, at, o in C.cuts(off, step, 2):
        x = FOLD[data[at : at + int(o[-1])]].astype(np.uint32)
        n = len(o) - 1
        row = np.repeat(np.arange(n), np.diff(o))
        for size, base, dim in ((3, 0, D3), (2, D3, D2)):
            m = min(len(x) - size + 1, step)  # what starts later is in the row's next stretch
            if m < 1:
                continue
            g = x[:m] * np.uint32(0x9E3779B1)
            for j in range(1, size):
                g = (g ^ x[j : m + j]) * np.uint32(0x85EBCA6B) + (g >> np.uint32(15))
            ok = row[:m] == row[size - 1 : m + size - 1]
            key = row[:m][ok] * dim + ((g[ok] >> np.uint32(7)) % np.uint32(dim))
            out[first : first + n, base : base + dim] += np.bincount(key, minlength=n * dim).reshape(n, dim)
    np.log1p(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def _letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    c = np.concatenate([[0], np.cumsum((FOLD[data] > 32) & (data < 0x80))])
    got = np.diff(c[off]) > 0
    for i in np.flatnonzero(~got & (np.diff(off) > 0)).tolist():
        got[i] = any(ch.isalpha() for ch in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return got


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Linear support vector machines, one for each column of ``y`` (labels -1 and 1), all at once over one
    copy of ``x`` (squared hinge loss, accelerated gradient descent, both labels weighted evenly)."""
    up = y > 0
    weight = (c * np.where(up, 0.5 / np.maximum(1, up.sum(0)), 0.5 / np.maximum(1, (~up).sum(0)))).astype(np.float32)
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    bias = b = np.zeros(y.shape[1], np.float32)
    step, t = np.float32(1.0 / (1 + 2 * c * 2)), 1.0
    for _ in range(rounds):
        pull = 2 * weight * np.maximum(0, 1 - y * (x @ v + b)) * y
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = np.float32((t - 1) / t2)
        new, new_bias = v - step * (np.float32(0.02) * v - x.T @ pull), b - step * (np.float32(0.02) * b - pull.sum(0))
        v, b, w, bias, t = new + ahead * (new - w), new_bias + ahead * (new_bias - bias), new, new_bias, t2
    return w, bias


class Model:
    """Families, and in each its languages and pairwise machines, as one weight matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        names = sorted(set(langs))
        y = np.array(langs)
        fam = np.array([FAMILY.get(v, v) for v in langs])
        self.families = sorted(set(fam.tolist()))
        self.members = {f: [v for v in names if FAMILY.get(v, v) == f] for f in self.families}
        ws, bs, machines = [], [], 0
        if len(self.families) > 1:
            w, b = svm(x, np.where(fam[:, None] == np.array(self.families)[None, :], 1, -1).astype(np.float32))
            ws, bs, machines = [w], [b], len(b)
        self.pairs: dict[str, list[tuple[int, int, int]]] = {}
        for f, m in self.members.items():
            self.pairs[f] = []
            for i in range(len(m)):
                for j in range(i + 1, len(m)):
                    own = (y == m[i]) | (y == m[j])
                    self.pairs[f].append((i, j, machines))
                    w, b = svm(x[own], np.where(y[own] == m[i], 1, -1).astype(np.float32)[:, None])
                    ws.append(w)
                    bs.append(b)
                    machines += 1
        self.w = np.hstack(ws) if ws else np.zeros((DIM, 0), np.float32)
        self.b = np.concatenate(bs) if bs else np.zeros(0, np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        s = x @ self.w + self.b
        n, k = len(x), len(self.families)
        soft = np.ones((n, 1))
        if k > 1:
            soft = 1 / (1 + np.exp(-4 * s[:, :k].astype(np.float64)))
            soft /= soft.sum(1, keepdims=True)
        fam = soft.argmax(1)
        langs: list = [None] * n
        score = soft[np.arange(n), fam]
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(fam == i)
            m = self.members[f]
            votes, p = np.zeros((len(rows), len(m))), np.zeros((len(rows), len(m)))
            for a, b, at in self.pairs[f]:
                q = 1 / (1 + np.exp(-4 * s[rows, at].astype(np.float64)))
                p[:, a] += q
                p[:, b] += 1 - q
                votes[:, a] += q >= 0.5
                votes[:, b] += q < 0.5
            best = (votes + p / (len(m) + 1)).argmax(1)
            if len(m) > 1:
                score[rows] *= p[np.arange(len(rows)), best] / (len(m) - 1)
            for r, c in zip(rows.tolist(), best.tolist(), strict=True):
                langs[r] = m[c]
        return langs, score


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Fit on labelled rows, chosen by a hash of key and text; their vectors, 10 KB a row of the bounded
    sample, are the only thing that comes to the driver."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    per = max(LEAST, min(PER_LANG, MOST // len(counts)))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, (1.1 * per + LEAST) / n))])
    u = (F.xxhash64("key", "text") / F.lit(2.0**64)) + 0.5
    picked = rows.where(u < share[F.col("lang")]).select("lang", "text")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                v = vectors(*C.text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())], names=["lang", "v"])

    got = C.map_arrow(picked, run, "lang string, v binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))  # tasks end in any order
    return Model(np.array([np.frombuffer(r[1], np.float16) for r in got], np.float32), [r[0] for r in got])


def predict(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen vectors of DIM floats

    def make():
        model = held.value

        def f(col: pa.Array) -> list[pa.Array]:
            data, off = C.text_buffer(col)
            langs: list = ["und"] * len(col)
            score = np.zeros(len(col))
            if model is not None:
                for i in range(0, len(col), 64):
                    for lo, hi in C.steps(off[i : i + 65]):
                        o = off[i + lo : i + hi + 1]
                        d, o = data[o[0] : o[-1]], o - o[0]
                        has = _letters(d, o)
                        got, p = model.predict(vectors(d, o))
                        for r in np.flatnonzero(has).tolist():
                            langs[i + lo + r], score[i + lo + r] = got[r], p[r]
            return [pa.array(langs, pa.string()), pa.array(np.clip(score, 0, 1))]

        return f

    return C.with_arrow(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def bucket(key: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs.where(bucket("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
