"""Small tables with awkward rows, and brute-force versions of the operators."""

import hashlib
import re
import zlib

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward(spark, extra=()):
    """The documents of SF with nulls, empty, repeated, very long and multi-byte texts, and columns whose names clash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long_ = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    one = docs.where("doc_id = 3").first()["text"]
    rows = [(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, " \t\n ", None, None, 3), (9004, long_, "en", "s", 1), (9005, one, "en", "s", 2), (9006, one.upper(), "fr", "s", 2), (None, "no id " * 20, "en", "s", 2), (9007, "Ünïcödé 日本語 \U0001f600 " * 60, "en", "s", 2), *extra]
    out = docs.unionByName(spark.createDataFrame(rows, SCHEMA)).unionByName(docs.where("doc_id = 5"))
    clash = ("n_words", "score", "kept", "rk", "raw", "class", "computed", "found", "predicted")
    return out.withColumns({c: F.lit("mine") for c in clash}).withColumn("n_tokens", F.lit(-1))


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else 0


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def covered(lists, length):
    """For each list, which places a window covers that also starts somewhere else."""
    seen = {}
    for d, x in enumerate(lists):
        for i in range(len(x) - length + 1):
            seen.setdefault(x[i : i + length], []).append((d, i))
    out = [bytearray(len(x)) for x in lists]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i : i + length] = b"\1" * length
    return out


def words7(text):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def dedup_words(pairs):
    lists = [words7(t) for _, t in pairs]
    out = []
    for w, c in zip(lists, covered(lists, 35), strict=True):
        out.append((len(w), sum(c), " ".join(x for x, y in zip(w, c, strict=True) if not y)))
    return out


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_classes(pairs):
    """Class (least id) and links to other different texts of each row."""
    by_text = {}
    for i, t in pairs:
        by_text.setdefault(t, []).append(i)
    texts_ = [t for t in by_text if shingles(t)]
    sets = [shingles(t) for t in texts_]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            small, big = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * big and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for k, t in enumerate(texts_):
        for i in by_text[t]:
            if i is not None:
                least[find(k)] = min(i, least.get(find(k), i))
    at = {t: k for k, t in enumerate(texts_)}
    return [(i, least.get(find(at[t])) if t in at else i, links[at[t]] if t in at else 0) for i, t in pairs]


def words1(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(pairs, items):
    wins = {}
    for k, t in items:
        w = tuple(words1(t))
        for i in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(w[i : i + 13], set()).add(k)
    sizes = sorted({len(w) for w in wins})
    out = []
    for _, t in pairs:
        w, hit, ids = tuple(words1(t)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := wins.get(w[i : i + n])) is not None:
                    hit.update(range(i, i + n))
                    ids |= got
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def tiktoken_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
