"""Each operator against brute force, an exact round trip or held-out accuracy, on tables with awkward rows."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, flac, hmm, jaccard, language, phrases, quality, suffixes, urls
from tests.llm import fixtures as X
from tests.oracle import compare


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_decontamination(spark):
    docs = X.awkward(spark)
    bench = spark.read.parquet(f"{X.SF}/benchmark.parquet").unionByName(spark.createDataFrame([(701, "The Short item"), (702, None), (703, "")], "item_id bigint, text string"))
    pairs, items = X.texts(docs), [(r[0], r[1]) for r in bench.select("item_id", "text").collect()]
    want = X.contamination(pairs, items)
    assert any(w[4] for w in want)
    for block in (decontaminate.BLOCK_WINDOWS, 1000):
        got = decontaminate.scan(docs, bench, block_windows=block).select("doc_id", "n_words", "n_hit", "items").collect()
        same([(r[0], r[1], r[2], len(r[3])) for r in got], [(p[0], *w[:3]) for p, w in zip(pairs, want, strict=True)])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[4] for w in want)
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    cut = decontaminate.cut_hits(docs, bench)
    assert decontaminate.scan(cut, bench).agg(F.sum("n_hit")).first()[0] < sum(w[1] for w in want)


def test_language(spark):
    docs = X.awkward(spark)
    model = language.train(docs.where(language.bucket("doc_id", 4) != 2))
    got = language.predict(docs, model).collect()
    held = [r for r in got if X.crc(r.doc_id, 4) == 2 and r.doc_id is not None and r.doc_id < 9000]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (9001, 9002, 9003)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    assert language.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language.predict(docs.limit(3), None).collect()} == {"und"}


def test_url_filter_is_its_sql(spark):
    compare(spark, urls.query, urls.SQL, "/root/testdata/sf0.01")


def test_url_filter_odd_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://Example.ORG/es/1?x#y"), (4, "x://example.org"), (5, "a://m.EXAMPLE.org/en/12"), (6, "a://x.com/de/1"), (7, "a://x.com/fr/1"), (8, ""), (1, None), (9, "a://notcom/de/1")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 10)] == [("", "", None), ("", "", None), ("example.org", "/es/1", "example.org/es/"), ("example.org", "", None), ("m.example.org", "/en/12", "example.org/en/1"), ("x.com", "/de/1", "com/de/"), ("x.com", "/fr/1", "com/fr/"), ("", "", None), ("notcom", "/de/1", None)]
    assert [got[i].verdict for i in (3, 5, 6, 7)] == ["block", "block", "block", "allow"]
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0


def test_url_filter_tells_deep_branches_apart(spark):
    rules = [("block", "a.net/2024/05/ads/x"), ("allow", "a.net/2024/05/news/x")]
    urls_ = [f"h://a.net/2024/05/{kind}/{c}{i}/end" for kind in ("ads", "news") for i in range(40) for c in "xy"]
    want = {u: ("block" if "/ads/" in u else "allow", f"a.net/2024/05/{u.split('/')[5]}/*/end") for u in urls_}
    for times in (1, 5):  # the same site, crawled more often
        df = spark.createDataFrame([(u,) for u in [*urls_, "h://a.net/2024/05"] * times], "url string")
        got = urls.judge(df, rules).collect()
        assert len(got) == times * (len(urls_) + 1)
        assert {r.url: (r.verdict, r.template) for r in got if r.url in want} == want


def test_url_filter_counts_a_url_once(spark):
    rows = [f"h://b{h}.net/{i}/{i * 7}" for h in range(2) for i in range(8)]
    got = [{(r.url, r.template, r.block_rate) for r in urls.judge(spark.createDataFrame([(u,) for u in rows * n], "url string")).collect()} for n in (1, 4)]
    assert got[0] == got[1] and {t for _, t, _ in got[0]} == {"b0.net/*/*", "b1.net/*/*"}


def test_jaccard(spark):
    docs = X.awkward(spark, [(9100 + i, "one two three four five six seven eight nine ten " * 3 + "tail" * (i % 5), "en", "s", 1) for i in range(150)])
    got = jaccard.join(docs).collect()
    same([(r.doc_id, r.class_id, r.n_links) for r in got], X.near_classes(X.texts(docs)))
    assert jaccard.join(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == sorted({c for i, c, _ in X.near_classes([p for p in X.texts(docs) if p[0] is not None])})


def test_jaccard_counts_links_once_beside_empty_blocks(spark, monkeypatch):
    # near texts as large as a block: two or three blocks a pair, and often both texts in one of them
    pairs = [(2 * i + k, f"pair{i} " + " ".join(f"w{i}x{j}" for j in range(80)) + f" end{k}") for i in range(12) for k in range(2)]
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", min(len(t) for _, t in pairs))
    got = jaccard.join(spark.createDataFrame(pairs, "doc_id bigint, text string")).collect()
    same([(r.doc_id, r.class_id, r.n_links) for r in got], X.near_classes(pairs))


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_jaccard_runs_reach_the_recall_at_every_level(threshold):
    def lives(levels):  # one coordinate is drawn at a node, or two, 1/threshold on average
        if not levels:
            return 1.0
        p, two = threshold * lives(levels - 1), 1 / threshold - 1
        return (1 - two) * p + two * (1 - (1 - p) ** 2)

    for level in range(1, jaccard.DEPTH + 1):
        assert (1 - lives(level)) ** jaccard.runs_for(jaccard.RECALL, threshold) <= 1 - jaccard.RECALL


def test_exact_near_by_hand():
    a, b = np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64)
    assert jaccard.exact_near([a, b], 0.8).tolist() == [[False, True], [True, False]]
    assert not jaccard.exact_near([a, np.arange(7, dtype=np.uint64)], 0.8).any()


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([[1.0 if g > b else 0.5 if g == b else 0.0 for b in bad] for g in good]) > 0.9
    docs = X.awkward(spark)
    out = quality.score(docs, quality.Model(0.25)).collect()
    assert len(out) == docs.count() and {r.score for r in out} == {0.25}
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.train(docs, none).constant == 0.5


def test_flac_round_trip(spark):
    docs = X.awkward(spark)
    rows = flac.encode(docs.select("doc_id", flac.padded(F.col("text")).alias("raw")), "raw")
    back = flac.decode(rows, "media").collect()
    assert all(len(r.seek) == -(-len(r.raw) // flac.BLOCK) for r in back)
    assert all(bytes(r.raw) == bytes(r.payload) and len(r.raw) % 64 == 0 and r.raw for r in back) and len(back) == docs.count()
    assert all(bytes(r.media[:4]) == b"fLaC" for r in back)
    r = np.random.default_rng(1)
    payloads = [b"", b"\0", bytes(64), r.integers(0, 256, 5000, dtype=np.uint8).tobytes(), bytes(range(256)) * 20, b"ab" * 3000]
    streams = flac.encode_many(payloads)
    assert flac.decode_many(streams)[0] == payloads
    hurt = bytearray(streams[3])
    hurt[-40] ^= 1
    with pytest.raises(ValueError):
        flac.decode_many([bytes(hurt)])
    blocks = flac.blocks(rows.where("doc_id = 9004").select("doc_id", "media"), "doc_id", "media").orderBy("block").collect()
    whole = b"".join(bytes(b.pcm) for b in blocks)
    assert [b.first_sample for b in blocks] == [i * flac.BLOCK for i in range(len(blocks))]
    assert (np.frombuffer(whole, np.uint8) + np.uint8(128)).tobytes() == bytes(next(x.raw for x in back if x.doc_id == 9004))


class Writer:
    """Bits of a FLAC stream, written one field at a time."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> (width - 1 - i) & 1 for i in range(width)]
        return self

    def rice(self, x, k):
        z = 2 * x if x >= 0 else -2 * x - 1
        self.bits += [0] * (z >> k) + [1]
        return self.put(z & ((1 << k) - 1), k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(self.bits).tobytes()


def bitwise_crc(data, poly, width):
    c = 0
    for byte in data:
        c ^= byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return c


def foreign_stream(channels, bits, frames, seektable=b""):
    """Frames are (assignment, number, size, [function that writes a subframe]); the samples are given."""
    info = bytes.fromhex("00100010000000000000") + ((8000 << 44) | (channels - 1) << 41 | (bits - 1) << 36 | sum(f[2] for f in frames)).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info
    for assigned, number, size, write in frames:
        head = b"\xff\xf8" + bytes([0x70 | 4, assigned << 4]) + bytes([number]) + (size - 1).to_bytes(2, "big")
        head += bytes([bitwise_crc(head, 7, 8)])
        w = Writer()
        for f in write:
            f(w)
        frame = head + w.bytes()
        out += frame + bitwise_crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def test_flac_reads_streams_of_other_encoders():
    r = np.random.default_rng(3)
    x = np.cumsum(r.integers(-40, 40, 16))  # 16 samples, 16 bits
    y = x + r.integers(-5, 6, 16)

    def signed(w, v, n):
        w.put(int(v) & ((1 << n) - 1), n)

    def lpc(v, order, coef, shift, n, partitions, method=0, escape=False, wasted=0):
        """A linear predictor's subframe with its residual."""

        def write(w):
            w.put(0, 1).put(31 + order, 6).put(int(wasted > 0), 1)
            if wasted:
                w.put(1, wasted)
            u, width = [int(a) >> wasted for a in v], n - wasted
            for a in u[:order]:
                signed(w, a, width)
            w.put(14, 4).put(shift, 5)
            for c in coef:
                signed(w, c, 15)
            res = [u[i] - (sum(c * u[i - 1 - j] for j, c in enumerate(coef)) >> shift) for i in range(order, len(u))]
            w.put(method, 2).put(partitions, 4)
            per = len(u) >> partitions
            for q in range(1 << partitions):
                own = res[max(0, q * per - order) : (q + 1) * per - order]
                if escape and q % 2 == 0:
                    w.put((1 << (4 + method)) - 1, 4 + method).put(20, 5)
                    for e in own:
                        signed(w, e, 20)
                else:
                    w.put(3, 4 + method)
                    for e in own:
                        w.rice(e, 3)

        return write

    def fixed(v, order, n):
        def write(w):
            w.put(0, 1).put(8 + order, 6).put(0, 1)
            for a in v[:order]:
                signed(w, a, n)
            w.put(0, 2).put(0, 4).put(2, 4)
            for e in np.diff(v, order):
                w.rice(int(e), 2)

        return write

    def plain(v, n):
        return lambda w: [w.put(2, 8), *(signed(w, a, n) for a in v)]

    def constant(a, n):
        return lambda w: (w.put(0, 8), signed(w, a, n))

    cases = [
        (1, [(0, 0, 16, [lpc(x, 8, [3000, -700, 30, 5, -9, 2, 1, 1], 12, 16, 0)])], [x]),
        (1, [(0, 0, 16, [lpc(x, 2, [3, -1], 1, 16, 2, method=1, escape=True)]), (0, 1, 16, [fixed(y, 4, 16)])], [np.concatenate([x, y])]),
        (1, [(0, 0, 16, [lpc(x * 4, 3, [3, -3, 1], 0, 16, 1, wasted=2)])], [x * 4]),
        (2, [(1, 0, 16, [plain(x, 16), fixed(y, 3, 16)])], [x, y]),
        (2, [(8, 0, 16, [fixed(x, 1, 16), fixed(x - y, 2, 17)])], [x, y]),
        (2, [(9, 0, 16, [fixed(x - y, 0, 17), fixed(y, 2, 16)])], [x, y]),
        (2, [(10, 0, 16, [fixed((x + y) >> 1, 2, 16), fixed(x - y, 0, 17)]), (1, 1, 16, [constant(-7, 16), constant(9, 16)])], [np.concatenate([x, [-7] * 16]), np.concatenate([y, [9] * 16])]),
    ]
    for channels, frames, want in cases:
        s = foreign_stream(channels, 16, frames)
        [(pcm, info, where)] = flac.decode_pcm([s])
        assert info["bits"] == 16 and pcm.T.tolist() == [list(map(int, w)) for w in want] and len(where) == len(frames)
        hurt = bytearray(s)
        hurt[-3] ^= 4
        with pytest.raises(ValueError):
            flac.decode_pcm([bytes(hurt)])


def test_flac_seeks():
    r = np.random.default_rng(4)
    data = r.integers(90, 122, 40_000, dtype=np.uint8)
    [stream] = flac.encode_many([data.tobytes()])
    for first, count in ((0, 5), (1023, 2), (9000, 3000), (39_990, 100), (50_000, 3)):
        assert (flac.samples_at(stream, first, count)[:, 0] + 128).tolist() == data[first : first + count].tolist()


def test_substring_dedup(spark):
    docs = X.awkward(spark)
    pairs = X.texts(docs)
    want = {(i, t): (n, k) for (i, t), (_, n, k) in zip(pairs, X.dedup_words(pairs), strict=True)}
    got = phrases.removed(docs).select("rk", "n_removed", "kept")
    from tessera.llm.repeats import row_key

    named = docs.select("doc_id", "text", row_key("doc_id", "text").alias("rk")).join(got.dropDuplicates(["rk"]), "rk", "left").collect()
    assert len(named) == len(pairs) and sum(r.n_removed or 0 for r in named) > 0
    for r in named:
        n, kept = want[r.doc_id, r.text]
        assert (r.n_removed or 0) == n and (r.kept is None or r.kept == kept)
    cut = phrases.dedup(docs)
    assert cut.columns == docs.columns and phrases.dedup(docs.limit(0)).count() == 0
    assert cut.select("kept", "rk", "score").distinct().collect() == [("mine", "mine", "mine")]


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)  # 1: all marks with differing contexts go by cells and windows
    monkeypatch.setattr(suffixes, "RUN", 3000)
    line = "a line of over forty bytes that very many texts have in common, "
    docs = X.awkward(spark, [(9300 + i, f"{i * i} " * (i % 7 + 30) + line + f"{i % 9} and {i // 9} " * 40 + line * (i % 5), "en", "s", 1) for i in range(90)])
    docs = docs.where("doc_id IS NULL OR doc_id <> 9004")
    pairs = X.texts(docs)
    raw = [(t or "").encode() for _, t in pairs]
    want = {}
    for (i, t), x, c in zip(pairs, raw, X.covered(raw, 200), strict=True):
        spans = len(re.findall(b"\1+", bytes(c)))
        want[i, t] = (sum(c), spans, bytes(b for b, y in zip(x, c, strict=True) if not y))
    from tessera.llm.repeats import row_key

    named = docs.select("doc_id", "text", row_key("doc_id", "text").alias("rk")).join(suffixes.removed(docs).dropDuplicates(["rk"]), "rk", "left").collect()
    assert sum(r.n_removed or 0 for r in named) > 0 and len(named) == len(pairs)
    for r in named:
        n, spans, kept = want[r.doc_id, r.text]
        assert (r.n_removed or 0, len(r.spans or [])) == (n, spans) and (r.kept is None or bytes(r.kept) == kept)
    assert suffixes.removed(docs.limit(0)).count() == 0


def _entries(r, n, width):
    """Entries in order, of distinct suffixes over two letters."""
    return [(x.tobytes(), b"", bytes(16), i, 0, 0, 1) for i, x in enumerate(np.unique(r.integers(97, 99, (n, width), dtype=np.uint8), axis=0))]


def test_loser_tree_merges_in_order():
    r = np.random.default_rng(5)
    rows = [sorted(_entries(r, n, 12) + _entries(r, n, 9)) for n in (1, 50, 300, 7)]
    out = list(suffixes.merge([suffixes.Run(suffixes.pack(x)) for x in rows]))
    texts = [e[0] for e, _ in out]
    assert texts == sorted(e[0] for x in rows for e in x)
    for (a, _), (b, common) in zip(out, out[1:], strict=False):
        assert common == suffixes.lcp(a[0], b[0], 0)
    whole = list(suffixes.joined(iter(out)))
    assert [e[0] for e, _, twin in whole if twin is None] == sorted(set(texts)) and len(whole) == len(out)


def test_runs_are_merged_in_levels(spark):
    r = np.random.default_rng(6)
    blobs = [(0, 40, False, suffixes.pack([(b"x" * 39 + b"%04d" % j + b"y" * 157, b"z" * 10, bytes([i]) * 16, 10, 0, 10, 1) for j in sorted(r.choice(400, 9, replace=False))])) for i in range(40)]
    runs = spark.createDataFrame(blobs, suffixes.BLOBS)
    got = [sorted(map(tuple, suffixes.recurring_windows(runs, 200, fan).collect())) for fan in (256, 4)]
    assert got[0] == got[1] and got[0]


def test_hmm_base_score_and_counts(spark):
    docs = X.awkward(spark)
    got = hmm.score(docs.withColumn("own", F.col("text")), language.bucket("doc_id", 10) != 0, keep=("doc_id", "own")).collect()
    tok = lambda t: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(), b""]
    pairs = X.texts(docs)
    c = collections.Counter(w for i, t in pairs if X.crc(i, 10) for w in tok(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        w = tok(r.own)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    held = [r for r in got if X.crc(r.doc_id, 10) == 0 and r.n_tokens > 50]
    assert np.mean([(r.score - r.base_score) / r.n_tokens for r in held]) > 0


def test_hmm_likelihood_is_exact():
    r = np.random.default_rng(2)
    p = hmm.Params(r.dirichlet(np.ones(hmm.STATES)), r.dirichlet(np.ones(hmm.STATES), hmm.STATES), r.dirichlet(np.ones(9), hmm.STATES).T)
    seqs = [r.integers(0, 9, n) for n in (1, 2, 255, 1023, 1024, 1025, 4000)]
    got = hmm.log10_likelihood(np.concatenate(seqs), np.cumsum([0, *map(len, seqs)]), p)
    for s, g in zip(seqs, got, strict=True):
        a, log = p.start * p.emit[s[0]], 0.0
        for x in s[1:]:
            log += math.log10(a.sum())
            a = (a / a.sum()) @ p.move * p.emit[x]
        assert abs(g - log - math.log10(a.sum())) < 1e-8 * len(s) + 1e-9
    total = hmm.log10_likelihood(np.arange(9), np.arange(10), p)  # all texts of one token
    assert abs(sum(10**x for x in total) - 1) < 1e-9


def test_hmm_expected_counts_are_those_of_whole_texts():
    r = np.random.default_rng(8)
    p = hmm.Params(r.dirichlet(np.ones(hmm.STATES)), r.dirichlet(np.ones(hmm.STATES), hmm.STATES), r.dirichlet(np.ones(9), hmm.STATES).T)
    seqs = [r.integers(0, 9, n) for n in (1, 5, 1024, 1025, 3333)]
    start, move, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((9, hmm.STATES))
    for s in seqs:
        alpha, beta = np.zeros((len(s), hmm.STATES)), np.ones((len(s), hmm.STATES))
        alpha[0] = p.start * p.emit[s[0]]
        alpha[0] /= alpha[0].sum()
        for t in range(1, len(s)):
            alpha[t] = alpha[t - 1] @ p.move * p.emit[s[t]]
            alpha[t] /= alpha[t].sum()
        for t in range(len(s) - 2, -1, -1):
            beta[t] = p.move @ (p.emit[s[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
            both = alpha[t][:, None] * p.move * (p.emit[s[t + 1]] * beta[t + 1])[None, :]
            move += both / both.sum()
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        start += gamma[0]
        np.add.at(emit, s, gamma)
    got = hmm.expected_counts(np.concatenate(seqs), np.cumsum([0, *map(len, seqs)]), p)
    assert np.allclose(got, np.concatenate([start, move.ravel(), emit.ravel()]), rtol=2e-3, atol=2e-2)


def hmm_of_50(r):
    return hmm.Params(r.dirichlet(np.ones(hmm.STATES)), r.dirichlet(np.ones(hmm.STATES), hmm.STATES), r.dirichlet(np.ones(50), hmm.STATES).T)


def test_hmm_scores_of_equal_texts_are_equal_to_the_bit():
    r = np.random.default_rng(1)
    p = hmm_of_50(r)
    for n in (1, 3, 17, 256, 257, 600, 1500) * 12:
        s, others = r.integers(0, 50, n), [r.integers(0, 50, int(r.integers(1, 700))) for _ in range(int(r.integers(0, 40)))]
        seqs = [*others[:7], s, *others[7:], s]
        got = hmm.log10_likelihood(np.concatenate(seqs), np.cumsum([0, *map(len, seqs)]), p)
        assert got[min(7, len(others))] == got[-1] == hmm.log10_likelihood(s, np.array([0, n]), p)[0]


def test_hmm_batches_are_worked_on_together(monkeypatch):
    r = np.random.default_rng(4)
    seqs = [r.integers(0, 16_064, int(n)).astype("<i2") for n in r.integers(1, 60, 200)]
    columns = [pa.array([s.tobytes() for s in seqs[i : i + 5]], pa.binary()) for i in range(0, 200, 5)] + [pa.array([], pa.binary())]
    off = np.cumsum([0, *map(len, seqs)])
    ((flat, got),) = hmm._class_steps(columns)
    assert (flat == np.concatenate(seqs)).all() and (got == off).all()
    for most in (1, 50, 1000):
        monkeypatch.setattr(hmm, "STEP_TOKENS", most)
        steps = list(hmm._class_steps(columns))
        assert (np.concatenate([f for f, _ in steps]) == flat).all() and sum(len(o) - 1 for _, o in steps) == 200
        assert all(len(f) <= most or len(o) == 2 for f, o in steps)
    assert list(hmm._class_steps(columns[-1:])) == []


def test_hmm_makes_matrices_only_of_later_stretches(monkeypatch):
    r = np.random.default_rng(6)
    p = hmm_of_50(r)
    made, inner = collections.Counter(), hmm._carried

    def counted(flat, begin, size, first, p):
        made[first.shape[1]] += len(size)
        return inner(flat, begin, size, first, p)

    monkeypatch.setattr(hmm, "_carried", counted)
    n = np.array([1, 30, hmm.STRETCH, hmm.STRETCH + 1, 5 * hmm.STRETCH])
    flat, off = r.integers(0, 50, n.sum()), np.concatenate([[0], np.cumsum(n)])
    hmm.log10_likelihood(flat, off, p)
    assert made == {1: 5, hmm.STATES: 5}
    made.clear()
    hmm.expected_counts(flat, off, p)
    assert made == {1: 2, hmm.STATES: 5}


def test_bpe_is_tiktoken(spark):
    import public_tokenizers as P

    docs = X.awkward(spark, [(9200, "a" * 3000 + "é" * 500, "en", "s", 1), (9201, "<|endoftext|> 12345678 it's\r\n\r\n", "en", "s", 1)])
    enc = X.tiktoken_encoding()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert len(out) == docs.count()
    for r in out:
        assert list(r.token_ids) == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
