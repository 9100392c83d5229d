"""The registered queries, whole, on a small folder of tables with awkward rows; own columns that stay as they were."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, decontaminate, flac, hmm, jaccard, language, phrases, quality, queries
from tests.llm import fixtures as X

BASE = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    bench = spark.read.parquet(f"{X.SF}/benchmark.parquet").unionByName(spark.createDataFrame([(None, "an item without an id has thirteen words just so that it is whole"), (702, None)], "item_id bigint, text string"))
    whole = "so an item without an id has thirteen words just so that it is whole"
    docs = X.awkward(spark, [(9401, whole, "en", "s", 1), (5, "the fifth text once more, but another one", "en", "s", 1)]).select(BASE)
    docs.where("doc_id IS NULL OR doc_id < 120 OR doc_id > 9000").where("doc_id IS NULL OR doc_id <> 9004").coalesce(3).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{X.SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def rows(spark, folder, name, *columns):
    return sorted(map(repr, (tuple(r) for r in queries.queries()[name](spark, folder).select(*columns).collect())))


def texts(spark, folder):
    return X.texts(spark.read.parquet(f"{folder}/documents.parquet"))


def test_op1(spark, folder):
    pairs = texts(spark, folder)
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = []
    for (i, _), (n, hit, _, _, bad) in zip(pairs, X.contamination(pairs, items), strict=True):
        want.append((i, n, hit, bad))
    assert rows(spark, folder, "op1_benchmark_decontamination", "doc_id", "n_words", "n_hit", "contaminated") == sorted(map(repr, want))
    known = [x for x in items if x[0] is not None]
    listed = [(i, n, sha) for (i, _), (_, _, n, sha, _) in zip(pairs, X.contamination(pairs, known), strict=True)]
    assert rows(spark, folder, "op1_benchmark_decontamination", "doc_id", "n_items", "items_sha256") == sorted(map(repr, listed))
    assert next(w for w in want if w[0] == 9401)[2:] == (14, True)


def test_op2(spark, folder):
    got = queries.queries()["op2_language_id"](spark, folder).collect()
    assert all(r.held_out == (X.crc(r.doc_id, 4) == 2) for r in got) and len(got) == len(texts(spark, folder))


def test_op4(spark, folder):
    assert rows(spark, folder, "op4_ngram_jaccard_join", "doc_id", "class_id", "n_links") == sorted(map(repr, X.near_classes(texts(spark, folder))))


def test_op5(spark, folder):
    got = queries.queries()["op5_quality_classifier"](spark, folder).collect()
    assert all(r.held_out == (X.crc(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) for r in got)


def test_op6(spark, folder):
    got = {r.doc_id: r for r in queries.queries()["op6_flac_media"](spark, folder).collect()}
    for i, t in texts(spark, folder):
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        if i == 5:  # two texts have this id
            continue
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), X.sha(full), zlib.crc32(full[-64:]))
        [media] = flac.encode_many([full])
        assert (r.media_bytes, r.media_sha256, r.n_blocks) == (len(media), X.sha(media), -(-len(full) // flac.BLOCK))


def test_op7(spark, folder):
    pairs = texts(spark, folder)
    want = [(i, n, gone, X.sha(kept)) for (i, _), (n, gone, kept) in zip(pairs, X.dedup_words(pairs), strict=True)]
    assert rows(spark, folder, "op7_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(repr, want))


def test_op8(spark, folder):
    got = queries.queries()["op8_hmm_lm_scoring"](spark, folder)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same = {}
    for r in got.collect():
        assert r.held_out == (X.crc(r.doc_id, 10) == 0) and r.score < 0
    by_text = dict(texts(spark, folder))
    for r in got.collect():
        if r.doc_id != 5:
            same.setdefault(by_text[r.doc_id] or "", set()).add((r.base_score, r.score))
    assert all(len(v) == 1 for v in same.values())


def test_op9(spark, folder):
    enc = X.tiktoken_encoding()
    want = []
    for i, t in texts(spark, folder):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), X.sha(",".join(map(str, ids))), X.sha(t or "")))
    assert rows(spark, folder, "op9_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(map(repr, want))


def test_op10(spark, folder):
    import re

    pairs = texts(spark, folder)
    raw = [(t or "").encode() for _, t in pairs]
    want = []
    for (i, _), x, c in zip(pairs, raw, X.covered(raw, 200), strict=True):
        want.append((i, len(x), sum(c), len(re.findall(b"\1+", bytes(c))), X.sha(bytes(b for b, y in zip(x, c, strict=True) if not y))))
    assert rows(spark, folder, "op10_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(map(repr, want))


def test_pipeline_runs_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert [c for c in out.columns if c != "token_ids" and c != "n_tokens"] == docs.columns and 0 < out.count() <= docs.count()


def test_own_columns_keep_their_values(spark):
    docs = X.awkward(spark).where("doc_id < 60 OR doc_id > 9000").where("doc_id <> 9004")
    bench = spark.read.parquet(f"{X.SF}/benchmark.parquet")
    own = [c for c in docs.columns if c not in BASE]
    model = quality.Model(0.75)
    for out in (decontaminate.drop_contaminated(docs, bench), decontaminate.cut_hits(docs, bench), phrases.dedup(docs), jaccard.keep_one(docs), quality.accepted(docs, model)):
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r) for r in out.select(own).collect()} == {tuple(r) for r in docs.select(own).distinct().collect()}
    kept = [c for c in own if c not in ("score", "predicted")]
    scored = language.predict(quality.score(docs, model), None)
    assert {tuple(r) for r in scored.select(kept).collect()} == {tuple(r) for r in docs.select(kept).distinct().collect()}


def test_one_id_on_two_texts_loses_none(spark):
    a, b, c = ("all work and no play " + w * 20 for w in ("makes jack a dull boy ", "is what they say now ", "nothing of the kind it "))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (7, c), (None, c)], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.keep_one(df.where("doc_id IS NOT NULL")).collect())) == [(1, a), (5, b), (7, c)]
    assert jaccard.keep_one(df).count() == 4  # a row without an id stays
    shuffled = jaccard.keep_one(spark.createDataFrame([(5, ""), (5, None), (5, "x"), (5, "y")], "doc_id bigint, text string"))
    assert sorted("-" if r.text is None else r.text for r in shuffled.collect()) == ["", "-", "x", "y"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert language.predict(docs, language.train(docs)).count() == 0
    assert quality.score(docs, quality.Model()).count() == 0
    assert flac.decode(flac.encode(docs.select(flac.padded(F.col("text")).alias("p")), "p"), "media").count() == 0
    assert hmm.score(docs, F.lit(True)).count() == 0
    import public_tokenizers as P

    assert bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert hmm.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"), F.lit(False)).count() == 2


def test_very_long_texts_are_as_their_stretches(monkeypatch):
    r = np.random.default_rng(9)
    raw = r.integers(97, 122, 40_000, dtype=np.uint8)
    raw[r.integers(0, 40_000, 8000)] = 32
    off = np.array([0, 100, 100, 40_000])
    assert np.allclose(language.vectors(raw, off), language.vectors(raw, off, 1 << 10), atol=1e-6)
    model = quality.Model()
    model.fit([r.normal(0, 1, (3, quality.DIM)).astype(np.float32) for _ in range(8)], np.arange(8) % 2, np.ones(8), rounds=1)
    whole = model.score(raw, off)
    x, count = quality.encode(raw, off)
    assert np.allclose(whole, model.forward(x, count)["y"], atol=1e-5)
    monkeypatch.setattr(quality, "STRETCH", 1 << 10)
    assert np.allclose(whole, model.score(raw, off), atol=1e-5)
    from tessera.llm import common

    s, e, _ = common.words(raw, off, common.SPACE)
    once = common.word_hashes(raw, s, e)
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    assert (once == common.word_hashes(raw, s, e)).all()


def test_attention_gradient(monkeypatch):
    """Steps of the fit lower the loss that the model states."""
    r = np.random.default_rng(2)
    bags = [r.normal(0, 1, (n, quality.DIM)).astype(np.float32) for n in (1, 3, 5, 2, 4, 1, 6, 2)]
    y = np.array([0, 1, 0, 1, 0, 1, 0, 1])
    for b, v in zip(bags, y, strict=True):
        b[0, :5] += 4 * v
    model = quality.Model()
    model.fit(bags, y, np.ones(8))
    got = np.array([model.forward(b, np.array([len(b)]))["y"][0] for b in bags])
    assert ((got > 0.5) == (y == 1)).all() and hashlib.md5(model.p[0].tobytes()).hexdigest()
    weights = model.forward(bags[1], np.array([3]))["a"]
    assert abs(weights.sum() - 1) < 1e-5


def test_many_languages():
    r = np.random.default_rng(4)
    langs = [f"l{i:03d}" for i in range(250) for _ in range(6)]
    x = np.repeat(r.normal(0, 1, (250, language.DIM)), 6, axis=0) + r.normal(0, 0.3, (1500, language.DIM))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    model = language.Model(x, langs)
    got, score = model.predict(x)
    assert got == langs and len(model.families) == 250 and (score > 0).all()


def test_recall_of_pairs_just_over_the_threshold(spark):
    """Many pairs whose similarity is between 0.8 and 0.85: brute force finds no more than the join."""
    r = np.random.default_rng(12)
    pairs = []
    for i in range(600):
        w = [f"w{x}" for x in r.integers(0, 50_000, 104)]
        v = list(w)
        for k in (r.integers(5, 95), r.integers(5, 95)):  # two words changed: ten of a hundred shingles
            v[k] = f"v{i}x{k}"
        pairs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = jaccard.join(spark.createDataFrame(pairs, "doc_id bigint, text string")).collect()
    want = {i: n for i, _, n in X.near_classes(pairs)}
    assert sum(want.values()) > 800
    assert sum(r.n_links for r in got) >= 0.999 * sum(want.values()) and all(r.n_links <= want[r.doc_id] for r in got)
