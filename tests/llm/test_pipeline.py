"""Every stage of the pipeline against a brute-force version of it, on its own input."""

import corpus_pipeline
from tessera.llm import queries
from tests.llm import fixtures as X


def test_stages(spark):
    docs = spark.read.parquet(f"{X.SF}/documents.parquet")
    columns = docs.columns
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{X.SF}/benchmark.parquet").select("item_id", "text").collect()]
    enc = X.tiktoken_encoding()
    for name, stage in corpus_pipeline.STAGES:
        pairs = X.texts(docs)
        out = stage(spark, docs, X.SF).cache()
        got = X.texts(out)
        if name != "byte_bpe":
            assert out.columns == columns
        if name == "quality":
            assert 0 < len(got) < len(pairs) and set(got) <= set(pairs)
        elif name == "near_duplicates":
            assert sorted(i for i, _ in got) == sorted({c for _, c, _ in X.near_classes(pairs)})
        elif name == "substring_dedup":
            want = {i: (k if n else t) for (i, t), (_, n, k) in zip(pairs, X.dedup_words(pairs), strict=True)}
            assert dict(got) == want
        elif name == "decontamination":
            bad = {p[0] for p, w in zip(pairs, X.contamination(pairs, items), strict=True) if w[4]}
            assert {i for i, _ in got} == {i for i, _ in pairs} - bad
        else:
            assert [(r.doc_id, list(r.token_ids)) for r in out.orderBy("doc_id").collect()] == [(i, enc.encode_ordinary(t or "")) for i, t in sorted(pairs)]
        docs = out


def test_registered():
    assert sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])) == [n for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])) if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
