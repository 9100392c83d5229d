"""A training corpus from ``documents``: quality, near duplicates, repeated passages, benchmark
passages, tokens. Each stage's table is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, jaccard, phrases, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (5)."""
    return quality.accepted(docs, quality.learned(spark, sf_dir, docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id (4)."""
    return jaccard.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; ``n_chars`` follows the text (7)."""
    return phrases.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark (1)."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again; a text that doesn't come back fails the job (9)."""
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    out = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    n = F.when(same, F.size("token_ids").cast("long")).otherwise(F.raise_error(F.lit("decoded text differs")).cast("long"))
    return out.withColumn("n_tokens", n).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

#: No stage but decontamination is expressible in SQL; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
