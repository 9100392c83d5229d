"""Which texts contain which passages, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import once

#: Words of the key by which a passage and a text meet.
GRAM = 5


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` words separated by single spaces of a line, as they stand."""
    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " ")))

    return once(F.split(text, r"\s+"), grams)


def containing(texts: DataFrame, key: str, text: str, passages: DataFrame, item: str, passage: str, *, n: int = GRAM) -> DataFrame:
    """(key, item) where the text contains the passage. A passage of more than n + 1 words is looked up by the
    hash of n words inside it (not its first or last, which may stand inside other words): only keys and hashes
    are exploded, and texts are joined back to the candidates. Shorter passages share no key and go by a nested loop."""
    words = F.split(F.col(passage), r"\s+")
    p = passages.where(F.col(passage).isNotNull()).select(F.col(item), F.col(passage).alias("__p"), F.size(words).alias("__n"), F.xxhash64(F.array_join(F.slice(words, 2, n), " ")).alias("__g"))
    t = texts.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__t"))
    long_ = p.where(F.col("__n") >= n + 2)
    grams = t.select(key, F.explode(F.array_distinct(_grams(F.col("__t"), n))).alias("__g"))
    near = grams.join(long_.select(item, "__g"), "__g").select(key, item).distinct()
    found = near.join(t, key).join(long_, item).where(F.contains("__t", "__p")).select(key, item)
    short = p.where(F.col("__n") < n + 2)
    if short.limit(1).isEmpty():
        return found
    return found.unionByName(t.join(short, F.contains("__t", "__p")).select(key, item))
