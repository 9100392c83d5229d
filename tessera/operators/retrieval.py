"""Retrieval over a tree of directories: dense scores, propagation, hotness, penalties, rerank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.assembly import overfetch
from tessera.operators.changes import best
from tessera.sources.store import stored

HALF_LIFE_DAYS = 7.0


def hotness(count: Column, age_days: Column) -> Column:
    """Use and recency, in 0..1; a missing time gives 0."""
    return F.when(age_days.isNull(), 0.0).otherwise(1 / (1 + F.exp(-F.log1p(count.cast("double")))) * F.exp(-F.log(F.lit(2.0)) / HALF_LIFE_DAYS * F.greatest(age_days, F.lit(0.0))))


def blended(semantic: Column, hot: Column, alpha: float = 0.0) -> Column:
    return semantic * (1 - alpha) + hot * alpha


def propagated(score: Column, parent: Column, alpha: float = 1.0) -> Column:
    """The parent's score takes a share of 1 - alpha, unless it is 0."""
    return F.when(F.coalesce(parent, F.lit(0.0)) != 0, score * alpha + parent * (1 - alpha)).otherwise(score)


def penalised(score: Column, origin: Column, category: Column, penalty: dict[str, float]) -> Column:
    """A penalty by category for what comes from other peers."""
    p = F.lit(0.0)
    for c, x in penalty.items():
        p = F.when(category == c, x).otherwise(p)
    return score - F.when(origin == "other_peer", p).otherwise(0.0)


def quick(scored: DataFrame, *, uri: str, score: str, limit: int, threshold: float = 0.0, gte: bool = False, key: str) -> DataFrame:
    """Hits over the threshold, the best of each uri, in the order of their scores."""
    s = F.col(score)
    hits = scored.where(s >= threshold if gte else s > threshold)
    return best(hits, uri, score, key).orderBy(F.desc(score), key).limit(limit)


def without(scored: DataFrame, left_out: DataFrame, *, key: str, score: str, want: int) -> DataFrame:
    """The best ``want`` hits that aren't left out, of a page that is larger by as many as may drop out, but
    three times as large at most."""
    fetch = overfetch(want, left_out.limit(2 * want).count())
    page = scored.orderBy(F.desc(score), key).limit(fetch)
    return page.join(left_out, key, "left_anti").orderBy(F.desc(score), key).limit(want)


def expand_all(nodes: DataFrame, roots: DataFrame, *, alpha: float = 0.5, most_levels: int = 50) -> DataFrame:
    """(uri, level, final): every node under the roots with its propagated score, level by level.

    ``nodes``: uri, parent_uri, score; ``roots``: uri, final. A round is one join for a whole level, whose
    result is written, so the plan doesn't grow with the depth."""
    front = stored(roots.select("uri", F.lit(0).alias("level"), F.col("final").cast("double")), "level")
    out = front
    for n in range(1, most_levels + 1):
        up = front.select(F.col("uri").alias("parent_uri"), F.col("final").alias("up"))
        front = stored(nodes.join(up, "parent_uri").select("uri", F.lit(n).alias("level"), propagated(F.col("score"), F.col("up"), alpha).alias("final")), "level")
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError(f"the tree is deeper than {most_levels}: is there a cycle?")


def best_first(nodes: DataFrame, roots: DataFrame, *, limit: int, alpha: float = 0.5, width: int = 4, patience: int = 3) -> DataFrame:
    """Directories are opened by score, ``width`` a round; of each the best max(2 * limit, 20) children stay.
    The search ends when the best ``limit`` hits haven't changed for ``patience`` rounds, or nothing is open.

    ``nodes``: uri, parent_uri, is_leaf, score. The frontier, at most ``width`` times that many rows a round, is
    all that reaches the driver; scores come from one Spark query a round."""
    take = max(2 * limit, 20)
    open_ = {r["uri"]: float(r["final"]) for r in roots.select("uri", "final").orderBy(F.desc("final")).limit(take).collect()}
    seen, hits, before, still = set(open_), {}, None, 0
    spark = nodes.sparkSession
    while open_ and still < patience:
        some = sorted(open_, key=lambda u: (-open_[u], u))[:width]
        held = F.create_map(*[F.lit(x) for u in some for x in (u, open_.pop(u))])
        w = Window.partitionBy("parent_uri").orderBy(F.desc("final"), "uri")
        kids = nodes.where(F.col("parent_uri").isin(some)).withColumn("final", propagated(F.col("score"), held[F.col("parent_uri")], alpha))
        for r in kids.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= take).collect():
            if r["uri"] in seen:
                continue
            seen.add(r["uri"])
            if r["is_leaf"]:
                hits[r["uri"]] = float(r["final"])
            else:
                open_[r["uri"]] = float(r["final"])
        top = sorted(hits, key=lambda u: (-hits[u], u))[:limit]
        still, before = (still + 1, before) if top == before else (0, top)
    rows = [(u, hits[u]) for u in sorted(hits, key=lambda u: (-hits[u], u))[:limit]]
    return spark.createDataFrame(rows, "uri string, final double")


def overlap(query: list[str], text: Column) -> Column:
    """Share of the query's words that a text has: the reranker where no model is given."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    q = sorted({w.lower() for w in query})
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in q]), words)) / F.lit(float(max(1, len(q))))


def reranked(hits: DataFrame, text: str, score: str, scorer: Callable[[Column], Column]) -> DataFrame:
    """New scores where there is text; blank ones keep theirs. ``scorer``: an expression or a pandas UDF."""
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    return hits.withColumn(score, F.when(blank, F.col(score)).otherwise(F.coalesce(scorer(F.col(text)), F.col(score))))


def display_uri(uri: Column, level: Column) -> Column:
    return F.concat(uri, F.when(level == 0, "/.abstract.md").when(level == 1, "/.overview.md").otherwise(""))
