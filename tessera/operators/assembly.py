"""Context assembly: tiers of a text, budgeted packing, cool-down ledger, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


def overfetch(want: int, excluded: int) -> int:
    """How many candidates to ask for if some will be left out."""
    return want + min(excluded, 2 * want)


def abstract(text: Column) -> Column:
    """The first line with anything in it, of 120 characters at most."""
    return F.substring(F.regexp_extract(text, r"(?m)^\s*(\S.*?)\s*$", 1), 1, 120)


def overview(text: Column) -> Column:
    """The first 24 headings, or else the first paragraph, of 400 characters at most."""
    heads = F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6} .+?)\s*$"), 1), 1, 24)
    paragraph = F.substring(F.element_at(F.split(F.btrim(text, F.lit(" \n\t\r")), r"\n\s*\n"), 1), 1, 400)
    return F.when(F.size(heads) > 0, F.array_join(heads, "\n")).otherwise(paragraph)


def pack(candidates: DataFrame, *, query: str, key: str, score: str, sizes: list[str], budget: int) -> DataFrame:
    """(query, key, tier, tokens) of what fits the budget.

    In score order each candidate gets the largest tier (of ``sizes``, from small to large) within twice its
    fair share and what is left, one token a piece for the separator; what is left over then upgrades pieces,
    again in order. Candidates have been limited by quotas before, so a query's list is short."""
    item = F.struct((-F.col(score)).alias("o"), F.col(key).alias("k"), F.array(*[F.col(s).cast("long") for s in sizes]).alias("s"))
    per = candidates.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("c"))
    share = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.size("c"))) * 2
    per = per.withColumn("cap", share.cast("long"))
    kind = per.schema["c"].dataType.elementType["k"].dataType.simpleString()
    empty = F.from_json(F.lit("[]"), f"array<struct<k:{kind},t:int,n:bigint,s:array<bigint>>>")
    tiers = len(sizes)

    def place(a: Column, c: Column) -> Column:
        t, n = F.lit(-1), F.lit(0).cast("long")
        for i in range(tiers):
            s = c["s"][i]
            fits = (s <= F.col("cap")) & (s + 1 <= a["left"])
            t, n = F.when(fits, i).otherwise(t), F.when(fits, s).otherwise(n)
        piece = F.struct(c["k"].alias("k"), t.alias("t"), n.alias("n"), c["s"].alias("s"))
        return F.struct(F.when(t < 0, a["out"]).otherwise(F.array_append(a["out"], piece)).alias("out"), F.when(t < 0, a["left"]).otherwise(a["left"] - n - 1).alias("left"))

    def upgrade(a: Column, c: Column) -> Column:
        t, n = c["t"], c["n"]
        for i in range(1, tiers):
            s = c["s"][i]
            fits = (i > t) & (s - c["n"] <= a["left"])
            t, n = F.when(fits, i).otherwise(t), F.when(fits, s).otherwise(n)
        piece = F.struct(c["k"].alias("k"), t.alias("t"), n.alias("n"), c["s"].alias("s"))
        return F.struct(F.array_append(a["out"], piece).alias("out"), (a["left"] - (n - c["n"])).alias("left"))

    start = F.struct(empty.alias("out"), F.lit(budget).cast("long").alias("left"))
    per = per.withColumn("a", F.aggregate("c", start, place))
    again = F.struct(empty.alias("out"), F.col("a.left").alias("left"))
    per = per.withColumn("b", F.aggregate("a.out", again, upgrade))
    return per.select(query, F.explode("b.out").alias("p")).select(query, F.col("p.k").alias(key), F.col("p.t").alias("tier"), F.col("p.n").alias("tokens"))


def cooled(candidates: DataFrame, ledger: DataFrame, *, uri: str, turn: str, now: int, turns: int) -> DataFrame:
    """Candidates that weren't served within the last turns; served as a mere address doesn't count."""
    recent = ledger.where((F.col("detail") != "uri") & (F.col(turn) > now - turns)).select(uri)
    return candidates.join(recent, uri, "left_anti")


def pruned(ledger: DataFrame, *, uri: str, turn: str, now: int, turns: int, most: int = 500) -> DataFrame:
    """The ledger's last 4 * turns turns, and of those the ``most`` latest addresses."""
    own = ledger.where(F.col(turn) > now - 4 * turns).groupBy(uri).agg(F.max(turn).alias(turn))
    return own.orderBy(F.desc(turn), uri).limit(most)


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rendered(uri: Column, score: Column, detail: Column, body: Column) -> Column:
    return F.format_string('<memory uri="%s" score="%s" detail="%s">%s</memory>', escaped(uri), F.round(score, 2).cast("string"), detail, escaped(body))


def distinct_bodies(hits: DataFrame, body: Column, score: str, key: str) -> DataFrame:
    """Each injected text once, at its best place."""
    one = hits.groupBy(X.digest(body).alias("__h")).agg(F.min_by(F.struct(*hits.columns), F.struct(-F.col(score), F.col(key))).alias("r"))
    return one.select("r.*")
