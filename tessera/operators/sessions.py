"""Conversations: turns, steps, retention, idle and threshold commits.

Running sums over a session are two-level: sums of chunks first, then inside each chunk, so one
very long session is never a single task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def running(df: DataFrame, key: str, order: str, values: dict[str, Column], *, reverse: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``df`` with running sums in the order of an integer column, dealt out by stretches of it."""
    df = df.withColumns({f"__{n}": c for n, c in values.items()}).withColumn("__chunk", F.floor(F.col(order) / chunk))
    sums = df.groupBy(key, "__chunk").agg(*[F.sum(f"__{n}").alias(f"__s_{n}") for n in values])
    by = (F.desc if reverse else F.asc)("__chunk")
    before = Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, "__chunk", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values])
    w = Window.partitionBy(key, "__chunk").orderBy((F.desc if reverse else F.asc)(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({n: F.sum(f"__{n}").over(w) for n in values}).join(base, [key, "__chunk"])
    return out.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in values}).drop("__chunk", *[f"__{n}" for n in values], *[f"__b_{n}" for n in values])


def turns(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """``turn_id``: a user's message opens one; what comes before is turn 0. ``step_id``: an assistant's
    message opens a step of its turn, tool results belong to the last."""
    user, assistant = (F.col("role") == "user").cast("long"), (F.col("role") == "assistant").cast("long")
    out = running(messages, session, order, {"turn_id": user, "__steps": assistant})
    first = out.groupBy(session, "turn_id").agg(F.min(F.struct(order, (F.col("__steps") - assistant).alias("n"))).getField("n").alias("__first"))
    return out.join(first, [session, "turn_id"]).withColumn("step_id", F.col("__steps") - F.col("__first")).drop("__steps", "__first")


def retention(messages: DataFrame, tokens: Column, *, keep_turns: int, budget: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, turn_id, tokens, tail, kept): the newest turns, while their tokens fit the budget; the
    newest turn itself always stays."""
    per = turns(messages.withColumn("__t", tokens), session, order).groupBy(session, "turn_id").agg(F.sum("__t").alias("tokens"))
    out = running(per, session, "turn_id", {"tail": F.col("tokens"), "age": F.lit(1)}, reverse=True)
    kept = (F.col("age") == 1) | (F.col("age") <= keep_turns) & (F.col("tail") <= budget)
    return out.select(session, "turn_id", "tokens", "tail", kept.alias("kept"))


def newest_turn_tail(messages: DataFrame, tokens: Column, *, budget: int, min_tail: int = 1, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Of each session's newest turn: the opening message, and the last steps that fit the budget less a
    reserve (1024 tokens or a quarter), ``min_tail`` steps at least."""
    rows = turns(messages.withColumn("__t", tokens), session, order)
    last = rows.groupBy(session).agg(F.max("turn_id").alias("turn_id"))
    own = rows.join(last, [session, "turn_id"])
    steps = own.groupBy(session, "turn_id", "step_id").agg(F.sum("__t").alias("tokens"))
    steps = running(steps, session, "step_id", {"tail": F.col("tokens"), "age": F.lit(1)}, reverse=True)
    room = budget - min(1024, budget // 4)
    kept = (F.col("step_id") == 0) | (F.col("age") <= min_tail) | (F.col("tail") <= room)
    return steps.select(session, "turn_id", "step_id", "tokens", kept.alias("kept"))


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str = "1 day") -> DataFrame:
    """A commit for every stretch of a key's events with no pause of ``gap``."""
    w = F.session_window(F.col(ts), gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def threshold_commits(messages: DataFrame, tokens: Column, *, most_tokens: int, most_messages: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, commits, pending, pending_tokens): a commit each time either sum reaches its limit, which
    then starts again. The fold needs a session's order, so its token counts (not its texts) are gathered."""
    per = messages.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order), tokens.cast("long").alias("t")))).alias("m"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("commits"), zero.alias("pending"), zero.alias("pending_tokens"))

    def step(a: Column, m: Column) -> Column:
        n, t = a["pending"] + 1, a["pending_tokens"] + m["t"]
        full = (t >= most_tokens) | (n >= most_messages)
        return F.struct((a["commits"] + full.cast("long")).alias("commits"), F.when(full, zero).otherwise(n).alias("pending"), F.when(full, zero).otherwise(t).alias("pending_tokens"))

    return per.withColumn("r", F.aggregate("m", start, step)).select(session, "r.*")


def accepted(events: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """(key, n_accepted, n_dropped): an event within ``seconds`` of its key's last accepted one is dropped."""
    per = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order)))).alias("m"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, m: Column) -> Column:
        ok = a["last"].isNull() | (m["t"] - a["last"] >= seconds * 1_000_000)
        return F.struct(F.when(ok, m["t"]).otherwise(a["last"]).alias("last"), (a["n"] + ok.cast("long")).alias("n"))

    n = F.aggregate("m", start, step)["n"]
    return per.select(key, n.alias("n_accepted"), (F.size("m") - n).alias("n_dropped"))


def micro_batches(items: DataFrame, key: str, ts: str, order: str, *, most: int = 8, seconds: int = 10) -> DataFrame:
    """(key, order, batch): a batch is closed when it has ``most`` items, or when one comes ``seconds`` or more
    after its first. An ordered fold over a key's times and numbers."""
    item = F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o"))
    per = items.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("m"))
    kind = items.schema[order].dataType.simpleString()
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("batch"), zero.alias("n"), zero.alias("first"), F.from_json(F.lit("[]"), f"array<struct<o:{kind},batch:bigint>>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        new = (a["n"] >= most) | ((a["n"] > 0) & (m["t"] - a["first"] >= seconds * 1_000_000))
        batch = a["batch"] + new.cast("long")
        opens = new | (a["n"] == 0)
        return F.struct(batch.alias("batch"), F.when(opens, 1).otherwise(a["n"] + 1).cast("long").alias("n"), F.when(opens, m["t"]).otherwise(a["first"]).alias("first"), F.array_append(a["out"], F.struct(m["o"].alias("o"), batch.alias("batch"))).alias("out"))

    got = per.select(key, F.explode(F.aggregate("m", start, step, lambda a: a["out"])).alias("x"))
    return got.select(key, F.col("x.o").alias(order), F.col("x.batch").alias("batch"))
