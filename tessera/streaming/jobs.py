"""Streaming forms of the batch operators, over file sources with checkpoints.

Each job reads what is there (``availableNow``) or goes on with a processing-time trigger; state and
output live in the shared folder, so a lost executor costs a retry of the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes
from tessera.sources.store import fresh_path

#: How late an event may come.
LATE = "7 days"


def source(spark: SparkSession, path: str, ts: str | None = None, files: int = 8) -> DataFrame:
    """A Parquet path as a stream, ``files`` a batch at most; ``ts`` becomes the event time."""
    schema = spark.read.parquet(path).schema
    # as a pattern, so that one file is as good as a folder of them
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    return s.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATE) if ts else s


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], *, mode: str = "update", every: str | None = None):
    """Start a query that hands each micro-batch to ``each``; without ``every`` it ends when all is read."""
    w = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", fresh_path(stream.sparkSession, "stream"))
    q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
    if not every:
        q.awaitTermination()
    return q


def result(stream: DataFrame) -> DataFrame:
    """The complete result of a streamed aggregate after all that is there now."""
    spark = stream.sparkSession
    out = fresh_path(spark, "streamed")
    last: dict = {}

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{batch}")  # the same batch again writes the same
        last["path"] = f"{out}/{batch}"

    run(stream, write, mode="complete")
    return spark.read.schema(stream.schema).parquet(last["path"])


def appended(stream: DataFrame) -> DataFrame:
    """All rows of a stream without aggregates, by an exactly-once file sink."""
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, "appended")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _list(spark: SparkSession, path: str) -> list:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []


def buckets(spark: SparkSession, out: str, before: float = float("inf")) -> tuple[dict[str, str], list]:
    """Where the newest table of each bucket is, of the batches before one that were written to their end;
    and the folders of buckets that a newer one has replaced."""
    jvm, now, old = spark._jvm, {}, []
    done = [p for p in _list(spark, out) if int(p.getName()) < before and any(x.getName() == "_SUCCESS" for x in _list(spark, p.toString()))]
    for batch in sorted(done, key=lambda p: int(p.getName())):
        for p in _list(spark, batch.toString()):
            if p.getName().startswith("bucket="):
                if p.getName() in now:
                    old.append(jvm.org.apache.hadoop.fs.Path(now[p.getName()]))
                now[p.getName()] = p.toString()
    return now, old


def merged(stream: DataFrame, key: str, order: list[str], *, out: str | None = None, checkpoint: str | None = None, parts: int = 64) -> DataFrame:
    """Incremental upsert: keys are dealt into ``parts`` buckets, and a batch's last rows are merged into the
    buckets that they belong to; others aren't read or written. What is where is found in ``out`` itself: with
    the same ``out`` and ``checkpoint`` a new driver goes on where the last one ended, and a batch that is done
    again writes the same tables."""
    spark = stream.sparkSession
    out, checkpoint = out or fresh_path(spark, "merged"), checkpoint or fresh_path(spark, "stream")

    def each(df: DataFrame, batch: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(parts)).alias("bucket")
        new = changes.latest(df, key, order)
        now, old = buckets(spark, out, batch)
        touched = [now[f"bucket={r[0]}"] for r in new.select(bucket).distinct().collect() if f"bucket={r[0]}" in now]  # at most ``parts``
        if touched:
            new = changes.latest(spark.read.schema(new.schema).parquet(*touched).unionByName(new), key, order)
        new.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/{batch}")
        for p in old:  # replaced before this batch, so a repeat of it doesn't need them
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    stream.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    empty = changes.latest(spark.createDataFrame([], stream.schema), key, order)
    now, _ = buckets(spark, out)
    return spark.read.schema(empty.schema).parquet(*now.values()) if now else empty


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "1 day") -> DataFrame:
    return stream.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))


def tumbling(stream: DataFrame, ts: str, width: str, by: list[str], **aggs) -> DataFrame:
    return stream.groupBy(F.window(ts, width).alias("w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])


def deduped(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First rows of each key within the lateness of the event time."""
    return stream.dropDuplicatesWithinWatermark(keys)
