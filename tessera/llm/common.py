"""Shared helpers: Arrow text access, fingerprints, shared-folder tables."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on: bounds a worker's memory.
STEP_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_MIX = U64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of
    our own, if all runs on one machine; else rows would be lost, so it is an error."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir"):
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage,
    so that a lost executor costs the reread of a file. Gone when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``stored``, in buckets by ``key``: later joins on it move only the other side."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tessera/{table_name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table_name)
    _delete_on_exit(spark, path)
    return spark.table(table_name)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string/binary column and its n+1 offsets; null counts as empty."""
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def cuts(off: np.ndarray, step: int, overlap: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """Work that fits in a step: (first row, first byte, offsets) of whole rows together, or of stretches
    of one row that is longer than ``step`` bytes; these reach ``overlap`` bytes into the next one."""
    for i, j in steps(off, step):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= step:
            yield i, lo, off[i : j + 1] - lo
        else:
            for at in range(lo, hi, step):
                yield i, at, np.array([0, min(at + step + overlap, hi) - at])


def steps(off: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Powers:
    """Powers of an odd multiplier mod 2**64 and of its inverse, grown on demand: window
    hashes are differences of one running sum."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)
        self.inverse = U64(pow(int(_MULT), -1, 1 << 64))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                m = max(n, 2 * len(self.up))
                a = np.full(m, _MULT)
                b = np.full(m, self.inverse)
                a[0] = b[0] = 1
                self.up, self.down = np.cumprod(a, dtype=U64), np.cumprod(b, dtype=U64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(32))) * _MIX
        return h ^ (h >> U64(29))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(mix(np.arange(1, 257, dtype=U64) * _MULT))


def running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes of any slices: sums of values[j]*M**j, and M**-j."""
    up, down = POWERS.get(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def slices(run: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each values[lo:hi]; equal content, equal hash."""
    sums, down = run
    with np.errstate(over="ignore"):
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U64) * _MULT)


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of maximal runs of word bytes within each row,
    and the n+1 word offsets of the rows. ``is_word``: 256 booleans."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = is_word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end] (in order, not overlapping), a step of bytes at a time."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP_BYTES, "right")))
        lo = int(starts[i])
        out[i:j] = slices(running(BYTE_VALUE[data[lo : int(ends[j - 1])]]), starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that clash with an operator's own; the operator's win."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tidy() -> None:
    """Give back memory that this worker has freed: the next stage's workers share the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES at most, from now on in this session."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` in small batches; the worker's memory is given back at the end of a task."""
    small_batches(df.sparkSession)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return df.mapInArrow(tidied, schema)


def computed(df: DataFrame, read: str, fields: list[T.StructField], make: Callable) -> Column:
    """A struct column made from column ``read`` of ``df``: ``make()`` is called once per task and gives
    a function from an Arrow array to the arrays of the fields. Only ``read`` goes to Python and
    only the struct comes back; all other columns stay where they are, whatever their names."""
    small_batches(df.sparkSession)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for big in arrays:
            yield pa.StructArray.from_arrays(f(big), names=[x.name for x in fields])
        tidy()

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # nondeterministic for the planner only: it must not compute the column once for each use
    return F.arrow_udf(run, T.StructType(fields)).asNondeterministic()(F.col(f"`{read}`"))


def with_arrow(df: DataFrame, read: str, fields: list[T.StructField], make: Callable) -> DataFrame:
    """``df`` with the ``fields`` of ``computed``; input columns that have the name of one are replaced."""
    held = free_name(df, "computed")
    base = [c for c in df.columns if c.lower() not in {f.name.lower() for f in fields}]
    out = df.withColumn(held, computed(df, read, fields, make))
    return out.select(*[f"`{c}`" for c in base], *[F.col(f"{held}.{f.name}") for f in fields])
