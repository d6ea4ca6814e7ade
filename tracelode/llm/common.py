"""Shared pieces of the training-data operators: tables, shared storage, Arrow batches and vectorised hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that reach Python hold at most so many rows and bytes, so that very long texts stay within memory.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
#: Bytes of text that one vectorised step takes at once (one document at least).
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where it is unset on a local master, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; the folder is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(there)
    system.deleteOnExit(there)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut and a lost executor loses nothing. It is deleted when the
    driver's JVM ends, if drop_stored() hasn't done so before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a loop, and around the stages of the pipeline: collects the driver's garbage, since its heap would grow to
    its bound over the plans of many rounds, of which little is alive, and gives freed memory back to the system. The C library's
    allocator has arenas for the JVM's hundreds of threads and keeps in them what they free; Python's keeps what training freed."""
    gc.collect()  # what Python still holds of the JVM's objects
    spark._jvm.System.gc()
    _trim_jvm(spark)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _trim_jvm(spark: SparkSession) -> None:
    """The JVM's System.trim_native_heap, which some JVMs don't have (before 17.0.9, or without glibc): then nothing is done."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.java.lang.Class.forName
    names = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(names):
        kinds[i] = kind(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # by the interface's method, since the server's own class is in no exported package
    invoke = kind("javax.management.MBeanServer").getMethod("invoke", kinds)
    with contextlib.suppress(Py4JJavaError):
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def own_key(column: str) -> Column:
    """A one-to-one image of a long column, as a join key: what was aggregated by the column is then dealt anew for the join,
    so that Spark can split a skewed partition of either side."""
    return F.col(column).bitwiseXOR(F.lit(0x5DEECE66D))


# Arrow columns as numpy


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as bytes and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def blobs(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8; nulls are empty."""
    body, offs = flat(column)
    whole = body.tobytes()
    cuts = offs.tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def groups(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, one row at least."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


# Words and their hashes

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
#: Words above so many bytes are hashed one by one.
LONG = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """MurmurHash3's 64-bit finaliser; changes x in place."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BY_LENGTH = mix(np.arange(1, LONG + 2, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    return mix(a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(29))) * _U(0xD6E8FEB86659FD93) + _U(0x165667B19E3779F9))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of consecutive texts, and where each text's words begin (n + 1)."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < offs[1:]]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[at[1:] - 1] = inside[at[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time go into the state by a bijection that isn't linear, so that no
    structure of words makes their hashes meet; words of more than LONG bytes by XXH64."""
    lens = ends - starts
    out = _BY_LENGTH[np.minimum(lens, LONG)] ^ mix(np.array([seed], np.uint64))
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    some, begin, left = slice(None), starts, lens
    while True:
        out[some] = mix(out[some] ^ (eight[begin] & _MASK[np.minimum(left, 8)]) * _U(0x9E3779B97F4A7C15))
        more = np.flatnonzero((left > 8) & (lens[some] <= LONG))
        if not len(more):
            break
        some, begin, left = more if isinstance(some, slice) else some[more], begin[more] + 8, left[more] - 8
    for k in np.flatnonzero(lens > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return out


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` consecutive entries of h (by doubling); empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, width, left, power, skip = None, 1, size, h, 0
    while True:
        if left & 1:
            part = power[skip : skip + n]
            out = part if out is None else join_hashes(out, part)
            skip += width
        left >>= 1
        if not left:
            return out.copy() if out is h else out
        power = join_hashes(power[:-width], power[width:])
        width *= 2


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` consecutive entries."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    m, width = h, 1
    while width * 2 <= size:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[:n], m[size - width : size - width + n])


def within(counts_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a run of `size` words starts and ends in one text, and the text of each; counts_at as words() gives it."""
    n = np.diff(counts_at)
    keep = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), keep)
    first = np.repeat(counts_at[:-1] - np.concatenate([[0], np.cumsum(keep)[:-1]]), keep)
    return first + np.arange(len(doc)), doc
