"""Shared pieces: written tables in the cluster's shared folder, checked broadcasts and byte-level text arrays."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast: at most this many narrow rows (a few longs each).
BROADCAST_ROWS = 1_000_000

#: Bytes of text that the numpy passes handle at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 19


#: Rows of an Arrow batch where the session keeps Spark's default, 10,000: so many texts take tens of MB off the heap of
#: an executor and in each of its Python workers.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Rows of a few longs in a file of a written table whose size is known.
FILE_ROWS = 100_000


class Workspace:
    """Tables written to a folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``, or what SparkContext.setCheckpointDir was given; only where both
    are unset and the master is local (tests on one machine) a temporary folder takes its place, elsewhere it is an
    error. A written table cuts lineage and survives the loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
        if spark.conf.get(_BATCH) == "10000":
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        self.spark = spark
        self.root = f"{base.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """``most``: no more rows than these, each of a few longs; the table then has no more files than they need.

        On a local file system without Hadoop's native library each file starts two processes (chmod) on an executor.
        """
        if most is not None:
            df = df.coalesce(max(1, -(-most // FILE_ROWS)))
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        relieve(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all of them."""
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone by then
            pass


_OWN: list[str] = []


def _own_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, else, under a local master, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _OWN[0]


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the side, counted now, has at most max_rows rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions for so many rows: the session's number, or more where that would overfill them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // per_partition))


def release() -> None:
    """Gives memory that this process no longer uses back to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def relieve(spark: SparkSession) -> bool:
    """Gives back what the driver, its Python and its JVM, no longer uses; tells if the JVM could (JDK 17.0.9 and later on Linux).

    Each of the JVM's hundreds of threads takes native memory from one of many pools, which keep what was freed; over a
    pipeline's queries that comes to hundreds of MB.
    """
    release()
    try:
        jvm, objects = spark._jvm, spark.sparkContext._gateway.new_array
        kind = jvm.java.lang.Class.forName
        types, values = objects(jvm.java.lang.Class, 4), objects(jvm.java.lang.Object, 4)
        for i, x in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(x)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by reflection on the interface, as the server's own class isn't open
        kind("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Exception:  # noqa: BLE001 - another JVM, or none within reach: it only keeps more memory
        return False
    return True


def lean(run):
    """The function over Arrow batches, after whose end the worker, which Spark keeps for other tasks, holds no unused memory."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Runs of whole rows of at most limit bytes: (first row, data, offsets). A longer row comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word (a run without separators that stays in its row)."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, worked out in blocks so that a very long text needs no more memory."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    upto = np.cumsum(lengths)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK_BYTES, "right")))
        size = lengths[i:j]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        value = _BYTE[data[place + np.repeat(starts[i:j], size)]]
        power = np.multiply.accumulate(np.full(int(size.max()) + 1, _BASE, np.uint64))
        out[i:j] = mix(np.add.reduceat(value * power[place], first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out
