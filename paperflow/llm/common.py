"""Shared parts of the corpus operators: scratch tables, Arrow text buffers, word and shingle hashes, MinHash.

All hashing is vectorised over the bytes of a whole Arrow batch and cut into slices of a quarter of a megabyte, so a task's
working set does not depend on how long a single text is beyond its own bytes and word hashes.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
SLICE_BYTES = 1 << 18
BATCH_BYTES = 2 << 20
SHINGLE_WORDS = 5
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_MULT = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one of our own if the executors are
    threads of this process (tests); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-paperflow-"))
            at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands rows to Python in Arrow batches of BATCH_BYTES at most (a longer single row is a batch): what a
    Python worker and the JVM hold for a task is then a few such batches, however long the texts are. The setting is the session's and
    stays, as a plan reads it when it runs; a smaller one of the caller's is kept."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def released() -> None:
    """Gives memory that Arrow and the C library keep back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def trimmed(spark: SparkSession) -> bool:
    """Gives memory that the C library keeps for the driver's JVM back to the system: planning and compiling many queries leaves it in
    the arenas of hundreds of threads. Takes some 10 ms; false on a JVM without that command, which keeps it. Called by reflection, as
    Python doesn't reach the class behind the bean server."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array

    def listed(kind, *items):
        out = array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    of = jvm.java.lang.Class.forName
    kinds = listed(jvm.java.lang.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;"))
    command = listed(jvm.java.lang.Object, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)
    try:
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)
    except Py4JJavaError:
        return False
    return True


def fetched(spark: SparkSession) -> None:
    """Gives back what a fetch has left on the heap of the driver's JVM and beside it, before a model is fitted beside it."""
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def tidy(run: Callable[[Iterator[T]], Iterator[pa.RecordBatch | pa.Array]]) -> Callable[[Iterator[T]], Iterator[pa.RecordBatch | pa.Array]]:
    """run, after which the memory that it used is given back."""

    def whole(batches: Iterator[T]) -> Iterator[pa.RecordBatch | pa.Array]:
        yield from run(batches)
        released()

    return whole


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/paperflow/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors, knows its size. The
    driver gives back what planning it has left. Its place is kept in the attribute scratch_path, for dropped(); options are the writer's."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    trimmed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    trimmed(df.sparkSession)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of about SLICE_BYTES that end at the end of a text or, in longer texts, before white space."""
    out, at, total = [], 0, int(offsets[-1])
    while at < total:
        end = int(offsets[np.searchsorted(offsets, at + SLICE_BYTES, "right") - 1])
        if end <= at:
            end = at + SLICE_BYTES
            stop = int(offsets[np.searchsorted(offsets, at, "right")])
            while end < stop and not _WS[raw[end]]:
                end += 1
            end = min(end, stop)
        out.append((at, end))
        at = end
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of each text (A-Z as a-z if fold), and the word offsets (n + 1)."""
    hashes, starts_at = [], []
    for lo, hi in _cuts(raw, offsets):
        b = _LOWER[raw[lo:hi]] if fold else raw[lo:hi]
        n = hi - lo
        up, down = _tables(n + 1)
        inside = ~_WS[b]
        edge = np.zeros(n + 1, bool)
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
        edge[inner] = True
        edge[0] = edge[n] = True
        before = np.empty(n, bool)
        before[0] = True
        np.logical_not(inside[:-1], out=before[1:])
        starts = np.flatnonzero(inside & (before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = True
        np.logical_not(inside[1:], out=after[:-1])
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_CODE[b] * up[:n], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT[15]
        hashes.append(mix(h))
        starts_at.append(starts + lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return h, np.searchsorted(at, offsets)


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, and their offsets (n + 1). A text of fewer than k words
    has its whole sequence as its one shingle; a text without words has none."""
    n_words = np.diff(at)
    count = np.maximum(n_words - (k - 1), 0)
    short = (n_words > 0) & (n_words < k)
    count[short] = 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        s = np.zeros(len(first), np.uint64)
        for j in range(k):
            s += padded[first + j] * _MULT[j]
        for w in range(1, k):
            which = np.flatnonzero(n_words == w)
            i = at[:-1][which]
            v = np.full(len(which), w, np.uint64) * _MULT[14]
            for j in range(w):
                v += padded[i + j] * _MULT[j]
            s[offsets[:-1][which]] = v
    s = mix(s)
    for d in np.flatnonzero(count > 1):
        s[offsets[d] : offsets[d + 1]].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[offsets[:-1][count > 0]] = True
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class MinHash:
    """num_perm multiply-shift permutations (universal hashes of 64 to 32 bits) over sets of 64-bit hashes."""

    def __init__(self, num_perm: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, num_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, num_perm, dtype=np.uint64)

    def signatures(self, s: np.ndarray, offsets: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """(texts x num_perm) uint32; of an empty set all are 2^32 - 1."""
        n = len(offsets) - 1
        out = np.full((n, len(self.a)), 0xFFFFFFFF, np.uint32)
        lo = 0
        with np.errstate(over="ignore"):
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, "right")) - 1)
                hi = min(hi, n)
                full = np.flatnonzero(np.diff(offsets[lo : hi + 1])) + lo
                if len(full):
                    for x in range(int(offsets[lo]), int(offsets[hi]), block * 8):  # a set longer than the block goes in parts
                        end = min(int(offsets[hi]), x + block * 8)
                        part = s[x:end]
                        mine = full[(offsets[full] < end) & (offsets[full + 1] > x)]
                        at = np.maximum(offsets[mine] - x, 0)
                        for j in range(len(self.a)):
                            v = np.minimum.reduceat((part * self.a[j] + self.b[j]) >> np.uint64(32), at).astype(np.uint32)
                            out[mine, j] = np.minimum(out[mine, j], v)
                lo = hi
        return out


def texts_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    return utf8(batch.column(batch.schema.get_field_index(name)))


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores as make it differ from every column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def count_of(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()
