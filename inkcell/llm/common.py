"""Shared plumbing: shared-storage tables, Arrow text buffers and vectorised byte/word hashing."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: glibc's function that returns free memory; None elsewhere.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
#: Odd base of the wrapping polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes of text that vectorised code handles at a time (a longer document is handled alone).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one if driver and
    executors are one process; otherwise an error, as executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="inkcell-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and reread it: lineage ends there, so a lost executor
    costs no recomputation of what came before. ``discard`` deletes what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    # small row groups, as a writer holds one in memory
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about ``limit`` bytes of text.

    Yields (slice, data, offsets): the UTF-8 bytes of all texts of the slice end to end and the
    n+1 offsets of the texts. A null text is empty.
    """
    col = batch.column(batch.schema.names.index(column))
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def give_back() -> None:
    """Hand memory that a worker no longer uses back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


class _Powers:
    """Tables of BASE**i and INVERSE**i, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(BASE, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(INVERSE, k, 2**64))])
        return self.up, self.down


POWERS = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running wrapping sums from which ``span_hash`` gives the hash of any span."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of data[start:end]; equal spans have equal hashes."""
    _, down = POWERS.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


#: Masks of the first 0 to 8 bytes of a little-endian word of eight.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: blocks of eight bytes are each mixed with their place in the span, then
    summed. Unlike ``span_hash`` it isn't linear in the bytes, so no family of strings collides by rule."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    total = mix(eight[starts] & FIRST_BYTES[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        first = np.cumsum(more) - more
        nth = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(starts[long], more) + 8 * nth
        block = eight[at] & FIRST_BYTES[np.minimum(np.repeat(ends[long], more) - at, 8)]
        total[long] += np.add.reduceat(mix(block ^ mix(nth.astype(U64) * U64(BASE))), first)
    return mix(total + size.astype(U64) * U64(0xA24BAED4963EE407))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``keep[byte]``, never across texts: starts, ends, and the index of the
    first word of each text (n+1 entries)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = keep[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = cut[cut > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (len - k + 1 of them; none if there are fewer)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(BASE)
        out += word_hash[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    have = 1
    while have < w:
        step = min(have, w - have)
        if len(x) <= step:
            return x[:0]
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def crc32_column(name: str = "doc_id"):
    """crc32 of the id as text, as a column."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(name).cast("string").cast("binary"))


def parallelism(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions for a shuffle: the session's setting, or more where the scan itself has more."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, df.rdd.getNumPartitions()) if df is not None else n
