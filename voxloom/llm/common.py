"""Shared pieces of the training-data operators: reading, stored steps, word hashing.

Steps that must not be recomputed (identifiers that depend on the partitioning,
iterative states) are written as Parquet below ``spark.checkpoint.dir``, the folder
that the driver and all executors share, so a lost executor costs a re-read only.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one vectorised step; a longer document is a step of its own.
CHUNK_BYTES = 1 << 19
#: Rows that a key must hold before join_hot() treats it as hot, whatever the number of rows.
HOT_ROWS = 1000

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
_own_dir: list[str] = []
_steps: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether the driver and all tasks run in one process, as the masters local and local[n] say."""
    return spark.sparkContext.master.split("[")[0] == "local"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; a local folder of its own only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="voxloom-"))
        base = f"file://{_own_dir[0]}"
    _steps.append(f"{base.rstrip('/')}/voxloom-{uuid.uuid4().hex}")
    return _steps[-1]


def stored(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from the written table; a write that fails leaves nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    try:
        df.write.parquet(path)
    except BaseException:
        remove(spark, path)
        raise
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete every step that this process has stored; for the end of a job, when its results are written."""
    while _steps:
        remove(spark, _steps.pop())


def estimated_bytes(df: DataFrame) -> int | None:
    """Bytes of the rows as the optimiser estimates them from the files, None where it can't; nothing is run."""
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told if told < 1 << 60 else None


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        remove(df.sparkSession, folder)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(left: DataFrame, right: DataFrame, key: Sequence[str], size: str) -> DataFrame:
    """left joined with right on key without gathering the rows of a hot key in one task.

    right holds one row a key, with the number of left's rows in column ``size``; it is read
    several times, so it should be stored. A key is hot when it holds more than a quarter
    of a partition's share of the rows, so there are at most four hot keys a partition:
    their rows of right are broadcast, all others meet by a shuffle.
    """
    key, parts = list(key), partitions(left.sparkSession)
    total, most = right.agg(F.sum(size), F.max(size)).first()
    least = max(HOT_ROWS, (total or 0) // (4 * parts))
    if (most or 0) <= least:
        return left.join(right, key)
    hot = right.filter(F.col(size) > least)
    names = [*key, *(c for c in left.columns if c not in key), *(c for c in right.columns if c not in key)]
    many = left.join(F.broadcast(hot), key).select(*names)
    few = left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(right.filter(F.col(size) <= least), key)
    return many.unionByName(few.select(*names))


def relieve() -> None:
    """Give back to the system what this worker has freed since its last batch: a worker lives through many stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array; null becomes the empty text. Called once a batch, it gives freed memory back."""
    relieve()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, byte offsets from 0) of runs of whole documents."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# ---- word hashing over UTF-8 bytes -------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A multiplier of its own for each place of a span, so no pattern of bytes cancels out.
_PLACES = 4096


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


_PLACE = _multipliers(_PLACES)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, whatever its place: bytes weighted by their place in the span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    place = ranges(size)
    longest = int(size.max())
    weight = _PLACE if longest <= _PLACES else _multipliers(longest)
    value = _BYTE[data[np.repeat(start, size) + place]] * weight[place]
    upto = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, dtype=np.uint64, out=upto[1:])
    last = np.cumsum(size)
    return mix(upto[last] - upto[last - size] + size.astype(np.uint64) * np.uint64(_BASE))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and the first word of each document (one more at the end)."""
    word = ~_BLANK[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    if len(data):
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[first] = word[first]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] = word[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; callers drop windows that cross documents."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    if not len(counts):
        return np.zeros(0, np.int64)
    total = np.cumsum(counts)
    return np.arange(total[-1]) - np.repeat(total - counts, counts)
