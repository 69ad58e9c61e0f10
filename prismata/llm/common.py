"""Shared pieces of the text operators: table access, checkpoints, byte-level word scanning."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checkpoints import shared_folder

#: Rows that travel to a Python worker at once stay under this size, long texts included.
BATCH_BYTES = 8 << 20
#: Bytes of text that one vectorised scan handles; a longer text is scanned whole.
SCAN_BYTES = 1 << 20


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map, handing freed memory back to the system when a task ends.

    Workers live on between tasks and stages, beside an executor of bounded memory. What a
    worker has imported before its first task stays, and is not looked through after each one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not gc.get_freeze_count():
            gc.collect()
            gc.freeze()
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that batches of long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` into the shared checkpoint folder of the session and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """checkpointed() in columns, for rows that are read several times by few of their columns."""
    spark = df.sparkSession
    if any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType, T.VariantType)) for f in df.schema):
        return checkpointed(df)
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renamed(out: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns c0, c1, ... of `out` under the names of `docs` and the added ones.

    An added column takes the place of one of `docs` that has its name.
    """
    names = [*((k, n) for k, n in enumerate(docs.columns) if n not in added), *((len(docs.columns) + k, n) for k, n in enumerate(added))]
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in names])


def slices(column: pa.Array, limit: int = SCAN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about `limit` bytes each, one row at least."""
    offsets = _offsets(column)
    n, lo = len(column), 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(1, np.int64)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the row offsets in them; null is empty."""
    column = column.fill_null("") if column.null_count else column
    offsets = _offsets(column)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0-9, a-z and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= SCAN_BYTES:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the radix of running hashes, and their inverses."""
    return _powers_of(_RADIX, n), _powers_of(_INVERSE, n) if n else np.zeros(0, np.uint64)


class Words:
    """The words of some rows: byte bounds, row number and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ALNUM):
        low = LOWER[data]
        w = inside[low]
        n = len(w)
        left, right = np.zeros(n, bool), np.zeros(n, bool)
        left[1:], right[:-1] = w[:-1], w[1:]
        edge = offsets[1:-1]
        left[edge[edge < n]] = False
        right[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(w & ~left)
        self.end = np.flatnonzero(w & ~right) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        if n:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers_of(_RADIX, n), out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * _powers_of(_INVERSE, n)[self.start]
            self.hash = mixed(h + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end) the number of characters before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def crc_mod(column: str, m: int):
    """crc32 of a column as text, modulo m."""
    return F.crc32(F.col(column).cast("string")) % F.lit(m)
