"""Vector code compression: product codebooks trained by tree aggregation over NumPy blocks.

Vectors become integers floor(scale * x), cut into equal consecutive parts. Blocks of rows
are turned once into columnar tensors (a dimension is one contiguous run) and written to
the shared checkpoint folder. A round is one RDD.treeAggregate over them: distances to the
entries accumulate dimension by dimension, np.add.at adds each part to the int64 sum and
count tensors of its nearest entry, and the tensors, whose size depends on the codebooks
only, merge through a reduction tree. Only they reach the driver.

All numbers are exact: where components are so large that sums or squares could leave 64
bits, the same arrays hold Python integers. An error beyond 64 bits is null.

Defined results: rows whose vector is null, or holds a null or non-finite component, are
left out. Shorter vectors count as if filled up with zeros to the longest one, and all to a
multiple of the number of parts. Codebooks start from the rows of smallest id, ties in the
order of their vectors, null ids last; with fewer rows there are fewer entries. Repeated
rows count each. An empty table gives no rows and empty codebooks. Other columns are kept;
a column that has the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, lean

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Partitions from which the reduction tree gets one more level.
WIDE_TREE = 4096
#: Labels that hold more than one in so many rows are joined by broadcast: at most so many.
HEAVY_SHARE = 200
NARROW, EXACT = 0, 1


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _floor(x: float, scale: int) -> int:
    """floor(scale * x) exactly; from 2^53 on a double is an integer."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def _tensor(values: np.ndarray, sizes: np.ndarray, scale: int) -> np.ndarray:
    """(dimensions, rows) integers of vectors that lie end to end; int64 where all fit 32 bits."""
    width, n = int(sizes.max(initial=0)), len(sizes)
    exact = bool(len(values)) and float(np.abs(values).max()) * scale >= 2.0**31 - 1
    out = np.zeros((width, n), object if exact else np.int64)
    row = np.repeat(np.arange(n), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, row] = np.array([_floor(x, scale) for x in values.tolist()], object) if exact else np.floor(values * scale).astype(np.int64)
    return out


def _packed(tensor: np.ndarray) -> tuple[int, bytes]:
    return (EXACT, pickle.dumps(tensor)) if tensor.dtype == object else (NARROW, tensor.astype("<i4").tobytes())


def _unpacked(form: int, width: int, rows: int, data: bytes, exact: bool) -> np.ndarray:
    tensor = pickle.loads(data) if form == EXACT else np.frombuffer(data, "<i4").reshape(width, rows).astype(np.int64)
    return tensor.astype(object) if exact else tensor


def _blocks(at: int, scale: int):
    """Batches of rows -> one row a batch: other columns as lists, the tensor as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(at)
            tensor = _tensor(column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False), scale)
            top = float(max(abs(int(tensor.max())), abs(int(tensor.min())))) if tensor.size else 0.0
            form, data = _packed(tensor)
            rest = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for i, c in enumerate(batch.columns) if i != at]
            own = [pa.array([n], pa.int32()), pa.array([len(tensor)], pa.int32()), pa.array([top], pa.float64()), pa.array([form], pa.int32()), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays([*rest, *own], names=[*[f"c{i}" for i in range(len(rest))], "rows", "width", "top", "form", "data"])

    return run


def nearest(part: list[np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row; ties go to the lower index.

    part: one array a dimension; entries: (entries, dimensions).
    """
    n = len(part[0]) if part else 0
    distance = np.zeros((n, len(entries)), entries.dtype)
    for j, column in enumerate(part):
        gap = column[:, None] - entries[None, :, j]
        distance += gap * gap
    best = np.argmin(distance, axis=1) if n else np.zeros(0, np.int64)
    return best, distance[np.arange(n), best]


class Codebooks:
    """entries: integers (parts, entries, dimensions of a part)."""

    def __init__(self, entries: np.ndarray, scale: int = SCALE):
        self.entries, self.scale = entries, scale

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def parts(self, tensor: np.ndarray) -> list[list[np.ndarray]]:
        """The columns of each part; dimensions that a block lacks are zero."""
        p, _, w = self.entries.shape
        zero = np.zeros(tensor.shape[1], tensor.dtype)
        return [[tensor[d] if d < len(tensor) else zero for d in range(k * w, (k + 1) * w)] for k in range(p)]

    def vector(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        return [float(x) / self.scale for p in range(len(self.entries)) for x in self.entries[p, int(code[2 * p : 2 * p + 2], 16)]]


def _step(books: Codebooks, exact: bool):
    """The functions of one aggregation: add a block, merge two pairs of tensors."""

    def add(have, row):
        n, width, form, data = row
        sums, counts = have if have is not None else (np.zeros_like(books.entries), np.zeros(books.entries.shape[:2], np.int64))
        tensor = _unpacked(form, width, n, bytes(data), exact)
        for p, part in enumerate(books.parts(tensor)):
            if not part:  # vectors without components: all are alike
                counts[p, 0] += n
                continue
            best, _ = nearest(part, books.entries[p])
            np.add.at(counts[p], best, 1)
            for j, column in enumerate(part):
                np.add.at(sums[p, :, j], best, column)
        return sums, counts

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        return a[0] + b[0], a[1] + b[1]

    return add, merge


def trained(blocks: DataFrame, start: Codebooks, rounds: int, exact: bool) -> Codebooks:
    """Codebooks after `rounds` rounds of assigning and averaging; unused entries stay."""
    rdd = blocks.select("rows", "width", "form", "data").rdd.map(tuple)
    depth = 2 if rdd.getNumPartitions() <= WIDE_TREE else 3
    books = start
    for _ in range(rounds):
        sums, counts = rdd.treeAggregate(None, *_step(books, exact), depth)
        used = counts > 0
        entries = books.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        books = Codebooks(entries, start.scale)
    return books


def _first(rows: DataFrame, vector: str, key: str, parts: int, entries: int, scale: int, width: int, exact: bool) -> Codebooks:
    """The codebooks of the rows of smallest id: a bounded top-k."""
    firsts = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    size = -(-width // parts)
    table = np.zeros((len(firsts), size * parts), object)
    for i, r in enumerate(firsts):
        table[i, : len(r.v)] = [_floor(x, scale) for x in r.v]
    cut = table.reshape(len(firsts), parts, size).transpose(1, 0, 2)
    return Codebooks(np.ascontiguousarray(cut if exact else cut.astype(np.int64)), scale)


def _coded(books: Codebooks, exact: bool, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for i in range(batch.num_rows):
                n, width, form, data = (batch.column(rest + k)[i].as_py() for k in (0, 1, 3, 4))
                tensor = _unpacked(form, width, n, data, exact)
                code, error = np.full(n, "", dtype="U1"), np.zeros(n, books.entries.dtype)
                for p, part in enumerate(books.parts(tensor)):
                    best, far = nearest(part, books.entries[p]) if part else (np.zeros(n, np.int64), np.zeros(n, np.int64))
                    code, error = np.char.add(code, digits[best]), error + far
                errors = [e if e < 1 << 63 else None for e in error.tolist()]
                columns = [batch.column(c).slice(i, 1).flatten() for c in range(rest)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code.tolist(), pa.string()), pa.array(errors, pa.int64())], names=[f"c{c}" for c in range(rest + 2)])

    return run


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(`vectors` without the vector, with code and error; the codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    bound_batches(vectors.sparkSession)
    wide = vectors.withColumn(vector, F.col(vector).cast("array<double>"))
    kept = wide.where(_usable(F.col(vector)))
    rest = [f for f in vectors.schema.fields if f.name != vector]
    lists = [T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(rest)]
    own = [T.StructField(n, t) for n, t in (("rows", T.IntegerType()), ("width", T.IntegerType()), ("top", T.DoubleType()), ("form", T.IntegerType()), ("data", T.BinaryType()))]
    blocks = checkpointed(kept.mapInArrow(lean(_blocks(vectors.columns.index(vector), scale)), T.StructType([*lists, *own])))
    n, width, top = blocks.agg(F.sum("rows"), F.max("width"), F.max("top")).first()
    if n:
        # four times a squared component a dimension is the largest distance
        exact = max(4 * (top + 1) ** 2 * (width + parts), (top + 1) * n) >= 2.0**62
        books = trained(blocks, _first(kept, vector, key, parts, entries, scale, width, exact), rounds, exact)
    else:
        exact, books = False, Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    flat = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)], T.StructField(f"c{len(rest)}", T.StringType()), T.StructField(f"c{len(rest) + 1}", T.LongType())])
    out = blocks.mapInArrow(lean(_coded(books, exact, len(rest))), flat)
    names = [(i, f.name) for i, f in enumerate(rest) if f.name not in ("code", "error")] + [(len(rest), "code"), (len(rest) + 1, "error")]
    return out.select(*[F.col(f"c{i}").alias(name) for i, name in names]), books


def with_sums(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` over rows of an equal label; nulls are one label.

    A sum is null where a value is, or beyond 64 bits. Labels that hold a large share of
    all rows are few by that share, and reach them by broadcast; the others by a join.
    """
    total = F.when(F.count_if(F.col(value).isNull()) == 0, F.try_sum(value)).alias("_sum")
    totals = checkpointed(rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_rows"), total))
    n = totals.agg(F.sum("_rows")).first()[0] or 0
    heavy = F.broadcast(totals.where(F.col("_rows") * HEAVY_SHARE > n))
    light = totals.where(F.col("_rows") * HEAVY_SHARE <= n)
    equal = F.col(label).eqNullSafe(F.col("_label"))
    often = rows.join(heavy, equal)
    seldom = rows.join(heavy, equal, "left_anti").join(light, equal)
    kept = [c for c in rows.columns if c != name]
    return often.unionByName(seldom).select(*kept, F.col("_sum").alias(name))


def digest(coded: DataFrame, books: Codebooks, label: str = "label") -> DataFrame:
    """The report of the query; the codes are written once, since sums and rows need them."""
    rows = checkpointed(coded.select("vec_id", F.col(label).alias("label"), "code", "error"))
    return with_sums(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
