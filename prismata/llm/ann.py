"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Points are dealt to ranges of similar norms, a factor RANGE wide, each with its own tables, so
that a few long vectors spoil no other's index; all ranges of up to SCANNED points are one
bucket that every query visits. Within a range, inner products become Euclidean distances by
one more coordinate: a stored x gets sqrt(M^2 - |x|^2), M being the range's largest norm, a
query is scaled to norm M and gets zero. Each of TABLES tables hashes a point by FUNCTIONS projections floor((a.x + b) / w), with a
from the 2-stable normal distribution. A query visits, in each table, its own bucket and
the perturbed ones (one step down or up in some functions) in the order of estimated
success: the sum of squared distances to the crossed borders. The candidates of all
visited buckets are merged and reranked by the exact inner product. A query for which fewer
than TOP others were found is compared with every point, in blocks.

The bucket's members and the probes that visit it meet in one task, as pieces of bounded
size (groups.grid); each task keeps the best of each query only. Equal vectors are one
point with its TOP + 1 smallest ids, which is all that can ever be reported of them, so a
vector that a third of the rows hold costs no more than any other, as stored or query.

The index holds every row and needs no training. Vectors that are null, empty, zero or
hold null or non-finite components, and those of another length than the most frequent
one, take no part; rows with a null id neither. Repeated rows with one id are one
candidate. Ties go to the smaller id. Empty tables give no rows. Other columns are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, lean
from .groups import columns, grid, streamed

TOP = 20
TABLES = 12
FUNCTIONS = 6
#: Bucket width as a part of the largest norm.
WIDTH = 1.4
PROBES = 96
#: Norms of a range differ by this factor at most; ranges of so few points are compared whole.
RANGE = 2**0.5
SCANNED = 64
#: Ranges begin a part of one further on, so that norms about 1 share one.
SHIFT = 0.37
SEED = 17
#: Candidates that a task holds before it keeps the best of each query and hands them on.
HELD = 400_000


def usable(vec: Column) -> Column:
    ok = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ok & F.exists(vec, lambda x: x != 0)


class Tables:
    """The hash functions of all tables and the order in which buckets are visited."""

    def __init__(self, dims: int, norm: float, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.tables, self.functions, self.norm, self.probes = tables, functions, norm, probes
        self.width = width * norm
        self.a = r.normal(size=(dims + 1, tables * functions))
        self.b = r.uniform(0, self.width, tables * functions)
        self.salt = r.integers(1, 1 << 62, size=functions, dtype=np.int64) | 1
        sets = [(0,) * functions]
        for n in range(1, min(functions, 5) + 1):
            for which in combinations(range(functions), n):
                for signs in product((-1, 1), repeat=n):
                    step = [0] * functions
                    for k, s in zip(which, signs):
                        step[k] = s
                    sets.append(tuple(step))
        self.steps = np.array(sets, dtype=np.int64)
        self.crossed = np.concatenate([self.steps < 0, self.steps > 0], axis=1).astype(np.float64).T

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in bucket widths: rows x tables x functions."""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.functions)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit key for integer bucket coordinates on the last axis."""
        with np.errstate(over="ignore"):
            h = (cells * self.salt).sum(axis=-1)
            h = (h ^ (h >> 29)) * np.int64(0x5851F42D4C957F2D)
        return h

    def stored(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return self.keys(np.floor(self.places(np.column_stack([x, extra]))).astype(np.int64))

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Keys of the visited buckets of each query: rows x tables x probes, best first."""
        q = x * (self.norm / np.sqrt((x * x).sum(axis=1)))[:, None]
        at = self.places(np.column_stack([q, np.zeros(len(q))]))
        base = np.floor(at)
        part = at - base
        gaps = np.concatenate([part, 1 - part], axis=2) ** 2
        cost = gaps @ self.crossed
        n = min(self.probes, cost.shape[2])
        best = np.argpartition(cost, n - 1, axis=2)[:, :, :n]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 2), axis=2, kind="stable"), 2)
        return self.keys(base.astype(np.int64)[:, :, None, :] + self.steps[best])


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


#: The key of the bucket that is compared whole.
WHOLE = -1
#: The level of points whose norm is zero or infinite as a double.
OTHER = 1 << 20


def _spread(index):
    """(point, vec, asks, level) to one row a table and, where they ask, one row a probe.

    index: the tables of each hashed level; points of other levels go to the bucket WHOLE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_level = index.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, level = _vectors(part.column(1)), part.column(3).to_numpy()
                asks = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                rest = np.flatnonzero(~np.isin(level, list(by_level)))
                yield _rows(part, rest, np.full(len(rest), WHOLE), False)
                yield _rows(part, asks, np.full(len(asks), WHOLE), True)
                for k, tables in by_level.items():
                    own = np.flatnonzero(level == k)
                    if len(own):
                        yield _rows(part, np.repeat(own, tables.tables), _salted(tables.stored(x[own]), k), False)
                    if len(asks):
                        key = tables.visited(x[asks])
                        yield _rows(part, np.repeat(asks, key.shape[1] * key.shape[2]), _salted(key, k), True)

    return run


def _salted(key: np.ndarray, level: int) -> np.ndarray:
    """Keys (rows x tables, or rows x tables x probes) that differ between tables and levels."""
    t = np.arange(key.shape[1]).reshape(1, -1, *[1] * (key.ndim - 2))
    salt = (t + 1000 * (level + 10_000)).astype(np.int64) * np.int64(0x9E3779B97F4A7C1)
    return (key ^ salt).ravel()


def _rows(part: pa.RecordBatch, at: np.ndarray, key: np.ndarray, probe: bool) -> pa.RecordBatch:
    place = pa.array(at)
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), part.column(0).take(place), part.column(1).take(place), pa.array(np.full(len(at), probe))], names=["key", "point", "vec", "asks"])


def _best(ask: np.ndarray, point: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Which candidates are among the `top` of their query (repeats are counted once)."""
    order = np.lexsort((point, -score, ask))
    a, p = ask[order], point[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
    order, a = order[new], a[new]
    first = np.searchsorted(a, a)
    return order[np.arange(len(a)) - first < top]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up from the first component on."""
    return np.cumsum(a * b, axis=1)[:, -1] if len(a) else np.zeros(0)


def _compare(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if held:
                ask, point, score = (np.concatenate([h[k] for h in held]) for k in range(3))
                keep = _best(ask, point, score, top)
                held, count = [(ask[keep], point[keep], score[keep])], len(keep)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            for ask, point, score in held:
                yield pa.RecordBatch.from_arrays([pa.array(ask), pa.array(point), pa.array(score)], names=["ask", "point", "score"])
            held, count = [], 0

        def handle(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal count
            probe = t.column(4).to_numpy(zero_copy_only=False)
            name = t.column(2).to_numpy()
            column = t.column(3).combine_chunks()
            x = _vectors(column if isinstance(column, pa.Array) else column.chunk(0))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                asks = lo + np.flatnonzero(probe[lo:hi])
                points = lo + np.flatnonzero(~probe[lo:hi])
                if not len(asks) or not len(points):
                    continue
                for k in range(0, len(asks), 512):
                    own = asks[k : k + 512]
                    near = x[own] @ x[points].T
                    if len(points) > top:
                        # rounding of the product may not push out an equal: keep a little more
                        edge = np.partition(near, len(points) - top, axis=1)[:, len(points) - top, None]
                        i, j = np.nonzero(near >= edge - 1e-9 * np.maximum(1, np.abs(edge)))
                    else:
                        i, j = (c.ravel() for c in np.indices(near.shape))
                    held.append((name[own[i]], name[points[j]], exact(x[own[i]], x[points[j]])))
                    count += len(i)
                if count > HELD:
                    flush()
                    if count > HELD // 2:
                        yield from out()

        yield from streamed(batches, columns(0, 1), handle)
        flush()
        yield from out()

    return run


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec: str = "embedding", top: int = TOP, **how) -> DataFrame:
    """(query_id, rank, id, score): the `top` nearest other rows found for each query row."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec))).select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("vec"), is_query.alias("asks"))
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").select("d").first()
    dims = dims["d"] if dims else 1
    rows = rows.where(F.size("vec") == dims)
    # equal vectors are one point; a row number up to a constant is cut before the shuffle too
    one = Window.partitionBy("vec").orderBy("id")
    low = rows.select("id", "vec").withColumn("r", F.dense_rank().over(one)).where(F.col("r") <= top + 1)
    ids = low.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    asking = rows.where("asks").groupBy("vec").agg(F.lit(True).alias("asks"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    level = F.when((norm > 0) & (norm < float("inf")), F.floor(F.log2(norm) / float(np.log2(RANGE)) + SHIFT)).otherwise(OTHER).cast("int")
    points = ids.join(asking, "vec", "left").select(F.col("ids")[0].alias("point"), "vec", F.coalesce("asks", F.lit(False)).alias("asks"), "ids", norm.alias("norm"))
    points = checkpointed(points.withColumn("level", level))
    # levels are few: a double has 4,200 half octaves at most
    levels = points.where(F.col("level") != OTHER).groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("m")).orderBy("level").collect()
    index = spark.sparkContext.broadcast({r["level"]: Tables(dims, r["m"], **how) for r in levels if r["n"] > SCANNED})
    found = _compared(points.select("point", "vec", "asks", "level"), index, top)
    # who found too few is compared with all
    total = points.count()
    asked = points.where("asks").select(F.col("point").alias("ask"))
    many = found.groupBy("ask").agg(F.count_distinct("point").alias("n")).where(F.col("n") >= min(top + 1, total)).select("ask")
    short = checkpointed(asked.join(many, "ask", "left_anti"))
    if index.value and not short.isEmpty():
        again = points.join(short, points["point"] == short["ask"], "left").select("point", "vec", F.col("ask").isNotNull().alias("asks"), F.lit(OTHER).alias("level"))
        found = found.unionByName(_compared(again, spark.sparkContext.broadcast({}), top))
    merged = found.groupBy("ask", "point").agg(F.first("score").alias("score"))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "point")
    best = merged.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)
    named = best.join(points.select("point", "ids"), "point").groupBy("ask").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))))).alias("all"))
    named = named.select("ask", F.slice("all", 1, top + 1).alias("all"))
    asks = rows.where("asks").select("id", "vec").distinct().join(points.where("asks").select("vec", F.col("point").alias("ask")), "vec").select("id", "ask")
    out = asks.join(named, "ask").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("all", lambda c: c["id"] != F.col("id")), 1, top)).alias("pos", "c"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("c.id").alias(id_col), (-F.col("c.s")).alias("score"))


def _compared(points: DataFrame, index, top: int) -> DataFrame:
    """(ask, point, score): the best candidates that share a bucket with each asking point."""
    spread = points.mapInArrow(lean(_spread(index)), "key long, point long, vec array<double>, asks boolean")
    dealt = _cells(spread).select("key", "cell", "point", "vec", "asks").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return checkpointed(dealt.mapInArrow(lean(_compare(top + 1)), "ask long, point long, score double"))


def _cells(spread: DataFrame) -> DataFrame:
    """Pieces of buckets: probes lie along one axis, stored points along the other."""
    cells = grid(spread, "key", F.xxhash64("point"), F.col("asks"))
    # a probe isn't a stored point: its repeats on the other axis are left out
    return cells.where(F.col("asks") == F.col("probe"))
