"""Comparing the members of one key with each other, in bounded pieces.

grid() gives every row of a key its cell; a key of more than CELL rows is split into a
square of cells so that each probing row meets each stored row in exactly one cell.
streamed() hands the cells, which arrive sorted, to a function one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

CELL = 4096
#: Heavy keys that may be broadcast: 16 bytes each.
HEAVY_KEYS = 500_000


def grid(rows: DataFrame, key: str, salt: Column, probes: Column, cell: int = CELL) -> DataFrame:
    """Adds `cell` and `probe`: in each cell, rows with `probe` meet all rows.

    A key of up to `cell` rows is one cell, and rows with `probes` probe it. A heavier key
    becomes a square of cells: probing rows are dealt to its lines and repeated along them,
    and every row is also stored in its column and repeated down it, so that each pair of a
    probing row and another meets exactly once.
    """
    heavy = checkpointed(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > cell).select(key, F.ceil(F.col("_n") / cell).cast("int").alias("_g")))
    n = heavy.count()
    if not n:
        return rows.withColumn("cell", F.lit(0)).withColumn("probe", probes)
    # heavy keys are few, each having over `cell` rows; without a broadcast all rows move twice
    out = rows.join(F.broadcast(heavy) if n <= HEAVY_KEYS else heavy, key, "left")
    out = out.withColumn("_g", F.coalesce("_g", F.lit(1))).withColumn("_s", F.pmod(salt, F.col("_g")).cast("int"))
    g, s = F.col("_g"), F.col("_s")
    every = F.sequence(F.lit(0), g - 1)
    at = lambda c, probe: F.struct(c.cast("int").alias("cell"), probe.alias("probe"))
    along = F.transform(every, lambda o: at(s * g + o, F.lit(True)))
    down = F.transform(every, lambda o: at(o * g + s, F.lit(False)))
    places = F.when(g == 1, F.array(at(F.lit(0), probes))).when(probes, F.concat(along, down)).otherwise(down)
    out = out.withColumn("_at", F.explode(places))
    return out.withColumn("cell", F.col("_at.cell")).withColumn("probe", F.col("_at.probe")).drop("_g", "_s", "_at")


def streamed(batches: Iterator[pa.RecordBatch], keys: Callable[[pa.Table], list[np.ndarray]], handle: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call handle(table, bounds) with whole groups; bounds are the groups' first rows and the end.

    keys gives the arrays by which a table's rows are grouped.
    """
    held: pa.Table | None = None

    def changes(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for x in keys(t):
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, t]) if held is not None else t
        starts = changes(held)
        if len(starts) > 1:
            last = int(starts[-1])
            yield from handle(held.slice(0, last).combine_chunks(), starts)
            held = held.slice(last)
    if held is not None:
        yield from handle(held.combine_chunks(), np.append(changes(held), held.num_rows))


def columns(*at: int) -> Callable[[pa.Table], list[np.ndarray]]:
    """Keys that are columns of the table."""
    return lambda t: [t.column(k).to_numpy() for k in at]
