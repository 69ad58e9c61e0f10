"""Normalised lines of texts, their nodes, and a second reading of wanted ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, checkpointed, lean, LOWER, slices, utf8

#: Words of 0-9, a-z and letters beyond ASCII, line by line.
BY_LINE = np.where(ALNUM[LOWER], LOWER, 32).astype(np.uint8)
BY_LINE[10] = 10
#: A whole text as one line; words are split at \x20 and \x09-\x0D only.
BY_TEXT = LOWER.copy()
BY_TEXT[9:14] = 32


class Lines:
    """The lines of some texts: normalised bytes, where each begins and ends, and its text's row.

    `plain` says what each byte becomes: 32 stands between words, 10 ends a line.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, plain: np.ndarray = BY_LINE):
        inner = offsets[1:-1]
        rows = len(offsets) - 1
        ends_of_rows = offsets[1:] + np.arange(rows)
        data = np.append(np.insert(np.frombuffer(data.tobytes().translate(plain.tobytes()), np.uint8), inner, 10), np.uint8(10)) if rows else data
        blank = data <= 32
        keep = np.ones(len(data), bool)
        keep[1:] = ~((data[1:] == 32) & blank[:-1])
        if len(data):
            keep[0] = data[0] != 32
        self.row_of_break = np.searchsorted(ends_of_rows, np.flatnonzero(data == 10))
        self.text = data[keep]
        self.end = np.flatnonzero(self.text == 10)
        self.start = np.append(0, self.end[:-1] + 1) if len(self.end) else self.end
        #: The lines of row r are those from first[r] to first[r + 1].
        self.first = np.append(0, np.cumsum(np.bincount(self.row_of_break, minlength=rows)))
        self.end = np.where((self.end > self.start) & (self.text[self.end - 1] == 32), self.end - 1, self.end)
        self.some = np.flatnonzero(self.end > self.start)

    def nodes(self) -> np.ndarray:
        """XXH64 of each line that has words, in the order of `some`."""
        raw, one = self.text.tobytes(), xxhash.xxh64_intdigest
        return np.array([one(raw[a:b]) for a, b in zip(self.start[self.some].tolist(), self.end[self.some].tolist())], np.uint64).view(np.int64)


#: Bits of a node's number that choose its block in the filter of wanted nodes, and its bits there.
FILTER_AT = 20
FILTER_BITS = (0, 6, 12, 40, 46, 52, 58)
FILTER_BLOCKS = 1 << 20


def wanted_filter(nodes: DataFrame, count: int) -> np.ndarray:
    """A blocked Bloom filter of the column node, of a bounded size: blocks x seven words.

    Its blocks are made by one bit_or aggregate; what it lets through is joined exactly.
    """
    blocks = min(FILTER_BLOCKS, 1 << max(4, (count // 8).bit_length()))
    one = F.lit(1).cast("long")
    bit = lambda at: F.call_function("shiftleft", one, F.shiftrightunsigned("node", at).bitwiseAND(F.lit(63)).cast("int"))
    block = F.shiftrightunsigned("node", FILTER_AT).bitwiseAND(F.lit(blocks - 1))
    rows = nodes.groupBy(block.alias("block")).agg(*[F.bit_or(bit(at)).alias(f"w{k}") for k, at in enumerate(FILTER_BITS)]).toArrow()
    out = np.zeros((blocks, len(FILTER_BITS)), np.int64)
    out[rows.column("block").to_numpy()] = np.stack([rows.column(f"w{k}").to_numpy() for k in range(len(FILTER_BITS))], axis=1) if rows.num_rows else 0
    return out.view(np.uint64)


def passes(table: np.ndarray, node: np.ndarray) -> np.ndarray:
    n = node.view(np.uint64)
    block = ((n >> np.uint64(FILTER_AT)) & np.uint64(len(table) - 1)).astype(np.int64)
    ok = np.ones(len(n), bool)
    for k, at in enumerate(FILTER_BITS):
        ok &= (table[block, k] >> ((n >> np.uint64(at)) & np.uint64(63))) & np.uint64(1) == 1
    return ok



def _fetcher(shared, plain: np.ndarray):
    """Texts to the normalised lines, once a batch, whose node may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                own = Lines(*utf8(batch.column(0).slice(lo, hi - lo)), plain)
                node = own.nodes()
                at = np.flatnonzero(passes(table, node))
                _, one = np.unique(node[at], return_index=True)
                at = at[one]
                raw = own.text.tobytes()
                text = [raw[a:b].decode() for a, b in zip(own.start[own.some[at]].tolist(), own.end[own.some[at]].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(text, pa.string())], names=["node", "norm"])

    return run


def fetched(texts: DataFrame, nodes: DataFrame, plain: np.ndarray = BY_LINE) -> DataFrame:
    """(node, norm): the normalised line of each of the nodes, read from the texts once more."""
    wanted = checkpointed(nodes.select("node").distinct())
    shared = texts.sparkSession.sparkContext.broadcast(wanted_filter(wanted, wanted.count()))
    found = texts.mapInArrow(lean(_fetcher(shared, plain)), "node long, norm string").groupBy("node").agg(F.first("norm").alias("norm"))
    return checkpointed(found.join(wanted, "node"))
