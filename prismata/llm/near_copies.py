"""Near copies of documents by the Jaccard similarity of their word shingles.

A text is the set of its shingles of SHINGLE words (split and lowered as simhash does; a
shorter text is one shingle). Its SimHash has 64 bits, each the majority of that bit over the
shingles' hashes, repeats included; texts of three or fewer differing bits meet at the anchors
of simhash, all of them. The similarity of such texts is computed from the whole texts, shingle
by shingle, and must be SIMILARITY or more. Most pairs of similarity 0.8 differ in more bits
than anchors cover. So texts that share one of BANDS bands of ROWS minima (MinHash) are
candidates, too, unless they are in one group by then: at similarity 0.8 a pair is missed with
a chance of 0.0004. These are compared leaders first, as minhash tells, so a group of near
copies costs its size. Of each connected group the row of the smallest id stays.

Equal sequences of words are one node; texts without words, nulls among them, are one node
too. Very long texts are scanned whole, one at a time. Rows of one id stay or go together;
ties cannot occur, since rows of one id are one document. Rows with a null id stay and link
nothing. Empty tables give empty results. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, simhash
from .common import bound_batches, checkpointed, lean, mixed, powers, slices, utf8
from .components import components
from .nodes import BY_TEXT, fetched, Lines

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 15, 4
#: Places of 32 in which sketches may differ: at similarity 0.8 they differ in 4.8 on average.
CLOSE = minhash.Close(0.0, 14)


def _hashes(own: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): where the shingles of each text with words begin, and all of them."""
    text = own.text
    radix, back = powers(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * radix, out=sums[1:])
    word = (text != 32) & (text != 10)
    before, after = np.zeros(len(text), bool), np.zeros(len(text), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    left, right = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    row = np.searchsorted(own.start[own.some], left, side="right") - 1
    lead = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    count = np.diff(np.append(lead, len(row)))
    shingles = np.maximum(1, count - SHINGLE + 1)
    first = np.cumsum(shingles) - shingles
    at = np.arange(int(shingles.sum())) - np.repeat(first - lead, shingles)
    p, q = left[at], right[np.minimum(at + SHINGLE, np.repeat(lead + count, shingles)) - 1]
    return first, mixed((sums[q] - sums[p]) * back[p] + (q - p).astype(np.uint64))


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each text: a bit is 1 if it is in over half of the shingles' hashes."""
    out = np.zeros(len(first), np.uint64)
    count = np.diff(np.append(first, len(hashes)))
    for k in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(k) & np.uint64(1)).astype(np.int64), first)
        out |= (2 * ones > count).astype(np.uint64) << np.uint64(k)
    return out


def _scanner(parts: int):
    """(id, text) to rows (part, led, blob) of bands, and rows (id, node, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind, turn = minhash.Packer(parts, CLOSE), None, 0
        names = ["part", "led", "blob", "id", "node_of", "fp"]

        def packed(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*minhash.blobs(found), pa.nulls(len(found), kind), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())], names=names)

        for batch in batches:
            kind = batch.schema.types[0]
            for lo, hi in slices(batch.column(1)):
                part, n = batch.slice(lo, hi - lo), hi - lo
                own = Lines(*utf8(part.column(1)), BY_TEXT)
                node = own.nodes()
                whole = np.zeros(n, np.int64)  # no words: node 0
                whole[own.some] = node
                fp = np.zeros(n, np.uint64)
                if len(node):
                    first, hashes = _hashes(own)
                    fp[own.some] = _fingerprints(hashes, first)
                yield pa.RecordBatch.from_arrays([pa.array((turn + np.arange(n)) % parts, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), part.column(0), pa.array(whole), pa.array(fp.view(np.int64), mask=whole == 0)], names=names)
                turn += n
                if len(node):
                    low = minhash.minima(hashes, first, BANDS * ROWS)
                    if found := packer.add(minhash.band_keys(low, ROWS), node, (own.end - own.start)[own.some], minhash.sketches(low)):
                        yield packed(found)
        if found := packer.flush():
            yield packed(found)

    return run


def shingles(norm: str) -> set[tuple[str, ...]]:
    words = norm.split(" ")
    return set(zip(*(words[k:] for k in range(SHINGLE)))) or {tuple(words)}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def _same(both: list[tuple[str, str]]) -> np.ndarray:
    """Which pairs of normalised texts are alike; the shingles of a text are kept while it is the second of pairs."""
    center, own, ok = None, set(), np.zeros(len(both), bool)
    for k, (x, y) in enumerate(both):
        if y != center:
            center, own = y, shingles(y)
        ok[k] = jaccard(shingles(x), own) >= SIMILARITY
    return ok


def _near(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of (fp, node) that join all whose fingerprints are near.

    Where texts of such a chain turn out not to be alike, the bands of minima meet its other pairs.
    """
    texts = checkpointed(texts.distinct())
    one = checkpointed(texts.groupBy("fp").agg(F.min("node").alias("node")))
    equal = texts.join(one.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    return checkpointed(simhash.links(one).unionByName(equal).distinct())


def kept(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document, that of the smallest id, of each group of near copies."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = rows.mapInArrow(lean(_scanner(parts)), f"part int, led boolean, blob binary, id {kind}, node_of long, fp long")
    told = checkpointed(scanned.repartition("part").sortWithinPartitions("part").mapInArrow(lean(minhash.collected(CLOSE)), f"id {kind}, node_of long, fp long, {minhash.CELLS}"))
    cells = told.where("key is not null").select(*minhash.names())
    near = _near(told.where("fp is not null").select("fp", F.col("node_of").alias("node")))
    ends = near.select(F.explode(F.array("a", "b")).alias("node"))
    norms = fetched(rows.select("text"), cells.select("node").unionByName(ends), BY_TEXT)
    first = components(minhash.verified(near, norms, _same))
    roots = minhash.linked(cells, norms, CLOSE, _same, first)
    named = told.where("id is not null").select("id", F.col("node_of").alias("node"))
    first = named.groupBy("node").agg(F.min("id").alias("id")).join(roots, "node", "left")
    stay = first.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("id").alias("id")).select("id").distinct()
    # what goes is less than what stays
    gone = named.select("id").distinct().join(stay, "id", "left_anti").select(F.col("id").alias("_gone")).hint("shuffle_hash")
    names = [f"c{k}" for k in range(len(docs.columns))]
    out = docs.toDF(*names)
    return out.join(gone, out[names[docs.columns.index(id_col)]] == gone["_gone"], "left_anti").toDF(*docs.columns)
