"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; each is the majority of that bit over the hashes of a text's
word shingles. Two fingerprints link at THRESHOLD = 3 or fewer differing bits, so one of
their 32-bit halves differs in one bit at most. The anchors of a half are the codewords of
the Hamming code of length 31 (the half's top bit is left out): its covering radius is 1,
so each half has one home anchor within distance 1, and a copy of it goes to every anchor
within 1 + 1 = 2, of which there are 16. Of two linked fingerprints, one's home is thus
among the other's anchors in at least one half; all 64 bits are compared there.

Only distinct fingerprints are replicated, so exact copies never meet pairwise. In each
anchor's cell a union-find keeps links that join two groups; the others say nothing new.

Nulls: a null text has no words and the fingerprint zero; rows with a null id get a
component but never name it. Empty tables give empty results, repeated rows one row each.
Very long texts are hashed whole; ties cannot occur, a component is named by its smallest
id. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, lean
from .components import components
from .groups import columns, grid, streamed

THRESHOLD = 3
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    one = xxhash.xxh64_intdigest
    h = np.array([one(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        total += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row, fp signed."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return rows.mapInArrow(lean(run), T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def _pairs_of(syndrome: int) -> list[int]:
    """Bit patterns that lead from a word of this syndrome to the codewords within distance 2."""
    if not syndrome:
        return [0]
    return [1 << (syndrome - 1)] + [1 << (a - 1) | 1 << ((a ^ syndrome) - 1) for a in range(1, 32) if a < a ^ syndrome]


def anchors(half: Column) -> Column:
    """The anchors within distance 2 of a half's low 31 bits, its home first."""
    x = half.bitwiseAND(F.lit((1 << 31) - 1))
    syndrome = F.lit(0)
    for i in range(5):
        mask = sum(1 << (j - 1) for j in range(1, 32) if j >> i & 1)
        syndrome = syndrome + F.bit_count(x.bitwiseAND(F.lit(mask))) % 2 * (1 << i)
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in _pairs_of(s)]) for s in range(32)])
    return F.transform(F.element_at(table, syndrome + 1), lambda m: x.bitwiseXOR(m))


def _linked(threshold: int):
    def handle(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = t.column(2).to_numpy().view(np.uint64)
        node, home = t.column(3).to_numpy(), t.column(4).to_numpy(zero_copy_only=False)
        out_a, out_b = [], []
        size = np.diff(bounds)
        homes = np.add.reduceat(home.astype(np.int64), bounds[:-1])
        # small groups: every home row against every row of its group, at once
        small = np.flatnonzero((size > 1) & (size <= 64) & (homes > 0))
        group_of = np.repeat(np.arange(len(size)), size)
        chosen = np.zeros(len(size), bool)
        chosen[small] = True
        probe = np.flatnonzero(home & chosen[group_of])
        for part in np.array_split(probe, max(1, len(probe) // 20_000)):
            n = size[group_of[part]]
            left = np.repeat(part, n)
            right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1][group_of[part]], n)
            near = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (node[left] != node[right])
            out_a.append(np.maximum(node[left[near]], node[right[near]]))
            out_b.append(np.minimum(node[left[near]], node[right[near]]))
        for g in np.flatnonzero((size > 64) & (homes > 0)).tolist():
            lo, hi = int(bounds[g]), int(bounds[g + 1])
            own, names = fp[lo:hi], node[lo:hi]
            _, label = np.unique(names, return_inverse=True)  # a row and its own copy are one
            for i in np.flatnonzero(home[lo:hi]).tolist():
                near = np.flatnonzero(np.bitwise_count(own ^ own[i]) <= threshold)
                marks, at = np.unique(label[near], return_index=True)
                other = marks != label[i]
                if other.any():
                    out_a.append(np.full(int(other.sum()), names[i]))
                    out_b.append(names[near[at[other]]])
                    label[np.isin(label, marks)] = label[i]
        if out_a:
            pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return handle


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Spanning links (a, b) between the nodes of distinct fingerprints (fp, node) that are near.

    The anchors cover THRESHOLD differing bits; a larger threshold is refused.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"anchors cover {THRESHOLD} differing bits, not {threshold}")
    both = [F.shiftrightunsigned("fp", 32), F.col("fp")]
    rows = None
    for k, half in enumerate(both):
        own = nodes.select("fp", "node", F.posexplode(anchors(half)).alias("at", "anchor"))
        own = own.select((F.col("anchor") + F.lit(k << 32)).alias("key"), "fp", "node", (F.col("at") == 0).alias("home"))
        rows = own if rows is None else rows.unionByName(own)
    cells = grid(rows, "key", F.xxhash64("fp"), F.col("home"))
    dealt = cells.select("key", "cell", "fp", "node", "probe").repartition("key", "cell").sortWithinPartitions("key", "cell")
    handle = _linked(threshold)
    return dealt.mapInArrow(lean(lambda b: streamed(b, columns(0, 1), handle)), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(id, fingerprint, component_id) of every row: the smallest id reachable over links."""
    fps = checkpointed(fingerprints(docs, id_col, text, shingle))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("node")))
    roots = components(links(nodes.where("node is not null"), threshold))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = fps.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """`docs` with one document, that of the smallest id, of each group."""
    found = groups(docs, id_col, text, **how)
    stay = found.where(F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id"))).select(F.col(id_col).alias("_id")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_id"]), "left_semi")
