"""Benchmark decontamination with a word-level FM-index over each training shard.

A shard is one Arrow batch of documents. Its text for the index is every maximal run of
words that occur somewhere in the benchmark and that is long enough to hold the shortest
test phrase; no other word can be part of an occurrence. The runs are suffix-sorted by
rank doubling, their Burrows-Wheeler transform goes into a wavelet matrix, and all test
phrases are searched backward at once. Occurrences come from suffix positions sampled at
every eighth word and at every run border, reached by LF steps, and merge into spans.

The benchmark is read in blocks of bounded size; each block is one more map over the
documents, with a checkpoint before it, so neither a shuffle nor an unbounded broadcast
occurs and a task holds one block at a time.

Nulls: a null text has no words, a null benchmark text no phrases; a null item id is
reported as an empty string. Empty tables give empty results or all-clean documents.
Repeated rows are judged each on its own; of items that share a window all are reported.
Very long texts are searched whole. Other columns of either table are not touched; in
find(), one that is named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, lean, renamed, slices, utf8, Words

WINDOW = 10
SAMPLE = 8
#: Benchmark text, in bytes, whose phrases are broadcast at once.
BLOCK_BYTES = 16 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Phrases:
    """The test phrases of one benchmark block: distinct word sequences and their items."""

    def __init__(self, items: list[str], texts: pa.Array, window: int = WINDOW):
        data, offsets = utf8(texts)
        words = Words(data, offsets)
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        bounds = np.searchsorted(words.row, np.arange(len(items) + 1))
        count = np.diff(bounds)
        windows = np.where(count > 0, np.maximum(1, count - window + 1), 0)
        item = np.repeat(np.arange(len(items)), windows)
        first = bounds[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        length = np.minimum(count[item], window)
        at = first[:, None] + np.arange(-window, 0) + length[:, None]  # right-aligned
        held = np.arange(window)[None, :] >= window - length[:, None]
        rows = np.where(held, ids[np.where(held, at, 0)] + 1, 0).astype(np.int32) if len(item) else np.zeros((0, window), np.int32)
        self.words, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.length = (self.words > 0).sum(axis=1).astype(np.int64)
        #: The items of phrase p are those numbered owner[own[p] : own[p + 1]].
        pairs = np.unique(which.ravel().astype(np.int64) * max(1, len(items)) + item)
        self.names, self.owner = items, (pairs % max(1, len(items))).astype(np.int32)
        self.own = np.searchsorted(pairs // max(1, len(items)), np.arange(len(self.words) + 1))
        self.shortest = int(self.length.min()) if len(self.words) else window
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def items(self, phrase: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.own[phrase] : self.own[phrase + 1]].tolist()]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """1-based vocabulary number of each hash, 0 if it is no benchmark word."""
        out = np.zeros(len(h), np.int64)
        if len(self.vocabulary):
            at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            k = np.searchsorted(self.vocabulary, h[at])
            k[k == len(self.vocabulary)] = 0
            out[at] = np.where(self.vocabulary[k] == h[at], k + 1, 0)
        return out


class FMIndex:
    """FM-index over integer symbols; 0 separates runs and is never part of a pattern."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text, 0) if not len(text) or text[-1] else text
        n = len(text)
        order = self._sorted(text)
        before = text[order - 1]
        self.sigma = int(text.max()) + 1
        self.below = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.below[1:])
        self.bits = max(1, int(self.sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        row = before
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(n - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.before = before
        marked = (order % sample == 0) | (before == 0)  # LF steps don't cross a separator
        self.marked = marked
        self.position = np.where(marked, order, -1)

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """Suffix order by rank doubling; each separator is a symbol of its own."""
        n = len(text)
        gaps = text == 0
        first = np.where(gaps, np.cumsum(gaps) - 1, text + int(gaps.sum()))
        _, rank = np.unique(first, return_inverse=True)
        h = 1
        while True:
            key = rank * np.int64(n + 1)
            key[: n - h] += rank[h:] + 1
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
            rank, h = new, 2 * h
            if rank[order[-1]] == n - 1 or h >= n:
                return order

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands in the first i places of the transform."""
        low = np.zeros(len(c), np.int64)
        at = i.astype(np.int64)
        for level, zeros, b in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            one = ((c >> b) & 1).astype(bool)
            a, z = level[at].astype(np.int64), level[low].astype(np.int64)
            at = np.where(one, zeros + a, at - a)
            low = np.where(one, zeros + z, low - z)
        return at - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of right-aligned patterns: (pattern, low, high) of those found."""
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.before), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = patterns.shape[1] if len(patterns) else 0
        for k in range(width):
            c = patterns[live, width - 1 - k]
            ok = c < self.sigma
            live, lo, hi, c = live[ok], lo[ok], hi[ok], c[ok]
            lo, hi = self.below[c] + self.rank(c, lo), self.below[c] + self.rank(c, hi)
            ok = hi > lo
            live, lo, hi = live[ok], lo[ok], hi[ok]
            over = lengths[live] == k + 1
            if over.any():
                done.append((live[over], lo[over], hi[over]))
                live, lo, hi = live[~over], lo[~over], hi[~over]
            if not len(live):
                break
        if not done:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*done))  # type: ignore[return-value]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by LF steps to a sampled one."""
        out = np.full(len(rows), -1, np.int64)
        at, todo, steps = rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            hit = self.marked[at]
            out[todo[hit]] = self.position[at[hit]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.before[at]
            at = self.below[c] + self.rank(c, at)
            steps += 1
        return out


class _Shard:
    """The words of one batch that may belong to an occurrence, and what is found in them."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.counts = phrases, [], []

    def add(self, data: np.ndarray, offsets: np.ndarray, first_row: int) -> None:
        words = Words(data, offsets)
        rows = len(offsets) - 1
        self.counts.append(np.bincount(words.row, minlength=rows))
        ids = self.phrases.ids(words.hash)
        breaks = np.ones(len(ids) + 1, bool)
        if len(ids):
            same = (ids[1:] > 0) == (ids[:-1] > 0)
            breaks[1:-1] = ~(same & (words.row[1:] == words.row[:-1]))
        edge = np.flatnonzero(breaks)
        size = np.diff(edge)
        keep = (size >= self.phrases.shortest) & (ids[edge[:-1]] > 0) if len(size) else np.zeros(0, bool)
        chosen = np.repeat(keep, size)
        run = np.repeat(np.cumsum(keep), size)[chosen]
        base = np.searchsorted(words.row, np.arange(rows))
        ordinal = (np.arange(len(ids)) - base[words.row])[chosen] if len(ids) else np.zeros(0, np.int64)
        own = offsets[words.row[chosen]]
        self.parts.append((ids[chosen], run, words.row[chosen] + first_row, ordinal, words.start[chosen] - own, words.end[chosen] - own))

    def found(self) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], dict[int, set[str]]]:
        """Word counts; by row the hit words (ordinal, byte bounds); by row the items."""
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        if not self.parts or not sum(len(p[0]) for p in self.parts):
            return counts, {}, {}
        lead, runs = 0, []
        for p in self.parts:
            runs.append(p[1] + lead)
            lead += int(p[1][-1]) if len(p[1]) else 0
        ids, row, ordinal, start, end = (np.concatenate([p[k] for p in self.parts]) for k in (0, 2, 3, 4, 5))
        place = np.arange(len(ids)) + np.concatenate(runs) - 1  # a separator after each run
        text = np.zeros(int(place[-1]) + 2, np.int64)
        text[place] = ids
        back = np.full(len(text), -1, np.int64)
        back[place] = np.arange(len(ids))
        index = FMIndex(text)
        which, lo, hi = index.search(self.phrases.words, self.phrases.length)
        if not len(which):
            return counts, {}, {}
        size = hi - lo
        rows = np.repeat(lo, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        which = np.repeat(which, size)
        at = back[index.locate(rows)]
        delta = np.zeros(len(ids) + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + self.phrases.length[which], -1)
        hit = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
        spans, items = {}, {}
        for part in np.split(hit, np.flatnonzero(np.diff(row[hit])) + 1):
            spans[int(row[part[0]])] = (ordinal[part], start[part], end[part])
        pairs = np.unique(row[at] * np.int64(len(self.phrases.length)) + which)
        for pair in pairs.tolist():
            r, w = divmod(pair, len(self.phrases.length))
            items.setdefault(r, set()).update(self.phrases.items(w))
        return counts, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mapper(shared, text_at: int, first: bool):
    """One pass: adds the hits of one benchmark block to the trailing found columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = shared.value
            shard, column = _Shard(phrases), batch.column(text_at)
            for lo, hi in slices(column):
                shard.add(*utf8(column.slice(lo, hi - lo)), lo)
            counts, spans, items = shard.found()
            n = batch.num_rows
            old_spans = [None] * n if first else batch.column(batch.num_columns - 2).to_pylist()
            old_items = [None] * n if first else batch.column(batch.num_columns - 1).to_pylist()
            new_spans, new_items = [], []
            for i in range(n):
                own = [(s["start"], s["end"]) for s in old_spans[i] or ()]
                if i in spans:
                    words = spans[i][0]
                    cut = np.flatnonzero(np.diff(words) > 1)
                    own += zip(words[np.append(0, cut + 1)].tolist(), (words[np.append(cut, len(words) - 1)] + 1).tolist())
                new_spans.append([{"start": a, "end": b} for a, b in _merged(own)])
                new_items.append(sorted({*(old_items[i] or ()), *items.get(i, ())}))
            keep = list(batch.columns[: -3 if not first else None])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [*keep, pa.array(counts, pa.int64()), pa.array(new_spans, kind), pa.array(new_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of `docs` as c0, c1, ..., then n_words, word_spans and items."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    text_at = docs.columns.index(text)
    out = docs
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toArrow()
        column = part.column("t").combine_chunks()
        shared = spark.sparkContext.broadcast(Phrases(part.column("i").to_pylist(), column if isinstance(column, pa.Array) else column.chunk(0), window))
        schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], T.StructField(f"c{len(docs.columns)}", T.LongType()), T.StructField(f"c{len(docs.columns) + 1}", SPANS), T.StructField(f"c{len(docs.columns) + 2}", T.ArrayType(T.StringType()))])
        if b:
            out = checkpointed(out)  # else a task would hold a worker and a block for each pass
        out = out.mapInArrow(lean(_mapper(shared, text_at, b == 0)), schema)
    return out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """`docs` with n_words, word_spans (merged, half-open word ordinals) and items.

    items holds the ids, as sorted strings, of the benchmark items of which a window of
    `window` consecutive words (or the whole item, if shorter) occurs in the document.
    """
    return renamed(_found(docs, benchmark, text, **how), docs, "n_words", "word_spans", "items")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _removing(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist()
            for i, own in enumerate(spans):
                if own:
                    bounds = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]))]
                    kept, at = [], 0
                    for s in own:
                        kept.append(texts[i][at : bounds[s["start"]][0]])
                        at = bounds[s["end"] - 1][1]
                    texts[i] = "".join([*kept, texts[i][at:]])
            cols = [pa.array(texts, pa.string()) if k == text_at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """`docs` with every contaminated span cut out of the text; all rows stay."""
    found, width = _found(docs, benchmark, text, **how), len(docs.columns)
    return found.mapInArrow(lean(_removing(docs.columns.index(text), width + 1)), found.schema).select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)])


def digest(found: DataFrame) -> DataFrame:
    """The per-document report of the query, from what find() returns."""
    hits = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain reference result for small inputs: (doc_id, n_words, n_hit, n_items, sha, flag)."""
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple[str, ...], set[str]] = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, t in docs:
        w = low(t)
        hit, own = set(), set()
        for k in range(len(w)):
            for size in sizes:
                if (got := windows.get(tuple(w[k : k + size]))) and k + size <= len(w):
                    hit.update(range(k, k + size))
                    own |= got
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out
