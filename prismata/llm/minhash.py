"""Candidate links from bands of minima (MinHash), without listing the pairs of a band.

A node (a line, a text) has some features; a band is a tuple of their least values under
independent hashes, and nodes that share a band may be alike. Workers pack their bands into
blobs by key range, so that a shuffle moves few rows. In every band a greedy pass links each
node to a leader whose sketch and size allow the similarity (`ok` rows of cells()); these
are verified first and joined to groups. Only pairs of a band that such groups still keep
apart are then listed (rest()), in cells of bounded size. So a large group of variants costs
its size and not the square of it, and no pair is left out. The listed pairs are packed by
tiles of a key; no pair is a row, and a text moves once for all of its pairs in a block.

A key that is frequent in one worker is led there already, and only its leaders travel on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, mixed
from .components import components
from .groups import columns, grid, streamed

#: Rows of a key that one worker leads itself, and rows it holds before it hands them on.
LED = 16
HELD = 1_000_000
#: Rows of a key that are compared with their leaders at once.
PIECE = 2048
#: Rows of (node, root) that may be broadcast.
ROOTS = 500_000
#: Nodes of a key, and their sizes in all, of which the pairs with as many others are told in one block.
TILE, TILE_SIZE = 256, 2 << 20
#: Pairs, and bytes of their texts, that a task verifies at once.
AT_ONCE, AT_ONCE_BYTES = 65_536, 24 << 20
#: A sketch holds two bits of each of so many minima.
SKETCH = 32
_ODD = np.uint64(0x5555555555555555)

_RNG = np.random.default_rng(29)
_DRAW = _RNG.integers(1, 1 << 32, (2, 128), np.uint32)
ROW = np.dtype([("key", "<i8"), ("node", "<i8"), ("size", "<i4"), ("sketch", "<u8")])
PACKED = np.dtype([("key", "<u4"), ("node", "<i8"), ("size", "<u4"), ("sketch", "<u8")])  # the top bit of a size: the key was led in a worker
LINKED = np.dtype([*ROW.descr, ("center", "<i8"), ("ok", "?"), ("open", "?")])
#: Columns of a row that is not of the document kind.
CELLS = "key long, node long, size int, sketch long, center long, ok boolean, open boolean"


def minima(feature: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """For each set of features (they begin at `first`) the least value under each hash."""
    low = np.zeros((len(first), hashes), np.uint32)
    if len(first):
        short = (feature >> np.uint64(32)).astype(np.uint32)
        for k in range(hashes):
            h = (short ^ _DRAW[0, k]) * (_DRAW[1, k] | np.uint32(1))
            h ^= h >> np.uint32(15)
            low[:, k] = np.minimum.reduceat(h, first)
    return low


def band_keys(low: np.ndarray, rows: int, kind: int = 0) -> np.ndarray:
    """A key for each band of `rows` minima; keys of different kinds differ."""
    part = low.reshape(len(low), low.shape[1] // rows, rows).astype(np.uint64)
    out = np.full(part.shape[:2], kind * 1000 + rows, np.uint64) + np.arange(part.shape[1], dtype=np.uint64) * np.uint64(64)
    for k in range(rows):
        out = mixed(out.ravel()).reshape(out.shape) ^ part[:, :, k]
    return mixed(out.ravel()).reshape(out.shape)


def sketches(low: np.ndarray) -> np.ndarray:
    """Two bits of each of the first SKETCH minima; sets of similarity J differ in 3/4 (1 - J) of these pairs."""
    two = mixed(low[:, :SKETCH].ravel()).reshape(-1, SKETCH) & np.uint64(3)
    return np.bitwise_or.reduce(two << (2 * np.arange(SKETCH, dtype=np.uint64)), axis=1) if len(two) else np.zeros(0, np.uint64)


def _places(sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    x = sketch_a ^ sketch_b
    return np.bitwise_count((x | x >> np.uint64(1)) & _ODD)


class Close:
    """Whether sizes and sketches allow a similarity.

    Sketches may differ in `apart` places, those of a pair of up to `small` in size, which have
    few features, in `small_apart`.
    """

    def __init__(self, ratio: float, apart: int, small: int = -1, small_apart: int = 0):
        self.ratio, self.apart, self.small, self.small_apart = ratio, apart, small, small_apart

    def __call__(self, size_a, sketch_a, size_b, sketch_b):
        small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
        return (small >= self.ratio * large - 1e-9) & (_places(sketch_a, sketch_b) <= np.where(large <= self.small, self.small_apart, self.apart))


def _led(rows: np.ndarray, close: Close) -> np.ndarray:
    """The distinct rows of one key, in LINKED form: each near one points to its leader.

    Rows are led in pieces; the leaders of all pieces are led once more.
    """
    out = np.zeros(len(rows), LINKED)
    for name in ROW.names:
        out[name] = rows[name]
    out["center"], out["open"] = out["node"], True
    left = np.arange(len(rows))
    while len(left):
        leaders = []
        for lo in range(0, len(left), PIECE):
            rest = left[lo : lo + PIECE]
            while len(rest):
                c, rest = rest[0], rest[1:]
                leaders.append(c)
                near = close(out["size"][rest], out["sketch"][rest], out["size"][c], out["sketch"][c])
                out["center"][rest[near]] = out["node"][c]
                out["ok"][rest[near]] = True
                rest = rest[~near]
        if len(left) <= PIECE or len(leaders) > len(left) // 2:
            break
        left = np.array(leaders)
    return out


def _led_together(rows: np.ndarray, count: np.ndarray, close: Close) -> np.ndarray:
    """The same for the rows of many keys, so many each, up to PIECE: a round finds a leader of every key."""
    out = np.zeros(len(rows), LINKED)
    for name in ROW.names:
        out[name] = rows[name]
    out["center"], out["open"] = out["node"], True
    size, sketch = np.ascontiguousarray(rows["size"]), np.ascontiguousarray(rows["sketch"])
    left, group = np.arange(len(rows)), np.repeat(np.arange(len(count)), count)
    while len(left):
        new = np.append(True, group[1:] != group[:-1])
        lead = left[new][np.cumsum(new) - 1]
        near = close(size[left], sketch[left], size[lead], sketch[lead])
        at = left[near & ~new]
        out["center"][at], out["ok"][at] = out["node"][lead[near & ~new]], True
        near |= new
        left, group = left[~near], group[~near]
    return out


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of some keys, and the bounds of equal ones in it."""
    order = np.argsort(key)
    own = key[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return order, np.append(first, len(own))


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows by (key, node), sorted, and the bounds of their keys."""
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    rows = rows[new]
    first = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1])) if len(rows) else np.zeros(0, np.int64)
    return rows, np.append(first, len(rows))


class Packer:
    """Collects the bands of one worker's nodes and packs them by the part of their key."""

    def __init__(self, parts: int, close: Close):
        self.parts, self.close, self.rows, self.count = parts, close, [], 0

    def add(self, keys: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> list[tuple[int, bool, bytes]]:
        """Keys are a matrix, one row a node."""
        part = keys % np.uint64(self.parts)
        self.rows.append(((part << np.uint64(32) | keys >> np.uint64(32)).ravel().view(np.int64), np.full(len(keys), keys.shape[1]), node, size, sketch))
        self.count += keys.size
        return self.flush() if self.count >= HELD else []

    def flush(self) -> list[tuple[int, bool, bytes]]:
        if not self.count:
            return []
        key, bands, node, size, sketch = (np.concatenate(x) for x in zip(*self.rows))
        self.rows, self.count = [], 0
        order, bounds = _sorted(key)
        key, owner = key[order], np.repeat(np.arange(len(node)), bands)[order]
        rows = np.empty(len(key), PACKED)
        rows["key"] = key.view(np.uint64) & np.uint64(0xFFFFFFFF)
        for name, column in (("node", node), ("size", size), ("sketch", sketch)):
            rows[name] = column[owner]
        stay, out = np.ones(len(rows), bool), []
        for g in np.flatnonzero(np.diff(bounds) > LED).tolist():
            lo, hi = int(bounds[g]), int(bounds[g + 1])
            of = np.zeros(hi - lo, ROW)
            for name in ROW.names:
                of[name] = key[lo] if name == "key" else rows[name][lo:hi]
            own, _ = _grouped(of)
            led = _led(own, self.close)
            stay[lo:hi] = False
            lead = np.flatnonzero(~led["ok"])
            for name in PACKED.names[1:]:
                rows[name][lo : lo + len(lead)] = own[name][lead]
            rows["size"][lo : lo + len(lead)] |= np.uint32(1 << 31)
            stay[lo : lo + len(lead)] = True
            out.append((int(rows["node"][lo] % self.parts), True, led.tobytes()))
        if out:
            rows, key = rows[stay], key[stay]
        part = key >> 32  # rows are sorted by key, so by part too
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(rows) else np.zeros(0, np.int64)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(rows)]):
            out.append((int(part[lo]), False, rows[lo:hi].tobytes()))
        return out


def blobs(found: list[tuple[int, bool, bytes]]) -> list[pa.Array]:
    """Columns part, led and blob."""
    part, led, blob = zip(*found) if found else ((), (), ())
    return [pa.array(part, pa.int32()), pa.array(led, pa.bool_()), pa.array(blob, pa.binary())]


def _emitted(rows: np.ndarray) -> pa.RecordBatch:
    take = lambda name, kind=None: pa.array(np.ascontiguousarray(rows[name]) if kind is None else np.ascontiguousarray(rows[name]).view(kind))
    return pa.RecordBatch.from_arrays([take("key"), take("node"), take("size"), take("sketch", np.int64), take("center"), take("ok"), take("open")], names=names())


def _part(part: int, held: list[bytes], close: Close) -> Iterator[pa.RecordBatch]:
    packed = np.concatenate([np.frombuffer(b, PACKED) for b in held])
    # most keys stand alone and lead to nothing
    order, bounds = _sorted(np.ascontiguousarray(packed["key"]))
    count = np.diff(bounds)
    packed = packed[order[np.repeat(count > 1, count) | (packed["size"][order] >> 31 > 0)]]
    rows = np.zeros(len(packed), ROW)
    rows["key"] = packed["key"].astype(np.int64) | np.int64(part) << 32
    for name in PACKED.names[1:]:
        rows[name] = packed[name].view(ROW[name])
    rows, bounds = _grouped(rows)
    if not len(rows):
        return
    frequent = rows["size"] < 0
    rows["size"] &= 0x7FFFFFFF
    # most keys are all close to their first row
    first, count = bounds[:-1], np.diff(bounds)
    lead = np.repeat(first, count)
    near = close(rows["size"], rows["sketch"], rows["size"][lead], rows["sketch"][lead])
    whole = np.logical_and.reduceat(near, first)
    more = np.logical_or.reduceat(frequent, first)
    easy = np.repeat(whole & (count > 1), count)
    out = np.zeros(int(easy.sum()), LINKED)
    for name in ROW.names:
        out[name] = rows[name][easy]
    out["center"] = rows["node"][lead][easy]
    out["ok"] = out["center"] != out["node"]
    out["open"] = np.repeat((count > 2) | more, count)[easy]  # of two rows there is one pair only
    all_led = [out]
    for g in np.flatnonzero(~whole & (count > PIECE)).tolist():
        all_led.append(_led(rows[bounds[g] : bounds[g + 1]], close))
    # two rows that are not close lead to nothing
    odd = ~whole & (count <= PIECE) & ((count > 2) | more) | more & (count == 1)
    led = _led_together(rows[np.repeat(odd, count)], count[odd], close)
    some = np.logical_or.reduceat(led["ok"], np.cumsum(count[odd]) - count[odd]) if len(led) else np.zeros(0, bool)
    all_led.append(led[np.repeat(some | more[odd], count[odd])])  # of the others all pairs were compared: none is close
    yield _emitted(np.concatenate(all_led))


def collected(close: Close):
    """Map over (part, led, blob, other columns), sorted by part: the cells of each part.

    Rows without a blob are handed on: their other columns, before those of CELLS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        names: list[str] = []
        kinds: list[pa.DataType] = []

        def wide(cells: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(cells.num_rows, k) for k in kinds), *cells.columns], names=[*names, *cells.schema.names])

        for batch in batches:
            names, kinds = batch.schema.names[3:], [f.type for f in list(batch.schema)[3:]]
            blob = batch.column(2)
            plain = batch.filter(blob.is_null())
            if plain.num_rows:
                cells = _emitted(np.zeros(0, LINKED)).schema
                yield pa.RecordBatch.from_arrays([*plain.columns[3:], *(pa.nulls(plain.num_rows, f.type) for f in cells)], names=[*names, *cells.names])
            for p, led, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blob.to_pylist()):
                if b is None:
                    continue
                if led:
                    yield wide(_emitted(np.frombuffer(b, LINKED)))
                    continue
                if p != part and held:
                    yield from map(wide, _part(part, held, close))
                    held = []
                part = p
                held.append(b)
        if held:
            yield from map(wide, _part(part, held, close))

    return run


def names() -> list[str]:
    return [part.split()[0] for part in CELLS.split(", ")]


def completed(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after further links between nodes."""
    more = checkpointed(more)
    if more.isEmpty():
        return roots
    return components(more.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))


def star(cells: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes and their leaders."""
    return cells.where("ok").select(F.greatest("node", "center").alias("a"), F.least("node", "center").alias("b")).distinct()


def _crossing(close: Close):
    def handle(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Close pairs of nodes of different roots, each in the cell of the least key that they share."""
        key, node, root, size, sketch = (t.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
        sketch, probe = sketch.view(np.uint64), t.column(6).to_numpy(zero_copy_only=False)
        keys, led = _padded(t.column(7).combine_chunks()), t.column(8).to_numpy()
        count = np.diff(bounds)
        group = np.repeat(np.arange(len(count)), count)
        cost = np.cumsum(1 / TILE + size / TILE_SIZE)
        tile = (cost - cost[bounds[:-1]][group]).astype(np.int64)
        ask = np.flatnonzero(probe & (count[group] > 1))
        total = np.cumsum(count[group[ask]])
        for part in np.split(ask, np.searchsorted(total, np.arange(500_000, int(total[-1]), 500_000)) if len(ask) else []):
            n = count[group[part]]
            left = np.repeat(part, n)
            right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1][group[part]], n)
            near = np.flatnonzero((root[left] != root[right]) & (node[left] > node[right]) & (led[left] != node[right]) & (led[right] != node[left]))
            left, right = left[near], right[near]
            near = close(size[left], sketch[left], size[right], sketch[right])
            left, right = left[near], right[near]
            once = np.zeros(len(left), bool)
            for lo in range(0, len(left), 20_000):
                x, y = keys[left[lo : lo + 20_000]], keys[right[lo : lo + 20_000]]
                common = ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any(axis=2)
                once[lo : lo + 20_000] = x[np.arange(len(x)), common.argmax(axis=1)] == key[left[lo : lo + 20_000]]
            if once.any():
                yield _blocks(left[once], right[once], group, tile, node, root, size, sketch)

    return handle


def _blocks(left: np.ndarray, right: np.ndarray, group: np.ndarray, tile: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    """Rows (block, node, root, pairs): each node once a block; its first row has the block's pairs, nearest first.

    The pairs of two tiles of a key are together, so a block has far fewer nodes than pairs
    where many of them are near; the pairs of small keys share blocks.
    """
    order = np.lexsort((tile[right], tile[left], group[left]))
    left, right = left[order], right[order]
    new = np.ones(len(left), bool)
    new[1:] = (group[left][1:] != group[left][:-1]) | (tile[left][1:] != tile[left][:-1]) | (tile[right][1:] != tile[right][:-1])
    unit = np.cumsum(new) - 1
    cost = np.minimum(np.bincount(unit, 2 / TILE + (size[left] + size[right]) / TILE_SIZE), 2)
    block = ((np.cumsum(cost) - cost) / 2).astype(np.int64)[unit]
    apart = _places(sketch[left], sketch[right])
    order = np.lexsort((apart, block))
    left, right, block = left[order], right[order], block[order]
    pairs = np.stack([node[left], node[right]], axis=1)
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    # a block is named by its first pair; were two of one name, they would be one block
    name = mixed(pairs[first, 0].view(np.uint64) ^ mixed(pairs[first, 1].view(np.uint64))).view(np.int64)
    out = []
    for k, (lo, hi) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(block)])):
        names, at = np.unique(pairs[lo:hi], return_index=True)
        roots = np.stack([root[left[lo:hi]], root[right[lo:hi]]], axis=1).ravel()[at]
        own = pa.array([pairs[lo:hi].tobytes(), *[None] * (len(names) - 1)], pa.binary())
        out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(names), name[k])), pa.array(names), pa.array(roots), own], names=["block", "node", "root", "pairs"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def _tested(same: Callable[[list[tuple[str, str]]], np.ndarray]):
    def handle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Links (a, b) of whole blocks; a pair that earlier links have joined says nothing new."""
        node, root = t.column(1).to_pylist(), t.column(2).to_pylist()
        text, up = dict(zip(node, t.column(3).to_pylist())), {}
        own = dict(zip(node, root))

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        parts = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in t.column(4).to_pylist() if b is not None]
        for pairs in _dealt(parts):
            left = [(a, b) for a, b in pairs.tolist() if top(own[a]) != top(own[b])]
            if not left:
                continue
            found = [ab for ab, ok in zip(left, same([(text[a], text[b]) for a, b in left])) if ok]
            for a, b in found:
                up[top(own[a])] = top(own[b])
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= AT_ONCE or size >= AT_ONCE_BYTES:
                t = pa.Table.from_batches(held)
                block = t.column(0).to_numpy()
                last = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
                if last:
                    yield from handle(t.slice(0, last))
                held = t.slice(last).combine_chunks().to_batches()
                rows, size = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
        if rows:
            yield from handle(pa.Table.from_batches(held))

    return run


def _dealt(parts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The pairs of some blocks in pieces of about AT_ONCE, the first ones of every block first."""
    share = max(64, AT_ONCE // max(1, len(parts)))
    held, rows = [], 0
    for lo in range(0, max(map(len, parts), default=0), share):
        for x in parts:
            if len(x) > lo:
                held.append(x[lo : lo + share])
                rows += len(held[-1])
                if rows >= AT_ONCE:
                    yield np.concatenate(held)
                    held, rows = [], 0
    if held:
        yield np.concatenate(held)


def _padded(lists: pa.Array) -> np.ndarray:
    """Sorted keys, which are not negative, as the rows of a matrix that ends in -1."""
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    size = lists.value_lengths().to_numpy()
    out = np.full((len(size), int(size.max())), -1, np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def rest(cells: DataFrame, roots: DataFrame, close: Close) -> DataFrame:
    """The close pairs of a band whose ends have different roots, in blocks (see _blocks).

    roots holds (node, root) of the nodes that have links.
    """
    # 16 bytes a row: few roots need no second shuffle of the cells
    small = F.broadcast(roots) if roots.count() <= ROOTS else roots
    led = F.when(F.col("ok"), F.col("center")).otherwise(F.col("node")).alias("led")
    named = cells.where("open").join(small, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "size", "sketch", led)
    mixed_keys = named.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("key")
    open_rows = checkpointed(named.join(mixed_keys, "key", "left_semi"))
    keys = open_rows.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # a node has few
    salt: Column = F.xxhash64("node")
    dealt = grid(open_rows.join(keys, "node"), "key", salt, F.lit(True)).select("key", "cell", "node", "root", "size", "sketch", "probe", "keys", "led")
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "root")
    handle = _crossing(close)
    return checkpointed(dealt.mapInArrow(lean(lambda b: streamed(b, columns(0, 1), handle)), "block long, node long, root long, pairs binary"))


def _alike(same: Callable[[list[tuple[str, str]]], np.ndarray]):
    """Of pairs (a, b, x, y) with their texts, those whose texts are alike; many at once, since that is faster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ok = pa.array(same(list(zip(table.column(2).to_pylist(), table.column(3).to_pylist()))), pa.bool_())
            kept = table.select([0, 1]).filter(ok).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(c.to_numpy()) for c in kept.columns], names=kept.column_names)

        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= AT_ONCE or size >= AT_ONCE_BYTES:
                yield told(held)
                held, rows, size = [], 0, 0
        if rows:
            yield told(held)

    return run


def verified(pairs: DataFrame, norms: DataFrame, same) -> DataFrame:
    """The pairs (a, b), one or few a node, that do link."""
    x, y = norms.select(F.col("node").alias("a"), F.col("norm").alias("x")), norms.select(F.col("node").alias("b"), F.col("norm").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(_alike(same)), "a long, b long")


def tested(blocks: DataFrame, norms: DataFrame, same) -> DataFrame:
    """Links (a, b) that join what the pairs of some blocks join: a text moves once a block, not once a pair."""
    met = blocks.join(norms, "node").select("block", "node", "root", "norm", "pairs").repartition("block").sortWithinPartitions("block")
    return met.mapInArrow(lean(_tested(same)), "a long, b long")


def linked(cells: DataFrame, norms: DataFrame, close: Close, same, roots: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that link to another one.

    `same` says of some pairs of norms which ones link. Leaders come first, then the pairs
    between different groups, nearest first. roots holds (node, root) of what is already linked.
    """
    led = star(cells)
    if roots is None:
        roots = components(verified(checkpointed(led), norms, same))
    else:
        x, y = roots.select(F.col("node").alias("a"), F.col("root").alias("_a")), roots.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        led = led.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
        roots = completed(roots, verified(checkpointed(led), norms, same))
    return completed(roots, tested(rest(cells, roots, close), norms, same))


__all__ = ["CELLS", "Close", "Packer", "band_keys", "blobs", "collected", "completed", "linked", "minima", "names", "rest", "sketches", "star", "tested", "verified"]
