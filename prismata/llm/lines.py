"""Fuzzy line deduplication.

A line is normalised to its lower-cased words (0-9, a-z, letters beyond ASCII), joined by
single spaces; its XXH64 names its node, so equal normalised lines, however short, are one
node. Lines without words are left alone. Nodes of MIN_WORDS words or MIN_CHARS characters
or more are also compared with each other: those that share a band of minima of their
features are candidates, and two of them link if their edit similarity, 1 - distance /
longer length, is SIMILARITY or more. Features are the pairs of neighbouring words, in lines
of up to SHORT[1] words the single telling words, and in lines of long words (scripts without
spaces) all runs of GRAM bytes. Of each connected group the first occurrence, by (id, line
number), stays; all others are cut from their texts.

Candidates are compared leaders first, so a group of near variants costs about its size (see
minhash). Only lines that share a band with another one are fetched for that, through a
bounded filter. Occurrences of a frequent line are pre-aggregated, and its cuts are found by
a broadcast of the few frequent nodes.

Nulls: a null text stays null and has no lines; null ids are ordered first. Very long texts
are scanned whole, one at a time. Ties cannot occur: (id, line, hash of the text) is unique
but for repeated rows (same id, same text), which count as one document and are cut alike. A
text whose lines all go becomes empty. Empty tables give empty results. Other columns pass
through unchanged, whatever their names; if counts are asked for, n_lines and n_removed take
the place of columns so named.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minhash
from .common import bound_batches, checkpointed, lean, mixed, powers, renamed, slices, stored, utf8
from .nodes import BY_LINE, fetched, Lines, passes, wanted_filter

MIN_WORDS = 5
#: Characters from which a line of fewer words, as in scripts without spaces, is long enough too.
MIN_CHARS = 20
SIMILARITY = 0.8
#: Lines of up to SHORT[1] words are compared by their words, those of SHORT[0] or more by
#: pairs of words; lines of similar lengths meet under one of the two.
SHORT = (12, 15)
#: Bytes of a telling word; lines of SHORT[1] words or less that have so many such words are
#: compared by these alone, since the frequent short words make unrelated lines alike.
TELLING, TELLING_WORDS = 5, 4
#: Mean bytes of a word from which runs of GRAM bytes are a line's features.
LONG_WORD, GRAM = 20, 6
#: Bands of a node, and minima of a band: three in lines of few words, four in others.
BANDS, FEW_ROWS, ROWS = 12, 3, 4
#: Places of 32 in which the sketches of candidates may differ: 12 on average where half of all
#: features are common, 24 between unrelated lines.
APART = 12
#: The same for pairs of up to so many characters, whose similarity is rough.
FEW_CHARS, FEW_APART = 80, 14
CLOSE = minhash.Close(SIMILARITY, APART, FEW_CHARS, FEW_APART)
#: Pairs whose distances are found at once, and bytes of their bit masks.
PAIRS, PEQ_BYTES = 2048, 24 << 20
#: Characters from which a bound of the distance is tried first, and from which a pair is
#: handled alone, on whole numbers of any length.
BOUNDED, ALONE = 150, 1600
#: Pairs for which that bound is tried in any case.
TRIES = 64
#: Pairs under which a piece is handled one by one, too.
FEW_PAIRS = 24
#: Characters of the runs that are counted before distances are found, and bytes counted at once.
RUN, COUNTED = 3, 4 << 20
#: Nodes that a task remembers to have handed on.
SEEN = 200_000
#: Occurrences from which a line is frequent, and frequent nodes that may be broadcast.
FREQUENT, FREQUENT_NODES = 4096, 500_000



def _features(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature (kind, line, size, first, hashes) of the long enough lines.

    start and end are the bounds of lines in normalised text; sizes are characters.
    """
    n = len(text)
    if not len(start):
        return
    radix, back = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * radix, out=sums[1:])
    runs = lambda p, q: mixed((sums[q] - sums[p]) * back[p] + (q - p).astype(np.uint64))
    letter = text > 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edge = np.concatenate([[0] * bool(letter[0]), edge, [n] * bool(letter[-1])]).astype(np.int64)
    left, right = edge[::2], edge[1::2]
    # words of the given lines only; no word crosses the bounds of a line
    first, words = np.searchsorted(left, start), np.searchsorted(left, end)
    words -= first
    line = np.repeat(np.arange(len(start)), words)
    if len(line) < len(left):
        at = np.arange(len(line)) + np.repeat(first - np.cumsum(words) + words, words)
        left, right = left[at], right[at]
    inner = np.flatnonzero((text & 0xC0) == 0x80)  # bytes within a character
    size = end - start - (np.searchsorted(inner, end) - np.searchsorted(inner, start))
    enough = (words >= MIN_WORDS) | (size >= MIN_CHARS)
    dense = enough & (end - start >= LONG_WORD * words)
    short, long = enough & ~dense & (words <= SHORT[1]), enough & ~dense & (words >= SHORT[0])

    def kind(number: int, of: np.ndarray, line: np.ndarray, hashes: np.ndarray):
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        return number, line[first], size[line[first]], first, hashes

    telling = right - left >= TELLING
    count = np.bincount(line, weights=telling, minlength=len(start))
    few = count < TELLING_WORDS
    named = runs(left, right)
    for number, of in ((0, short), (1, long)):
        at = np.flatnonzero(of[line] & (telling | few[line]))
        yield kind(number, of, line[at], named[at])
    # an edit may take or give a telling word: about the limit, lines meet by all their words, too
    about = short & ~few & (count <= TELLING_WORDS + 1)
    at = np.flatnonzero(about[line])
    yield kind(0, about, line[at], named[at])
    if dense.any():
        at = np.flatnonzero((text & 0xC0) != 0x80)
        of = np.searchsorted(start, at, side="right") - 1
        own = (of >= 0) & (at < end[of]) & dense[of]
        at, of = at[own], of[own]
        yield kind(2, dense, of, runs(at, np.minimum(at + GRAM, end[of])))


def _scanner(parts: int):
    """(id, th, text) to rows (part, led, blob) of bands, and rows (id, th, nodes) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen, turn = minhash.Packer(parts, CLOSE), set(), 0
        kinds = None

        def packed(found: list) -> pa.RecordBatch:
            columns = minhash.blobs(found)
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(found), kinds[0]), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.list_(pa.int64()))], names=["part", "led", "blob", "id", "th", "nodes"])

        for batch in batches:
            kinds = batch.schema.types
            for lo, hi in slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                own = Lines(*utf8(part.column(2)))
                node = own.nodes()
                whole, named = np.zeros(len(own.start), np.int64), np.zeros(len(own.start), bool)
                whole[own.some], named[own.some] = node, True
                listed = pa.ListArray.from_arrays(pa.array(own.first, pa.int32()), pa.array(whole, mask=~named))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array((turn + np.arange(n)) % parts, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), part.column(0), part.column(1), listed], names=["part", "led", "blob", "id", "th", "nodes"])
                turn += n
                _, one = np.unique(node, return_index=True)
                one = np.sort(one)
                one = one[[x not in seen for x in node[one].tolist()]] if len(one) else one
                seen = seen if len(seen) < SEEN else set()
                seen.update(node[one].tolist())
                at = own.some[one]
                for kind, line, size, first, hashes in _features(own.text, own.start[at], own.end[at]):
                    width = FEW_ROWS if kind == 0 else ROWS
                    low = minhash.minima(hashes, first, BANDS * width)
                    found = packer.add(minhash.band_keys(low, width, kind), node[one][line], size, minhash.sketches(low)) if len(line) else []
                    if found:
                        yield packed(found)
        found = packer.flush()
        if found:
            yield packed(found)

    return run


def _common(a: str, b: str) -> int:
    if a[:1] != b[:1]:
        return 0
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Two strings without their common ends."""
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    return a[: len(a) - k], b[: len(b) - k]


def distance(a: str, b: str) -> int:
    """Edit distance; bit-parallel over the shorter string, without the common ends."""
    a, b = _trimmed(a, b)
    if len(a) > len(b):
        a, b = b, a
    return _steps(a, b) if a else len(b)


def _steps(a: str, b: str, room: float = float("inf")) -> int:
    """Edit distance of a, which is not empty, and b; if that is over `room`, maybe only a number over it."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    most = room + len(b)  # a column takes one off at most
    for c in b:
        eq = places.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & full, up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        most -= 1
        if score > most:
            return score - int(most - room)
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~(zero | plus)) & full, plus & zero & full
    return score


def _counted(texts: list[str], run: int, cells: int) -> np.ndarray:
    """How often each text has the runs of so many characters, by a hash of them: a row each."""
    size = np.array([len(x) for x in texts])
    point = _points(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    code = point
    if run > 1:
        n = max(0, len(point) - run + 1)
        code = point[:n].copy()
        for k in range(1, run):
            code = code * np.uint32(0x9E3779B1) + point[k : n + k]
        code = (code ^ code >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(16)
        whole = row[:n] == row[run - 1 :]
        row, code = row[:n][whole], code[whole]
    at = row.astype(np.int64) * cells + (code & np.uint32(cells - 1))
    return np.bincount(at, minlength=len(texts) * cells).astype(np.int32).reshape(len(texts), cells)


def _far(pairs: list[tuple[str, str]], room: np.ndarray) -> np.ndarray:
    """Which pairs are surely further apart than their room, told by counts.

    An edit changes a character of each text, and RUN runs of RUN characters of each. Counts
    of hashes differ by no more than those of what is hashed, so no pair within its room is far.
    """
    size = np.array([(len(a), len(b)) for a, b in pairs]).reshape(-1, 2)
    out = np.abs(size[:, 0] - size[:, 1]) > room
    for run, cells, most in ((1, 64, np.inf), (RUN, 512, BOUNDED)):
        left = np.flatnonzero(~out & (size.max(axis=1, initial=0) <= most))
        total = np.cumsum(size[left].sum(axis=1) + 8 * cells)
        for part in np.split(left, np.searchsorted(total, np.arange(COUNTED, int(total[-1]), COUNTED)) if len(left) else []):
            if not len(part):
                continue
            x, y = (_counted([pairs[k][side] for k in part.tolist()], run, cells) for side in (0, 1))
            apart = np.abs(x - y).sum(axis=1)
            if run == 1:
                out[part] = (apart + np.abs(size[part, 0] - size[part, 1])) / 2 > room[part]
            else:
                out[part] = apart / (2 * run) > room[part]
    return out


def within(pairs: list[tuple[str, str]], room: np.ndarray) -> np.ndarray:
    """Which pairs have an edit distance of `room` or less: bit-parallel, many pairs at once.

    Counts of characters rule out most of the pairs that are not, and cutting common ends off
    decides many others; what is left is handled in pieces of similar length and bounded memory,
    a matrix column for each pair, but for very long ones.
    """
    out = np.zeros(len(pairs), bool)
    hard, tried, told = [], 0, 0
    for k in np.flatnonzero(~_far(pairs, room)).tolist():
        a, b = _trimmed(*pairs[k])
        if len(a) > len(b):
            a, b = b, a
        if len(b) <= room[k]:
            out[k] = True
            continue
        if len(a) > BOUNDED and 4 * told >= tried - TRIES:  # as long as the bound tells some of them
            out[k] = at_most(a, b, room[k]) <= room[k]
            tried, told = tried + 1, told + int(out[k])
        if out[k]:
            continue
        if len(a) > ALONE:
            out[k] = _steps(a, b, room[k]) <= room[k]
        elif a:
            hard.append((k, a, b))
    hard.sort(key=lambda x: (len(x[1]), len(x[2])))
    while hard:
        # pieces are cut from the long end, so that the first pair tells the size of all
        cells = (-(-len(hard[-1][1]) // 64)) * (len({c for _, a, _ in hard[-PAIRS:] for c in a}) + 1)
        part = hard[-max(1, min(PAIRS, PEQ_BYTES // (8 * cells))) :]
        # a short pair is not carried through the columns of a long one
        part = part[bisect.bisect_left(part, 0.7 * len(part[-1][1]), key=lambda x: len(x[1])) :]
        del hard[-len(part) :]
        at = np.array([x[0] for x in part])
        if len(part) < FEW_PAIRS:
            out[at] = [_steps(a, b, room[k]) <= room[k] for k, a, b in part]
        else:
            out[at] = _banded([x[1] for x in part], [x[2] for x in part], room[at])
    return out


#: How many words of each line at_most() tries to skip, the fewest first.
SKIPS = tuple((p, n - p) for n in range(1, 9) for p in range(n + 1))


def at_most(a: str, b: str, room: float = float("inf")) -> int:
    """An upper bound of the edit distance: words are skipped up to the next two that agree; beyond `room` it is not gone on with."""
    x, y = [*a.split(" "), "", ""], [*b.split(" "), "", ""]
    m, n = len(x) - 2, len(y) - 2
    i = j = cost = 0
    while i < m and j < n and cost <= room:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        ahead, words = x[i : i + 10], y[j : j + 10]
        for p, q in SKIPS:
            if i + p < m and j + q < n and ahead[p] == words[q] and ahead[p + 1] == words[q + 1]:
                break
        else:
            p = q = 1
        cost += max(len("".join(ahead[:p])) + p, len("".join(words[:q])) + q)
        i, j = i + p, j + q
    rest = lambda w, k, end: len("".join(w[k:])) + end - k
    return cost + rest(x, i, m) + rest(y, j, n)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


def _banded(short: list[str], long: list[str], room: np.ndarray) -> np.ndarray:
    """Which pairs are at most their room apart: blocks of 64 rows, those near the diagonal only.

    What lies outside the band is taken as its upper bound, so a distance within the room is
    exact. A step takes each block one column on, the upper ones a column ahead of the next,
    whose carries they give, so all blocks are one array. Pairs that are done or surely too far
    apart are left out from time to time.
    """
    n, m, t = len(short), np.array([len(x) for x in short]), np.array([len(x) for x in long])
    words = -(-int(m.max()) // 64)
    # a path of at most `room` edits leaves the diagonal so far only that it can still come back to the last corner
    below, above = int(((room - (t - m)) / 2).max()) + 1, int(((room + (t - m)) / 2).max()) + 1
    chars, code = np.unique(_points(short), return_inverse=True)
    pair, place = np.repeat(np.arange(n), m), np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    where = np.zeros(((len(chars) + 1) * words, n), np.uint64)  # the last character stands for all others
    np.bitwise_or.at(where, (code * words + place // 64, pair), np.uint64(1) << (place % 64).astype(np.uint64))
    there = _points(long)
    at = np.minimum(np.searchsorted(chars, there), len(chars) - 1)
    told = np.full((int(t.max()), n), len(chars) * words)
    told[np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t), np.repeat(np.arange(n), t)] = np.where(chars[at] == there, at, len(chars)) * words
    told = told * n + np.arange(n)
    where, step = where.ravel(), np.arange(words)[:, None] * n
    one = np.uint64(1)
    block = np.arange(words)[:, None]
    end = np.where(block == (m - 1) // 64, (m - 1) % 64, 63).astype(np.uint64)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    plus, minus = np.ones((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)
    score = np.zeros((words, n), np.int64)  # at the last row of each block
    score[0] = end[0] + one
    columns = len(told)
    # the first and last steps of each block
    begins = np.maximum(0, 64 * np.arange(words) - below) + np.arange(words)
    stops = np.minimum(64 * np.arange(1, words + 1) + above, columns) - 1 + np.arange(words)
    left, out = np.arange(n), np.zeros(n, bool)
    close = t - 1 + (m - 1) // 64
    lo = hi = started = 0
    for s in range(int(close.max()) + 1):
        while started + 1 < words and begins[started + 1] - 1 <= s:
            started += 1
            score[started] = score[started - 1] + (end[started] + one).astype(np.int64)
        while hi < words and begins[hi] <= s:
            hi += 1
        while stops[lo] < s:
            lo += 1
            plus[lo], minus[lo] = one, 0
        eq = where.take(told[s - hi + 1 : s - lo + 1][::-1] + step[lo:hi])
        pv, mv, last = up[lo:hi], down[lo:hi], end[lo:hi]
        xv = eq | mv
        eq |= minus[lo:hi]
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        plus_out, minus_out = (ph >> last) & one, (mh >> last) & one
        ph, mh = ph << one | plus[lo:hi], mh << one | minus[lo:hi]
        np.bitwise_or(mh, ~(xv | ph), out=pv)
        np.bitwise_and(ph, xv, out=mv)
        plus[lo + 1 : hi + 1], minus[lo + 1 : hi + 1] = plus_out, minus_out
        score[lo:hi] += (plus_out - minus_out).view(np.int64)
        done = np.flatnonzero(close == s)
        if len(done):
            out[left[done]] = score[(m[done] - 1) // 64, done] <= room[done]
        if s % 32 == 31:
            # no path to the last corner is cheaper than its cell of this step and the way back to the diagonal
            off = (s - block[lo:hi]) - 64 * block[lo:hi] - (t - m)
            least = score[lo:hi] - np.bitwise_count(pv) + np.maximum(0, np.maximum(-off, off - 63))
            stay = np.flatnonzero((close > s) & (least.min(axis=0) - 3 <= room))
            if len(stay) < 0.8 * len(left):
                if not len(stay):
                    break
                left, m, t, room, close = left[stay], m[stay], t[stay], room[stay], close[stay]
                told, end, up, down, plus, minus, score = (x[:, stay] for x in (told, end, up, down, plus, minus, score))
    return out


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    room = (1 - least) * longer + 1e-9
    return abs(len(a) - len(b)) <= room and distance(a, b) <= room


def _possible(shared):
    """(id, th, nodes of the lines) to (id, th, line, node) of those that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            listed = batch.column(2)
            node = listed.flatten()
            count = listed.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            line = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = np.flatnonzero(node.is_valid().to_numpy(zero_copy_only=False))
            value = node.fill_null(0).to_numpy()
            at = at[passes(table, value[at])]
            of = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(line[at], pa.int32()), pa.array(value[at])], names=["id", "th", "line", "node"])

    return run


def normal(line: str) -> str:
    """The lower-cased words of a line, joined by single spaces."""
    return b" ".join(line.encode().translate(BY_LINE.tobytes()).split()).decode()


def _same(both: list[tuple[str, str]]) -> np.ndarray:
    """Which pairs of normalised lines are alike."""
    return within(both, (1 - SIMILARITY) * np.array([max(len(x), len(y)) for x, y in both]) + 1e-9)


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, repeated): the lines whose node may repeat; each node that does.

    lines: id, th (hash of the text), line (from 0), node. repeated: node, root (equal within
    a group), n (occurrences) and keep, the occurrence (id, line, th) that stays for it.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = rows.select("id", "th", "text").mapInArrow(lean(_scanner(parts)), f"part int, led boolean, blob binary, id {kind}, th long, nodes array<long>")
    told = scanned.repartition("part").sortWithinPartitions("part").mapInArrow(lean(minhash.collected(CLOSE)), f"id {kind}, th long, nodes array<long>, {minhash.CELLS}")
    told = stored(told)
    cells = told.where("key is not null").select(*minhash.names())
    roots = minhash.linked(cells, fetched(rows.select("text"), cells), CLOSE, _same)
    texts = told.where("nodes is not null").select("id", "th", "nodes")
    counts = texts.select(F.explode("nodes").alias("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    again = checkpointed(counts.join(roots, "node", "full").select("node", F.coalesce("n", F.lit(1)).alias("n"), "root"))
    # most lines are alone: only those whose node may repeat are looked at one by one
    shared = spark.sparkContext.broadcast(wanted_filter(again, again.count()))
    lines = checkpointed(texts.mapInArrow(lean(_possible(shared)), f"id {kind}, th long, line int, node long"))
    firsts = lines.groupBy("node").agg(F.min(F.struct("id", "line", "th")).alias("first"))
    nodes = checkpointed(again.join(firsts, "node"))
    fuzzy = nodes.where("root is not null")
    best = fuzzy.groupBy("root").agg(F.min("first").alias("keep"))
    fuzzy = fuzzy.join(best, "root").select("node", "root", "n", "keep")
    return lines, nodes.where("root is null").select("node", F.col("node").alias("root"), "n", F.col("first").alias("keep")).unionByName(fuzzy)


def _gone(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, th, gone): the numbers of the lines that a text loses."""
    repeated = checkpointed(repeated.select("node", "n", "keep"))
    frequent = repeated.where(F.col("n") >= FREQUENT).select("node", "keep")
    rare = repeated.where(F.col("n") < FREQUENT).select("node", "keep")
    met = lines.join(rare, "node")
    if 0 < frequent.count() <= FREQUENT_NODES:
        often = lines.join(F.broadcast(frequent), "node")
        # else all lines, the frequent ones too, would move for the rare ones
        met = lines.join(F.broadcast(frequent), "node", "left_anti").join(rare, "node").unionByName(often)
    else:
        met = lines.join(repeated.select("node", "keep"), "node")
    other = ~(F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("line") == F.col("keep.line")) & (F.col("th") == F.col("keep.th")))
    return met.where(other).groupBy("id", "th").agg(F.collect_set("line").alias("gone"))


def _cut(text_at: int, gone_at: int):
    """Rows with the numbers of the lines that go to rows without these lines, and two counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(text_at), batch.column(gone_at)
            total = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int64())
            fewer = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
            touched = pc.greater(fewer, 0)
            kept = []
            for text, numbers in zip(texts.filter(touched).to_pylist(), gone.filter(touched).to_pylist()):
                own = set(numbers)
                kept.append("\n".join([x for k, x in enumerate(text.split("\n")) if k not in own]))
            texts = pc.replace_with_mask(texts, touched, pa.array(kept, texts.type))
            cols = [texts if k == text_at else c for k, c in enumerate(batch.columns) if k != gone_at]
            yield pa.RecordBatch.from_arrays([*cols, total, fewer], names=[f"c{k}" for k in range(len(cols) + 2)])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """`docs` without the lines that repeat an earlier one; with n_lines and n_removed if asked."""
    gone = _gone(*groups(docs, id_col, text)).hint("shuffle_hash")
    width = len(docs.columns)
    rows = docs.toDF(*[f"c{k}" for k in range(width)])
    own_id, own_text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text)}"
    met = rows.join(gone, rows[own_id].eqNullSafe(gone["id"]) & (F.xxhash64(rows[own_text]) == gone["th"]), "left").select(*rows.columns, "gone")
    schema = T.StructType([*rows.schema.fields, T.StructField(f"c{width}", T.LongType()), T.StructField(f"c{width + 1}", T.LongType())])
    cut = met.mapInArrow(lean(_cut(docs.columns.index(text), width)), schema)
    if counts:
        return renamed(cut, docs, "n_lines", "n_removed")
    return cut.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)])
