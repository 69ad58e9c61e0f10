"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is split into special tokens and words as the tokenizer file says; each word is
encoded on its own. Its symbols' adjacent pairs are the leaves of a segment tree of
(rank, place); the root is the leftmost pair of the lowest rank. Merging it changes three
leaves, each updated in logarithmic time, until the root holds no mergeable pair. Words of
up to 64 symbols are encoded many at a time, one tree a row of a matrix; longer ones one
by one. Distinct words are encoded once a worker, in a cache of bounded size.

Nulls count as empty texts; an empty text has no tokens. Every row is handled on its own,
so repeated rows, ties and other columns do not matter, and an empty table gives no rows.
Very long texts are encoded whole. A column of `docs` that is named like one of the results
is replaced by it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, lean, renamed, slices

NONE = np.int64(1 << 62)
#: Distinct words a worker remembers; the cache is emptied when it is full.
CACHE_WORDS = 100_000
#: Bytes of text that are encoded and handed on at once.
PART_BYTES = 1 << 20
END = "</w>"


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """A word-end BPE tokenizer read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        # every number below the size of the vocabulary names a token
        self.is_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        chars = _byte_characters()
        self.inner = np.array([vocab.get(chars[b], -1) for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab.get(chars[b] + END, -1) for b in range(256)], dtype=np.int64)
        rank = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            rank[(vocab[a] << 20) | vocab[b]] = (r, vocab[a + b])
        keys = sorted(rank)
        self.pairs = np.array(keys, dtype=np.int64)
        self.pair_rank = np.array([rank[k][0] for k in keys], dtype=np.int64)
        self.pair_to = np.array([rank[k][1] for k in keys], dtype=np.int64)
        self.rank = rank
        # \s of the file's pattern is Unicode white space here, unlike in Python's str
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.common = regex.compile(r"[^\x00-\u052F]").search
        lib = tokenizers.Tokenizer.from_file(path)
        self.lib_normal = lib.normalizer.normalize_str
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.lib_words = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.named = [self.token[i] for i in range(len(self.token))]
        self.plain_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
        self.odd = re.compile(r"[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be]").search
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Beyond U+052F, where Python's Unicode tables may be newer, the library's own
        normaliser and splitter are asked.
        """
        if text.isascii():
            text = text.lower()
        elif self.common(text):
            return [w for w, _ in self.lib_words(self.lib_normal(text))]
        else:
            text = self.normal(text)
        # up to U+052F and without the odd characters the two patterns say the same
        return self.words(text) if self.odd(text) else self.plain_words(text)

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # a final sigma is not told apart

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 20) | right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        ok = self.pairs[at] == key
        return np.where(ok, self.pair_rank[at], NONE), self.pair_to[at]

    def _many(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Encode rows of initial symbols at once; -1 marks places that were merged away."""
        n, size = symbols.shape
        rows = np.arange(n)
        places = np.arange(size)
        following = np.minimum(places + 1, size)[None, :].repeat(n, 0)
        following[rows, lengths - 1] = size
        before = (places - 1)[None, :].repeat(n, 0)
        tree = np.full((n, 2 * size), NONE, np.int64)
        if size > 1:
            rank, _ = self._looked_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
            rank = rank.reshape(n, size - 1)
            live = (places[None, :-1] + 1 < lengths[:, None]) & (rank != NONE)
            tree[:, size : 2 * size - 1] = np.where(live, rank * size + places[:-1], NONE)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(r: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            at = at + size
            tree[r, at] = value
            while len(at) and at[0] > 1:
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        def pair(r: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.full(len(r), NONE, np.int64)
            ok = (a >= 0) & (b < size)
            rank, _ = self._looked_up(symbols[r[ok], a[ok]], symbols[r[ok], b[ok]])
            out[ok] = np.where(rank == NONE, NONE, rank * size + a[ok])
            return out

        live = rows[tree[:, 1] != NONE]
        while len(live):
            p = tree[live, 1] % size
            q = following[live, p]
            _, to = self._looked_up(symbols[live, p], symbols[live, q])
            symbols[live, p], symbols[live, q] = to, -1
            after = following[live, q]
            following[live, p] = after
            inner = after < size
            before[live[inner], after[inner]] = p[inner]
            put(live, q, np.full(len(live), NONE, np.int64))
            put(live, p, pair(live, p, after))
            back = before[live, p]
            has = back >= 0
            put(live[has], back[has], pair(live[has], back[has], p[has]))
            live = live[tree[live, 1] != NONE]
        return symbols

    def _one(self, symbols: list[int]) -> list[int]:
        """Encode one long word with a segment tree of its own."""
        n = len(symbols)
        size = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        find = self.rank.get
        rank = lambda a, b: (r[0], a) if (r := find((symbols[a] << 20) | symbols[b])) else none
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: tuple[int, int]) -> None:
            at += size
            tree[at] = value
            while at > 1:
                at >>= 1
                new = min(tree[2 * at], tree[2 * at + 1])
                if new == tree[at]:
                    break
                tree[at] = new

        while tree[1] is not none and tree[1] != none:
            p = tree[1][1]
            q = following[p]
            symbols[p], symbols[q] = find((symbols[p] << 20) | symbols[q])[1], -1
            after = following[p] = following[q]
            if after < n:
                before[after] = p
            put(q, none)
            put(p, rank(p, after) if after < n else none)
            if before[p] >= 0:
                put(before[p], rank(before[p], p))
        return [x for x in symbols if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks, together by size."""
        if not words:
            return
        coded = [w.encode() for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        if (symbols < 0).any():  # a character outside the vocabulary has no token
            known = symbols >= 0
            lengths = np.add.reduceat(known, ends - lengths).astype(np.int64)
            symbols, ends = symbols[known], np.cumsum(lengths)
        size = 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            if n > 64:
                for i in of.tolist():
                    self.cache[words[i]] = np.array(self._one(symbols[ends[i] - lengths[i] : ends[i]].tolist()), dtype="<u4").tobytes()
                continue
            for part in np.array_split(of, -(-len(of) // 20_000)):
                own = lengths[part]
                matrix = np.full((len(part), n), -1, np.int64)
                filled = np.arange(n)[None, :] < own[:, None]
                matrix[filled] = symbols[np.repeat(ends[part] - own - np.append(0, np.cumsum(own)[:-1]), own) + np.arange(int(own.sum()))]
                if n > 1:
                    matrix = self._many(matrix, np.maximum(own, 1))
                kept = matrix >= 0
                data = matrix[kept].astype("<u4").tobytes()
                stops = (4 * np.cumsum(kept.sum(axis=1))).tolist()
                last = 0
                for i, stop in zip(part.tolist(), stops):
                    self.cache[words[i]] = data[last:stop]
                    last = stop

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.is_special and "<|" in text and self.is_special.search(text):
            out = []
            for part in self.is_special.split(text):
                out += [part] if part in self.special else self.split(part)
            return out
        return self.split(text)

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and its decoded form.

        New words of all the texts are encoded together, so that the matrices are tall.
        """
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = set().union(*split)
        for w in new & self.special.keys():
            self.cache[w] = np.array([self.special[w]], dtype="<u4").tobytes()
        self.learn(list(new - self.special.keys()))
        get, name = self.cache.__getitem__, self.named.__getitem__
        for own in split:
            raw = b"".join(map(get, own))
            yield raw, " ".join(map(name, np.frombuffer(raw, dtype="<u4").tolist()))


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def decode(tokenizer: Tokenizer, ids: list[int]) -> str:
    """The file names no decoder: tokens are joined by single spaces."""
    return " ".join(tokenizer.token[i] for i in ids if i in tokenizer.token)


def encode(docs: DataFrame, path: str, text: str = "text", ids: bool = True, digest: bool = False) -> DataFrame:
    """`docs` with n_tokens and, as asked, ids (array of int) and decoded, or their digests.

    `path` names the tokenizer file on every machine; it is read once a worker.
    """
    bound_batches(docs.sparkSession)
    text_at = docs.columns.index(text)
    extra = [T.StructField("n_tokens", T.LongType())]
    if ids:
        extra += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    if digest:
        extra += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    width = len(docs.columns)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*docs.schema.fields, *extra])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for batch in batches:
            for lo, hi in slices(batch.column(text_at), PART_BYTES):  # ids and tokens take several times the text
                yield coded(tok, batch.slice(lo, hi - lo))

    def coded(tok: Tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_at).to_pylist()
        n, raw, plain, hashes, decoded = [], [], [], [], []
        for own, back in tok.encode_all(texts):
            n.append(len(own) // 4)
            if ids:
                raw.append(np.frombuffer(own, dtype="<i4"))
                plain.append(back)
            if digest:
                hashes.append(hashlib.sha256(own).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
        cols = [*batch.columns, pa.array(n, pa.int64())]
        if ids:
            ends = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int32)
            flat = pa.array(np.concatenate(raw) if raw else np.zeros(0, np.int32))
            cols += [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(plain, pa.string())]
        if digest:
            cols += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    out = docs.mapInArrow(lean(run), schema)
    return renamed(out, docs, *[f.name for f in extra])
