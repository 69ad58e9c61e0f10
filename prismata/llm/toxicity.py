"""Toxicity: a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel compares strings by their common subsequences of three characters; a match that
spreads over more characters counts less, by DECAY for each character in between (up to
SPAN characters in all), so inserted or changed characters weaken a match but don't end
it. It is normalised: equal strings have kernel one. Strings are the words of a text
(longer ones in overlapping windows) and runs of single characters joined together, each
without characters that are no letters or digits, and with marks for its ends.

The kernel of two documents is the sum, over the pairs of their distinct strings, of the
string kernel to the power POWER, so that few close matches outweigh many distant ones; it is
a kernel, being a sum of products of kernels. Values under FLOOR are taken as zero.

Landmarks are the words that set toxic from clean labelled documents best, each a document of
one string. A document's kernel values with them go through the Nystrom map (the inverse root
of the landmarks' kernel matrix); on these features a linear machine with squared hinge loss
is fitted, and a sigmoid fitted to its margins gives the score.

At most TRAIN_ROWS labelled rows of each class (of the lowest hash of their id) are learnt
from; all rows are scored, whole. Each distinct word of a batch is compared once.

A null or empty text has no words and gets the score of an empty representation. Without
labels of both classes every score is 0.5. Repeated rows get equal scores, labels that differ
for one id count as the larger one, and an empty table gives no rows. Very long texts are
scored whole. Other columns do not matter; one that is named like the score is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, lean, renamed

TRAIN_ROWS = 5_000
LANDMARKS = 80
SPAN = 5
DECAY = 0.7
FLOOR = 0.4
POWER = 3
PIECE = 24
#: Words a worker remembers as far from all landmarks, till it forgets them all.
KNOWN = 100_000
EDGES = ".,;:!?\"'()[]{}|<>*#$%&-_=+~`/\\"
SPELLED = re.compile(r"(?<!\S)\S(?:[ ]\S){2,}(?!\S)")
START, STOP, DIGIT, OTHER = 30, 31, 27, 28
SHIFT = 64


class _Classes(dict):
    """Character to class: Latin letters by base letter, digits, other letters; the rest goes."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c == "\n":
            self[code] = c
        elif "a" <= base <= "z":
            self[code] = chr(SHIFT + ord(base) - 96)
        elif c.isdigit():
            self[code] = chr(SHIFT + DIGIT)
        else:
            self[code] = chr(SHIFT + OTHER + code % 2) if c.isalpha() else ""
        return self[code]


CLASSES = _Classes()


def words_of(text: str | None) -> set[str]:
    """The distinct strings of a text that are compared with the landmarks."""
    if not text:
        return set()
    low = text.lower()
    out = {w.strip(EDGES) for w in set(low.split())}
    for m in SPELLED.finditer(low):
        out.add(m[0].replace(" ", ""))
    return {w for w in out if len(w) > 2}


def coded(words: list[str]) -> list[str]:
    """The class strings of words (which hold no line breaks)."""
    return "\n".join(words).translate(CLASSES).split("\n") if words else []


def pieces(word: str) -> list[str]:
    """A class string, in overlapping windows if it is long; those of one character have no kernel."""
    if len(word) <= PIECE:
        return [word] if len(word) > 1 else []
    return [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


_triples: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j < k within SPAN of each other in a string of n, and their weights."""
    if n not in _triples:
        at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
        i, j, k = (np.array(x, dtype=np.int64) for x in zip(*at))
        _triples[n] = (i, j, k, (DECAY ** (k - i - 2)).astype(np.float32))
    return _triples[n]


def numbered(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all subsequences (rows x places) of class strings of one length, and their weights."""
    n = len(group[0])
    code = np.empty((len(group), n + 2), np.int32)
    code[:, 1:-1] = np.frombuffer("".join(group).encode(), dtype=np.uint8).reshape(len(group), n) - SHIFT
    code[:, 0], code[:, -1] = START, STOP
    i, j, k, w = triples(n + 2)
    return code[:, i] << 10 | code[:, j] << 5 | code[:, k], w


def spectrum(numbers: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subsequences of one string and their weights, of norm one in all."""
    u, at = np.unique(numbers, return_inverse=True)
    sums = np.bincount(at, weights=w, minlength=len(u))
    return u, sums / np.sqrt((sums * sums).sum())


def raised(value: np.ndarray) -> np.ndarray:
    """The document kernel of two single strings from their string kernel."""
    return np.where(value > FLOOR, value, 0) ** POWER


class Kernel:
    """Kernel values of strings against the landmarks, which are class strings."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        weights = np.zeros((1 << 15, len(landmarks)), np.float32)
        for c, word in enumerate(landmarks):
            numbers, w = numbered([word])
            u, x = spectrum(numbers[0], w)
            weights[u, c] = x
        self.gram = raised((weights.T @ weights).astype(np.float64))
        used = np.flatnonzero(weights.any(axis=1))
        self.row = np.full(1 << 15, -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.weights = weights[used]
        self.far: set[str] = set()

    def near(self, words: list[str]) -> dict[str, np.ndarray]:
        """For the words with a kernel value over FLOOR, their kernel values as documents."""
        by: dict[int, dict[str, list[str]]] = {}
        for w, c in zip(words, coded(words)):
            for p in pieces(c):
                by.setdefault(len(p), {}).setdefault(p, []).append(w)
        out: dict[str, np.ndarray] = {}
        for owners in by.values():
            group = list(owners)
            for lo in range(0, len(group), 1024):
                part = group[lo : lo + 1024]
                numbers, w = numbered(part)
                row = self.row[numbers]
                at, place = np.nonzero(row >= 0)
                if not len(at):
                    continue
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                sums = np.add.reduceat(self.weights[row[at, place]] * w[place, None], first, axis=0)
                # the norm is least where no subsequence repeats: a bound from above
                for k in np.flatnonzero(sums.max(axis=1) > FLOOR * np.sqrt((w * w).sum())).tolist():
                    own = numbers[at[first[k]]]
                    _, count = np.unique(own, return_inverse=True)
                    total = np.bincount(count, weights=w)
                    value = sums[k] / np.sqrt((total * total).sum())
                    if value.max() > FLOOR:
                        for word in owners[part[at[first[k]]]]:
                            out[word] = out.get(word, 0) + raised(value)
        return out

    def represent(self, texts: list[str | None]) -> np.ndarray:
        """Kernel values of each text with the landmarks: the sums of those of its words."""
        sets = [words_of(t) for t in texts]
        words = set().union(*sets) if sets else set()
        if len(self.far) > KNOWN:
            self.far.clear()
        near = self.near(list(words - self.far))
        self.far |= words - near.keys()
        out = np.zeros((len(texts), len(self.landmarks)))
        names = near.keys()
        for r, own in enumerate(sets):
            for w in sorted(own & names):  # in an order, so that sums are equal on every run
                out[r] += near[w]
        return out


class Machine:
    """Linear machine on Nystrom features, with a sigmoid on its margins."""

    def __init__(self, kernel: Kernel, x: np.ndarray, y: np.ndarray):
        value, vector = np.linalg.eigh(kernel.gram + 1e-2 * np.eye(len(kernel.landmarks)))
        self.kernel, self.map = kernel, vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
        z = self._mapped(x)
        s = np.where(y > 0, 1.0, -1.0)
        weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        w = np.zeros(z.shape[1])
        ridge = 1.0 * np.eye(len(w))
        ridge[-1, -1] = 1e-6
        for _ in range(50):  # Newton steps on the squared hinge
            on = s * (z @ w) < 1
            a = z[on] * weight[on, None]
            new = np.linalg.solve(a.T @ z[on] + ridge, a.T @ s[on])
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        self.w = w
        m = z @ w
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            g = np.array([((p - y) * m).sum() + 1e-3 * a, (p - y).sum()])
            q = np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.a, self.b = max(a, 1e-3), b

    def _mapped(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x @ self.map, np.ones(len(x))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = self._mapped(self.kernel.represent(texts)) @ self.w
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) rows to the words of a batch with the numbers of toxic and clean rows that have them."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[y].update({p for w in coded(list(words_of(text))) for p in pieces(w)})
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Machine | None:
    known = labels.where(F.col(label).isNotNull()).select(F.col(id_col), (F.col(label) > 0).cast("int").alias("y")).where(~held_out)
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    by_hash = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    sample = known.where("y = 1").orderBy(*by_hash).limit(train_rows).unionByName(known.where("y = 0").orderBy(*by_hash).limit(train_rows))
    # at most 2 * train_rows rows of an id and a label
    seen = checkpointed(docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(sample), id_col).select("text", "y"))
    sizes = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    n, m = sizes[1], sizes[0]
    counts = seen.mapInArrow(lean(_counted), "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate, base = (F.col("bad") + 0.5) / (n + 1), (F.col("good") + 0.5) / (m + 1)
    best = counts.where(F.col("bad") > F.greatest(F.lit(1), F.lit(n // 2000))).select("word", (rate * F.log(rate / base)).alias("gain")).orderBy(F.desc("gain"), "word").limit(LANDMARKS)
    landmarks = [r["word"] for r in best.collect()]
    if not landmarks:
        return None
    kernel = seen.sparkSession.sparkContext.broadcast(Kernel(landmarks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = kernel.value.represent(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = seen.mapInArrow(lean(run), "x array<double>, y int").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(len(y), -1)
    order = np.lexsort([*x.T[::-1], y])  # the same model whatever the order of rows
    return Machine(kernel.value, x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id", text: str = "text", name: str = "score", **how) -> DataFrame:
    """`docs` with a score from 0 to 1 in the column `name`.

    `held_out` is a condition on id_col; labels of rows that it holds for are never read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, label, held_out, id_col, text, **how))
    at = docs.columns.index(text)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            s = machine.score(texts) if machine else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[f"c{i}" for i in range(width + 1)])

    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], T.StructField(f"c{width}", T.DoubleType())])
    return renamed(docs.mapInArrow(lean(run), schema), docs, name)
