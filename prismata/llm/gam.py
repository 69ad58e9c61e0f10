"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a dozen and a half surface features, cut into quantile bins. Boosting
goes round the features in turn; each turn fits a shallow tree to the log-loss gradient of
one feature's bins and adds it to that feature's lookup table. Then the feature pairs with
the largest gain on what is left get tables of their own, built by trees that cut both
axes. A score is the sigmoid of a sum of table entries, found by bin numbers.

Features are computed for every row; at most TRAIN_ROWS labelled rows (those of the lowest
hash of their id) are brought to the driver, as features, to fit the tables. Labels are
the only thing learnt from; ids, language and source are no features.

A null or empty text has features of zero and a score like any other. Whole texts are read,
a very long one by itself; its features are shares and logarithms, so its length gives it no
weight of its own. Without labelled rows every score is 0.5. Equal texts score alike; of cuts
of equal gain the first is taken, of pairs of equal gain the last. Repeated rows are scored
each, other columns are left out, so none clashes, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, lean

TRAIN_ROWS = 50_000
BINS = 32
COARSE = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
NAMES = ("log_size", "word_len", "upper", "digit", "punct", "symbols", "marks", "bars", "beyond_ascii", "lines", "per_sentence", "short_words", "distinct_words", "upper_words", "repeated_lines", "top_word", "marked_words", "long_words")
SENTENCE = re.compile(r"[.!?](?:\s|$)")


def features(text: str | None) -> list[float]:
    """Surface features of one whole text."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = len(raw)
    words = text.split()
    m = max(1, len(words))
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = text.split("\n")
    punct = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    symbols = sum(int(counts[ord(c)]) for c in "#$%&*@^~<>{}[]\\=+_")
    return [
        float(np.log1p(n)),
        len(text) / m,
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        punct / n,
        symbols / n,
        counts[33] / n,
        counts[124] / n,
        counts[128:].sum() / n,
        len(lines) / m,
        len(SENTENCE.findall(text)) / m,
        sum(c for w, c in kinds.items() if len(w) <= 3) / m,
        len(kinds) / m,
        sum(c for w, c in kinds.items() if len(w) > 1 and w.isupper()) / m,
        1 - len(set(lines)) / len(lines),
        max(kinds.values(), default=0) / m,
        sum(c for w, c in kinds.items() if not w[-1].isalnum() and w[-1] not in ".,;:") / m,
        sum(c for w, c in kinds.items() if len(w) > 20) / m,
    ]


class Model:
    """Lookup tables of single features and of feature pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        bins = self.bins(x)
        self.tables = [np.zeros(BINS) for _ in self.edges]
        f = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            for j in range(x.shape[1]):
                g, h = self._sums(bins[:, j], BINS, y, f)
                step = RATE * self._tree(g, h, 2)
                self.tables[j] += step
                f += step[bins[:, j]]
        coarse = bins * COARSE // BINS
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        gains = []
        for a in range(x.shape[1]):
            for b in range(a):
                g, h = self._sums(coarse[:, a] * COARSE + coarse[:, b], COARSE**2, y, f)
                fit = self._cross(g.reshape(COARSE, COARSE), h.reshape(COARSE, COARSE))
                gains.append((float((fit.ravel() * g).sum()), a, b))
        for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((a, b))
            self.pair_tables.append(np.zeros((COARSE, COARSE)))
        for _ in range(PAIR_ROUNDS):
            for k, (a, b) in enumerate(self.pairs):
                cell = coarse[:, a] * COARSE + coarse[:, b]
                g, h = self._sums(cell, COARSE**2, y, f)
                step = RATE * self._cross(g.reshape(COARSE, COARSE), h.reshape(COARSE, COARSE))
                self.pair_tables[k] += step
                f += step.ravel()[cell]

    @staticmethod
    def _sums(cell: np.ndarray, n: int, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(cell, weights=y - p, minlength=n), np.bincount(cell, weights=np.maximum(p * (1 - p), 1e-6), minlength=n)

    @classmethod
    def _tree(cls, g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 2.0) -> np.ndarray:
        """Values by bin of a tree of the given depth over ordered bins."""
        if depth and len(g) > 1:
            cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gain = cg**2 / (ch + ridge) + (g.sum() - cg) ** 2 / (h.sum() - ch + ridge)
            cut = int(np.argmax(gain)) + 1
            if gain[cut - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
                return np.concatenate([cls._tree(g[:cut], h[:cut], depth - 1, ridge), cls._tree(g[cut:], h[cut:], depth - 1, ridge)])
        return np.full(len(g), np.clip(g.sum() / (h.sum() + ridge), -4, 4))

    @staticmethod
    def _cross(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> np.ndarray:
        """Values by cell of the best tree that cuts both axes once."""
        cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        best, at = -1.0, (1, 1)
        n = len(g)
        box = lambda c, a, b, d, e: c[b, e] - c[a, e] - c[b, d] + c[a, d]
        for i in range(1, n):
            for j in range(1, n):
                s = sum(box(cg, a, b, d, e) ** 2 / (box(ch, a, b, d, e) + ridge) for a, b in ((0, i), (i, n)) for d, e in ((0, j), (j, n)))
                if s > best:
                    best, at = s, (i, j)
        out = np.empty_like(g)
        for a, b in ((0, at[0]), (at[0], n)):
            for d, e in ((0, at[1]), (at[1], n)):
                out[a:b, d:e] = np.clip(box(cg, a, b, d, e) / (box(ch, a, b, d, e) + ridge), -4, 4)
        return out

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        coarse = bins * COARSE // BINS
        f = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            f += t[bins[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            f += t[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def score(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, held_out, score) of every row of `docs`; held-out rows' labels are never read.

    `held_out` is a condition on the column id_col.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["c0", "c1"])

    kind = rows.schema[id_col].dataType.simpleString()
    seen = checkpointed(rows.mapInArrow(lean(run), f"c0 {kind}, c1 array<double>").toDF(id_col, "x"))
    known = labels.where(F.col(label).isNotNull()).select(F.col(id_col), F.col(label).cast("int").alias("y")).where(~held_out)
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    sample = seen.join(known, id_col).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(train_rows).select("x", "y").toArrow()
    y = sample.column("y").to_numpy().astype(float)
    x = np.array(sample.column("x").to_pylist(), dtype=float).reshape(len(y), len(NAMES))
    shared = spark.sparkContext.broadcast(Model(x, y) if 0 < y.sum() < len(y) else None)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(NAMES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["c0", "c1"])

    out = seen.mapInArrow(lean(rate), f"c0 {kind}, c1 double").toDF(id_col, "score")
    return out.select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), "score")
