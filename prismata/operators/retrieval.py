"""Full-text and vector retrieval over chunks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import relaxed, tokens
from .checkpoints import checkpointed

#: Characters of a text that are embedded, of stored text and query alike.
EMBED_CHARS = 6000
#: Bytes of query vectors or phrases that may be broadcast.
SMALL_BYTES = 32 << 20
#: Scores of queries and vectors that a task computes at once: 16 MB.
SCORES = 2 << 20
#: Pairs whose scores are computed one by one at once.
PAIRS = 32_768


def occurrences(content: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences, ignoring case."""
    low, p = F.lower(content), F.lower(phrase)
    return ((F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.greatest(F.length(p), F.lit(1))).cast("long")


def search_phrases(chunks: DataFrame, phrases: list[str], every: bool, limit: int) -> DataFrame:
    """Chunks that hold all (or any) phrases; score: occurrences times squared idf, then id.

    One scan: document frequencies come from the same pass that finds the hits.
    """
    own = chunks.select("id", "file_path", "content").withColumns({f"n{k}": occurrences(F.col("content"), F.lit(p)) for k, p in enumerate(phrases)})
    has = [F.col(f"n{k}") > 0 for k in range(len(phrases))]
    stats = own.agg(F.count("*").alias("total"), *[F.count_if(h).alias(f"d{k}") for k, h in enumerate(has)])
    hit = has[0]
    for h in has[1:]:
        hit = (hit & h) if every else (hit | h)
    score = sum((F.col(f"n{k}") * F.pow(F.log10(F.col("total") / F.greatest(F.col(f"d{k}"), F.lit(1))), F.lit(2.0)) for k in range(len(phrases))), F.lit(0.0))
    return own.where(hit).join(F.broadcast(stats)).select("id", "file_path", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """All words first; if no chunk has them all, any of the relaxed words."""
    if not query or not query.strip():
        raise ValueError("the query is empty")
    spark = chunks.sparkSession
    row = spark.range(1).select(tokens(F.lit(query)).alias("t")).select("t", relaxed(F.col("t")).alias("r")).first()
    if not row["t"]:
        raise ValueError("the query has no words of two characters or more")
    capped = max(1, min(100, limit))
    precise = search_phrases(chunks, row["t"], True, capped)
    return precise if not precise.isEmpty() else search_phrases(chunks, row["r"], False, capped)


def search_batch(chunks: DataFrame, queries: DataFrame, top: int = 5, block: int = 512) -> DataFrame:
    """(query_id, id, rank, relaxed) for many queries at once.

    The query set is handled in blocks, each a broadcast matrix of words by queries of at
    most SMALL_BYTES; every partition of the chunks keeps its own best `top` a query, so
    neither frequent words nor pairs are shuffled. Words here are whole; substrings are for
    search(). A query that some chunk matches in full keeps such chunks only.
    """
    spark = chunks.sparkSession
    q = checkpointed(queries.select(F.col("id").alias("query_id"), tokens(F.lower("text")).alias("t")).where(F.size("t") > 0))
    count, cells = q.agg(F.count("*"), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    # a block of n queries has cells * n / count words at most
    blocks = max(1, -(-count // block), int(math.ceil((4 * cells * max(1, count) / SMALL_BYTES) ** 0.5)))
    words = chunks.select("id", F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{Nd}_$]{2,})"), 1)).alias("words"))
    found = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((part.column("query_id").to_numpy(), part.column("t").to_pylist()))
        got = words.mapInArrow(_best_by_words(shared, top), "query_id long, id long, have int, need int")
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("have"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    full = F.max(F.col("have") == F.col("need")).over(Window.partitionBy("query_id"))
    return best.withColumn("full", full).where(~F.col("full") | (F.col("have") == F.col("need"))).select("query_id", "id", "rank", (~F.col("full")).alias("relaxed"))


def _best_by_words(shared, top: int):
    """(id, words) to the `top` chunks of each query that share most words with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts = shared.value
        column: dict[str, int] = {}
        for own in texts:
            for w in own:
                column.setdefault(w, len(column))
        asked = np.zeros((len(column), len(names)), np.float32)
        for k, own in enumerate(texts):
            asked[[column[w] for w in own], k] = 1
        held = np.zeros((0, 3), np.int64)  # query, -have, id
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(lo, 256).to_numpy()
                has = np.zeros((len(ids), len(column)), np.float32)
                for i, own in enumerate(batch.column(1).slice(lo, 256).to_pylist()):
                    has[i, [column[w] for w in own or () if w in column]] = 1
                have = (has @ asked).astype(np.int64)
                i, k = np.nonzero(have)
                held = np.concatenate([held, np.stack([k, -have[i, k], ids[i]], axis=1)])
                held = held[np.lexsort(held.T[::-1])]
                held = held[np.arange(len(held)) - np.searchsorted(held[:, 0], held[:, 0]) < top]
        need = np.array([len(set(own)) for own in texts], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[held[:, 0]], pa.int64()), pa.array(held[:, 2]), pa.array(-held[:, 1], pa.int32()), pa.array(need[held[:, 0]] if len(texts) else held[:, 0], pa.int32())], names=["query_id", "id", "have", "need"])

    return run


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length, in double precision; zero where a norm is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(x, y) / norms)


def vector_search(vectors: DataFrame, query: list[float], k: int = 8, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k stored vectors most alike to one query vector; an error if there are none."""
    own = vectors.where(F.size(vec) == len(query))
    if own.isEmpty():
        raise ValueError("no stored vectors of this length: embed the chunks first")
    q = F.array(*[F.lit(float(x)) for x in query])
    return own.select(id_col, cosine(F.col(vec), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def vector_search_batch(vectors: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "vec_id", vec: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, id, score): the k most alike rows of each query, itself left out.

    The query set is handled in blocks of `block` rows; each block is broadcast (a bounded
    matrix) and every partition of the stored vectors keeps its own best k a query, so what
    is shuffled does not grow with pairs.
    """
    spark = vectors.sparkSession
    n = queries.count()
    out = None
    for b in range(max(1, -(-n // block))):
        blocks = max(1, -(-n // block))
        part = queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b).select(id_col, vec).toPandas()
        q_id = part[id_col].to_numpy()
        q = np.array(part[vec].tolist(), dtype=np.float64).reshape(len(q_id), -1)
        shared = spark.sparkContext.broadcast((q_id, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, unit = shared.value
            step = max(1, SCORES // max(1, len(names)))
            q, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            least = np.full(len(names), -np.inf)  # a query's k-th best so far
            for f in frames:
                for lo in range(0, len(f) if len(names) else 0, step):
                    i = f["i"].to_numpy()[lo : lo + step]
                    x = np.array(f["v"].iloc[lo : lo + step].tolist(), dtype=np.float64)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    s = unit @ x.T
                    s[names[:, None] == i[None, :]] = -np.inf
                    if s.shape[1] > k:
                        low = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
                    else:
                        low = least
                    a, b = np.nonzero((s >= low[:, None] - 1e-9) & np.isfinite(s))
                    # one by one: equal vectors get equal scores, wherever they stand
                    q, ids = np.concatenate([q, a]), np.concatenate([ids, i[b]])
                    own = [np.einsum("ij,ij->i", unit[a[p : p + PAIRS]], x[b[p : p + PAIRS]]) for p in range(0, len(a), PAIRS)]
                    score = np.concatenate([score, *own])
                    order = np.lexsort((ids, -score, q))
                    q, ids, score = q[order], ids[order], score[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    least[q[place == k - 1]] = score[place == k - 1]
                    q, ids, score = q[place < k], ids[place < k], score[place < k]
            yield pd.DataFrame({"query_id": names[q] if len(q) else ids, "id": ids, "score": score})

        got = vectors.select(F.col(id_col).alias("i"), F.col(vec).alias("v")).mapInPandas(best, "query_id long, id long, score double")
        out = got if out is None else out.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def missing_vectors(chunks: DataFrame, stored: DataFrame, model: str, dims: int) -> DataFrame:
    """Chunks with text whose vector is absent, of another text or of another length."""
    have = stored.where((F.col("model") == model) & (F.col("dimensions") == dims)).select(F.col("chunk_id").alias("id"), "content_hash")
    return chunks.where(F.trim("content") != "").join(have, ["id", "content_hash"], "left_anti")


def symbol_chunks(chunks: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    own = chunks.where("kind = 'SYMBOL'").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return own.join(symbols.select(F.col("id").alias("symbol_id"), "qualified_name"), "symbol_id", "left").select("id", "path", "qualified_name", "start_line", "end_line")


def java_hash(text: str) -> int:
    """The 32-bit string hash over UTF-16 units, signed."""
    units = np.frombuffer(text.encode("utf-16-le"), dtype="<u2").astype(np.int64)
    h = 0
    for u in units.tolist():
        h = (31 * h + u) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def bag_of_words(text: str, dims: int) -> list[float]:
    """Deterministic stand-in for an embedding: hashed words, of norm one."""
    import re

    v = np.zeros(dims)
    for w in re.split("[^a-z0-9一-鿿]+", text.lower()):
        if w:
            v[java_hash(w) % dims] += 1
    n = math.sqrt(float(v @ v))
    return (v / n if n else v).tolist()


def embedded(chunks: DataFrame, model: str, dims: int, embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 16) -> DataFrame:
    """(chunk_id, model, dimensions, content_hash, vector) of chunks, embedded in batches."""
    call = embed or (lambda texts: [bag_of_words(t, dims) for t in texts])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors = []
            for lo in range(0, len(f), batch):
                texts = [t[:EMBED_CHARS] for t in f["content"].iloc[lo : lo + batch]]
                got = call(texts)
                if len(got) != len(texts) or any(len(v) != dims for v in got):
                    raise ValueError("the embedding client returned another number or length of vectors")
                vectors += got
            yield pd.DataFrame({"chunk_id": f["id"], "model": model, "dimensions": dims, "content_hash": f["content_hash"], "vector": vectors})

    return chunks.select("id", "content_hash", "content").mapInPandas(run, "chunk_id long, model string, dimensions int, content_hash string, vector array<float>")


def pack(vector: list[float]) -> bytes:
    return np.asarray(vector, dtype="<f4").tobytes()


def unpack(data: bytes) -> list[float]:
    if len(data) % 4:
        raise ValueError("not a whole number of 32-bit floats")
    return np.frombuffer(data, dtype="<f4").tolist()
