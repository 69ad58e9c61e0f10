"""An inverted index of chunks in Parquet: terms, postings with positions, live rows.

    terms/segment=s      term, df, cf
    postings/segment=s/bucket=b  term, block, ids, counts, positions, most   (sorted by term)
    rows/segment=s       id, words

A term's postings lie in the bucket of its hash, cut into blocks of ids, so that a frequent
term is many bounded rows; `most` is the greatest count in a block. A search reads the
buckets and row groups of its terms only. Every batch of chunks is a segment of its own;
an id's newest segment is the one that counts, and merged() makes one segment of many.

A phrase is found by its words: inside a word by the dictionary, over several words by
neighbouring positions, after which the texts of these candidates alone are compared.
Results equal those of a scan of all chunks (retrieval.search_phrases, search_batch).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import relaxed, tokens
from ..operators import retrieval
from ..operators.checkpoints import checkpointed

WORD = r"[\p{L}\p{Nd}_$]+"
#: Ids of a block, buckets of an index, terms that are pushed into the scan as literals.
BLOCK, BUCKETS, LITERALS = 4096, 64, 2000
#: Postings that the first round of a search for many queries may read for each query.
FIRST_ROUND = 2_000
#: Queries that are counted together: a table of two bytes for each and each id of a block.
QUERIES = 2048


def _inner(c: str) -> bool:
    """Whether WORD takes a character."""
    return c in "_$" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: Bytes of text that a task of the last step indexes.
TASK_BYTES = 32 << 20
#: Rows whose words are grouped at once.
SLICE = 2048
POSTING = "array<struct<id:bigint,at:array<int>>>"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) to (term, block, p): a batch's postings of each term and block of ids, words in their order."""
    for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
        # a null row, or one without words, has no entries
        words, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
        count = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = words.flatten().dictionary_encode()
        if not len(flat):
            continue
        row = np.repeat(np.arange(len(count)), count)
        at = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        code, block = flat.indices.to_numpy().astype(np.int64), ids[row].astype(np.int64) // BLOCK
        order = np.lexsort((at, ids[row], block, code))
        code, block, row, at = code[order], block[order], row[order], at[order]
        new = np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))
        first = np.flatnonzero(new | np.append(True, row[1:] != row[:-1]))
        group = np.flatnonzero(new)
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at))
        posts = pa.StructArray.from_arrays([pa.array(ids[row[first]], pa.int64()), positions], names=["id", "at"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(first, group), len(first)), pa.int32()), posts)
        yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code[group])), pa.array(block[group]), lists], names=["term", "block", "p"])


def write_segment(chunks: DataFrame, base: str, segment: int, buckets: int = BUCKETS) -> None:
    """Index (id, content) as one segment; rows are written last and make it visible.

    A row's words are grouped where they are read, and one shuffle brings the postings of a
    bucket and a block of ids together, in as many tasks as the texts need.
    """
    words = chunks.select("id", F.regexp_extract_all(F.lower("content"), F.lit(f"({WORD})"), 1).alias("w"))
    size = chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = words.select(F.col("id").cast("long"), "w").mapInArrow(_grouped, f"term string, block long, p {POSTING}").withColumn("bucket", _bucket(F.col("term"), buckets))
    dealt = parts.repartition(max(buckets, -(-size // TASK_BYTES)), "bucket", "block")
    block = dealt.groupBy("bucket", "block", "term").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    post = block.select("term", "block", F.transform("p", lambda p: p["id"]).alias("ids"), F.transform("p", lambda p: F.size(p["at"])).alias("counts"), F.transform("p", lambda p: p["at"]).alias("positions"), "bucket")
    post = post.withColumns({"most": F.array_max("counts"), "segment": F.lit(segment)})
    post.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "bucket").parquet(f"{base}/postings")
    written = chunks.sparkSession.read.parquet(f"{base}/postings").where(F.col("segment") == segment)
    terms = written.groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("cf"))
    terms.withColumn("segment", F.lit(segment)).sortWithinPartitions("term").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{base}/terms")
    words.select("id", F.size("w").alias("words"), F.lit(segment).alias("segment")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{base}/rows")


class TextIndex:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base, buckets
        rows = self._rows()
        self.segments = sorted(r.segment for r in rows.select("segment").distinct().collect())
        live = F.col("segment").isin(self.segments)  # folders are listed once
        self._postings, self._terms = (spark.read.parquet(f"{base}/{t}").where(live) for t in ("postings", "terms"))

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/rows")

    def rows(self) -> DataFrame:
        """(id, segment) of what counts: each id's newest segment."""
        own = self._rows()
        return own.select("id", "segment") if len(self.segments) == 1 else own.groupBy("id").agg(F.max("segment").alias("segment"))

    def terms(self) -> DataFrame:
        if len(self.segments) == 1:
            return self._terms.select("term", "df", "cf")
        return self._terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def postings(self, terms: DataFrame, *extra: str, at: bool = True) -> DataFrame:
        """(term, id, n, at, *extra) of the given distinct terms (term, *extra), out of their buckets only; without `at` no positions are read."""
        own = self._postings
        some = terms.limit(LITERALS + 1).select("term").collect()
        if len(some) <= LITERALS:
            names = [r.term for r in some]
            buckets = {r.b for r in self.spark.createDataFrame([(n,) for n in names] or [("",)], "term string").select(_bucket(F.col("term"), self.buckets).alias("b")).distinct().collect()}
            own = own.where(F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(names))
            terms = F.broadcast(terms)
        own = own.join(terms, "term").select("term", *extra, "segment", F.explode(F.arrays_zip("ids", "counts", *(["positions"] if at else []))).alias("p"))
        own = own.select("term", *extra, "segment", F.col("p.ids").alias("id"), F.col("p.counts").alias("n"), *([F.col("p.positions").alias("at")] if at else []))
        if len(self.segments) > 1:
            own = own.join(self.rows(), ["id", "segment"])
        return own.drop("segment")

    def merged(self) -> TextIndex:
        """One segment in place of many, in the files' own buckets: postings are regrouped, texts are not read."""
        if len(self.segments) < 2:
            return self
        base, new = f"{self.base}-{max(self.segments)}", max(self.segments)
        live = self._postings.select("term", "segment", F.explode(F.arrays_zip("ids", "counts", "positions")).alias("p")).select("term", "segment", F.col("p.ids").alias("id"), F.col("p.counts").alias("n"), F.col("p.positions").alias("at")).join(self.rows(), ["id", "segment"])
        block = live.groupBy("term", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "n", "at"))).alias("p"))
        post = block.select("term", "block", F.col("p.id").alias("ids"), F.col("p.n").alias("counts"), F.col("p.at").alias("positions")).withColumns({"most": F.array_max("counts"), "segment": F.lit(new), "bucket": _bucket(F.col("term"), self.buckets)})
        post.repartition(self.buckets, "bucket", F.pmod("block", F.lit(16))).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("segment", "bucket").parquet(f"{base}/postings")
        written = self.spark.read.parquet(f"{base}/postings")
        terms = written.groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("cf"))
        terms.withColumn("segment", F.lit(new)).sortWithinPartitions("term").write.mode("overwrite").partitionBy("segment").parquet(f"{base}/terms")
        self._rows().join(self.rows(), ["id", "segment"]).select("id", "words", F.lit(new).alias("segment")).write.mode("overwrite").partitionBy("segment").parquet(f"{base}/rows")
        return TextIndex(self.spark, base, self.buckets)

    # one query

    def _single(self, word: str) -> DataFrame:
        """(id, n): a phrase of word characters occurs inside words, as often as in each word of the dictionary."""
        found = self.terms().where(F.col("term").contains(word)).select("term", retrieval.occurrences(F.col("term"), F.lit(word)).alias("times"))
        return self.postings(checkpointed(found), "times", at=False).groupBy("id").agg(F.sum(F.col("n") * F.col("times")).alias("n"))

    def _several(self, chunks: DataFrame, phrase: str) -> DataFrame:
        """(id, n): candidates have fitting words at neighbouring positions; their texts decide."""
        low = phrase.lower()
        words = ["".join(run) for inside, run in groupby(low, _inner) if inside]
        starts, ends = _inner(low[0]), _inner(low[-1])
        near = None
        for k, w in enumerate(words):
            term = F.col("term")
            first, last = k == 0 and starts, k == len(words) - 1 and ends
            fits = term.contains(w) if first and last else term.endswith(w) if first else term.startswith(w) if last else term == w
            own = self.postings(checkpointed(self.terms().where(fits).select("term"))).select("id", F.explode("at").alias("p")).select("id", (F.col("p") - k).alias("p"))
            near = own if near is None else near.join(own, ["id", "p"])
        ids = near.select("id").distinct()
        return chunks.join(ids, "id", "left_semi").select("id", retrieval.occurrences(F.col("content"), F.lit(phrase)).alias("n")).where("n > 0")

    def phrase(self, chunks: DataFrame, phrase: str) -> DataFrame:
        low = phrase.lower()
        if low and all(map(_inner, low)):
            return self._single(low)
        if not any(map(_inner, low)):  # signs only: no word to look up
            return chunks.select("id", retrieval.occurrences(F.col("content"), F.lit(phrase)).alias("n")).where("n > 0")
        return self._several(chunks, phrase)

    def search_phrases(self, chunks: DataFrame, phrases: list[str], every: bool, limit: int) -> DataFrame:
        """As retrieval.search_phrases, out of the postings."""
        total = self.rows().count()
        found = None
        for k, p in enumerate(phrases):
            own = checkpointed(self.phrase(chunks, p))
            idf = F.pow(F.log10(F.lit(float(total)) / F.lit(float(max(1, own.count())))), F.lit(2.0))
            own = own.select("id", F.lit(k).alias("k"), (F.col("n") * idf).alias("s"))
            found = own if found is None else found.unionByName(own)
        # summed in the phrases' order, as a scan does
        sums = found.groupBy("id").agg(F.count("*").alias("have"), F.array_sort(F.collect_list(F.struct("k", "s"))).alias("s"))
        score = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["s"]).alias("score")
        best = sums.where(F.col("have") == len(phrases)) if every else sums
        best = best.select("id", score).orderBy(F.desc("score"), "id").limit(limit)
        return chunks.select("id", "file_path").join(F.broadcast(best), "id").select("id", "file_path", "score").orderBy(F.desc("score"), "id")

    def search(self, chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
        """As retrieval.search: all words first, else any of the relaxed ones."""
        if not query or not query.strip():
            raise ValueError("the query is empty")
        row = self.spark.range(1).select(tokens(F.lit(query)).alias("t")).select("t", relaxed(F.col("t")).alias("r")).first()
        if not row["t"]:
            raise ValueError("the query has no words of two characters or more")
        capped = max(1, min(100, limit))
        precise = self.search_phrases(chunks, row["t"], True, capped)
        return precise if not precise.isEmpty() else self.search_phrases(chunks, row["r"], False, capped)

    # many queries

    def search_batch(self, queries: DataFrame, top: int = 5) -> DataFrame:
        """As retrieval.search_batch, rarest words first.

        The first round reads, for each query, its rarest words up to FIRST_ROUND postings,
        one word at least. A row that has none of them shares at most the words that are
        left; where the `top`-th row already has more, no row unseen can enter, and the
        query ends there: its candidates alone are completed with the other words. The
        other queries read all their words.
        """
        q = queries.select(F.col("id").alias("query_id"), F.array_distinct(tokens(F.lower("text"))).alias("t")).where(F.size("t") > 0)
        words = q.select("query_id", F.size("t").alias("need"), F.explode("t").alias("term")).join(self.terms().select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        order = Window.partitionBy("query_id").orderBy("df", "term")
        words = words.withColumns({"read": F.sum("df").over(order), "place": F.row_number().over(order)})
        words = checkpointed(words.withColumn("early", (F.col("read") <= FIRST_ROUND) | (F.col("place") == 1)))
        left = words.groupBy("query_id").agg(F.count_if(~F.col("early")).alias("left"))
        seen = checkpointed(self._pairs(words.where("early and df > 0")).groupBy("query_id", "id").agg(F.count("*").cast("int").alias("have")))
        nth = Window.partitionBy("query_id").orderBy(F.desc("have"), "id")
        kth = seen.withColumn("r", F.row_number().over(nth)).where(F.col("r") == top).select("query_id", F.col("have").alias("kth"))
        state = checkpointed(left.join(kth, "query_id", "left").withColumn("ends", F.coalesce(F.col("kth") > F.col("left"), F.col("left") == 0)))
        ended = state.where("ends")
        # of an ended query: rows that can still reach the top, with what the other words add
        open_rows = seen.join(ended, "query_id").where((F.col("have") + F.col("left") >= F.coalesce("kth", F.lit(0))) | F.col("kth").isNull()).select("query_id", "id", "have")
        late = words.where("not early and df > 0").join(ended.select("query_id"), "query_id", "left_semi")
        more = self._pairs(late).join(open_rows.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id", "id").agg(F.count("*").cast("int").alias("more"))
        first = open_rows.join(more, ["query_id", "id"], "left").select("query_id", "id", (F.col("have") + F.coalesce("more", F.lit(0))).alias("have"))
        rest = self._counted(words.where("df > 0").join(state.where("not ends").select("query_id"), "query_id", "left_semi"), top)
        found = first.unionByName(rest).withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= top)
        found = found.join(words.groupBy("query_id").agg(F.max("need").alias("need")), "query_id")
        full = F.max(F.col("have") == F.col("need")).over(Window.partitionBy("query_id"))
        return found.withColumn("full", full).where(~F.col("full") | (F.col("have") == F.col("need"))).select("query_id", "id", "rank", (~F.col("full")).alias("relaxed"))

    def _pairs(self, words: DataFrame) -> DataFrame:
        """(query_id, id) for each word of a query that a row has."""
        asked = words.groupBy("term").agg(F.collect_set("query_id").alias("query_ids"))
        return self.postings(asked, "query_ids", at=False).select("id", F.explode("query_ids").alias("query_id"))

    def _counted(self, words: DataFrame, top: int) -> DataFrame:
        """(query_id, id, have): the `top` rows of each block of ids by the words that they share.

        Blocks of postings are dealt by their ids and counted in a table of queries by ids,
        so neither words nor pairs are shuffled. Queries go in groups of at most QUERIES.
        """
        n = words.agg(F.count_distinct("query_id")).first()[0]
        groups = max(1, -(-2 * n // QUERIES))
        if len(self.segments) > 1:
            return self._pairs(words).groupBy("query_id", "id").agg(F.count("*").cast("int").alias("have"))
        out = None
        for g in range(groups):
            own = words.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
            asked = checkpointed(own.groupBy("term").agg(F.collect_set("query_id").alias("query_ids")))
            names = np.array(sorted(r.q for r in asked.select(F.explode("query_ids").alias("q")).distinct().collect()), np.int64)
            post = self._postings
            some = asked.select("term", _bucket(F.col("term"), self.buckets).alias("b")).limit(LITERALS + 1).collect()
            if len(some) <= LITERALS:
                post, asked = post.where(F.col("bucket").isin(sorted({r.b for r in some})) & F.col("term").isin([r.term for r in some])), F.broadcast(asked)
            held = post.join(asked, "term").select("block", "ids", "query_ids").repartition("block").sortWithinPartitions("block")
            got = held.mapInArrow(_best_of_blocks(names, top), "query_id long, id long, have int")
            out = got if out is None else out.unionByName(got)
        return out


def _best_of_blocks(names: np.ndarray, top: int):
    """Rows (block, ids, query_ids), sorted by block -> the best rows of each block and query."""
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("have", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, at = np.zeros((len(names), BLOCK), np.int16), None

        def best() -> pa.RecordBatch:
            q, i = np.nonzero(counts)
            have = counts[q, i]
            order = np.lexsort((i, -have.astype(np.int32), q))
            q, i, have = q[order], i[order], have[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < top
            counts[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(names[q[first]]), pa.array(i[first] + at * BLOCK), pa.array(have[first].astype(np.int32))], schema=schema)

        for batch in batches:
            for block, ids, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if block != at:
                    if at is not None:
                        yield best()
                    at = block
                rows, columns = np.searchsorted(names, asked.values.to_numpy()), ids.values.to_numpy() - block * BLOCK
                counts[np.ix_(rows, columns)] += 1
        if at is not None:
            yield best()

    return run
