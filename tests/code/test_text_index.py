"""The inverted index against scans of the same chunks: phrases, batches, new segments, merging."""

import random

import pytest
from pyspark.sql import functions as F

from prismata.operators import retrieval
from prismata.sources.text_index import TextIndex, write_segment

PHRASES = ["A", "b a", "ba.", ".", " a", "中文", "文 a", "ab ab", "x²"]


def _chunks(spark, n, seed):
    r = random.Random(seed)
    parts = ["ab", "ba", "Bab", "a", "b", "a_b", " ", " ", "  ", ".", "\n", "ab ab ab", "中文字", "ß", "$x", "x²"]
    rows = [(i * 1500, f"f{i}", "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(12)))) for i in range(n)]
    return spark.createDataFrame([*rows, (7_000_001, "empty", ""), (7_000_002, "null", None)], "id long, file_path string, content string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("index") / "text")
    old, new = _chunks(spark, 60, 1), _chunks(spark, 60, 2).where("id % 4000 = 0 or id > 7000000")
    write_segment(old, base, 0, 4)
    write_segment(new, base, 3, 4)
    now = old.join(new, "id", "left_anti").unionByName(new).cache()
    return TextIndex(spark, base, 4), now


def _rows(df):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()]


@pytest.mark.parametrize("every", [True, False])
def test_phrases_equal_a_scan(built, every):
    index, chunks = built
    assert index.segments == [0, 3]
    for index, own in ((index, PHRASES[:2]), (index.merged(), PHRASES)):
        for phrases in [[p] for p in own] if every else (["ab", "ba."], ["b a", "zz", "a_b"]):
            assert _rows(index.search_phrases(chunks, phrases, every, 1000)) == _rows(retrieval.search_phrases(chunks, phrases, every, 1000)), phrases


def test_searches_equal_a_scan(spark, built):
    index, chunks = built
    index = index.merged()
    assert len(index.segments) == 1 and index.merged() is index
    for q in ("ab bab", "中文 ab", "nowhere ab", "nowhere"):
        assert _rows(index.search(chunks, q)) == _rows(retrieval.search(chunks, q))
    for bad in ("", "a"):
        with pytest.raises(ValueError):
            index.search(chunks, bad)
    r = random.Random(3)
    queries = spark.createDataFrame([(k, " ".join(r.choice(["ab", "ba", "bab", "a_b", "zz", "$x", "中文字", "no"]) for _ in range(r.randrange(6)))) for k in range(40)], "id long, text string")
    for own in built[0], index:
        assert sorted(_rows(own.search_batch(queries, 3))) == sorted(_rows(retrieval.search_batch(chunks, queries, 3)))


def test_early_end_changes_nothing(spark, built, monkeypatch):
    from prismata.sources import text_index

    index, chunks = built[0].merged(), built[1]
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(["ab ba bab", "zz ab", "bab $x a_b ab ba", "zz"])], "id long, text string")
    want = sorted(_rows(retrieval.search_batch(chunks, queries, 2)))
    for budget in (1, 30):
        monkeypatch.setattr(text_index, "FIRST_ROUND", budget)
        assert sorted(_rows(index.search_batch(queries, 2))) == want


def test_only_the_terms_buckets_are_read(spark, built):
    index = built[0].merged()
    own = index.postings(spark.createDataFrame([("bab",)], "term string"))
    plan = own._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0] and "EqualTo(term,bab)" in plan or "In(term" in plan
    assert own.where(F.size("at") != F.col("n")).isEmpty() and own.count() > 0


def test_tasks_of_the_index_grow_with_the_texts(spark, tmp_path, monkeypatch):
    from prismata.sources import text_index

    monkeypatch.setattr(text_index, "TASK_BYTES", 1000)
    chunks = spark.createDataFrame([(i * 5000, f"f{i}", "ab ba " * 50) for i in range(60)], "id long, file_path string, content string")
    write_segment(chunks, str(tmp_path / "i"), 0, 2)
    files = spark.read.parquet(str(tmp_path / "i" / "postings")).inputFiles()
    assert len(files) > 8  # not one for each bucket
    terms = TextIndex(spark, str(tmp_path / "i"), 2).terms().collect()
    assert sorted(tuple(r) for r in terms) == [("ab", 60, 3000), ("ba", 60, 3000)]


def test_equal_vectors_are_ranked_by_id(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORES", 7)
    rows = [(i, [1.0, 0.1 * (i % 3), 0.3]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = retrieval.vector_search_batch(v, v.where("vec_id in (0, 1)"), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, x) for x in (3, 6, 9, 12, 15)] + [(1, x) for x in (4, 7, 10, 13, 16)]
