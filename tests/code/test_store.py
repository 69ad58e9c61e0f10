"""Versions of a stored index: a commit is whole or not there."""

import os

import pytest
from pyspark.sql import functions as F

from prismata.sources import java, store

CODE = "package p; class A {{ void run() {{ b(); c(); }} void b() {{}} {} }}"


def _tables(spark, more=""):
    files = spark.createDataFrame([("A.java", CODE.format(more))], "path string, content string")
    units = java.parsed(files.withColumn("content", F.col("content").cast("binary")))
    text = spark.createDataFrame([("README.md", "hash", 1, True, None, "hello")], "path string, content_hash string, loc long, parsed_ok boolean, parse_error string, content string")
    return store.assembled(units, files, text, 5)


def test_a_failed_commit_leaves_the_old_version(spark, tmp_path):
    base = str(tmp_path / "store")
    tables, orphans = _tables(spark)
    first = store.commit(tables, orphans, base, 5)
    assert first["status"] == "READY" and first["orphan_edge_count"] == 0 and (first["symbol_count"], first["call_edge_count"], first["call_resolved_count"], first["file_count"]) == (3, 2, 1, 2)
    pinned = store.Pinned(spark, base)
    names = lambda p: sorted(r.name for r in p.table("symbol").collect())
    assert names(pinned) == ["A", "b", "run"]

    tables, orphans = _tables(spark, "void c() {}")
    broken = dict(tables)
    broken["call_edge"] = tables["call_edge"].withColumn("bad", F.raise_error(F.lit("disk lost")))  # fails between two tables
    with pytest.raises(Exception, match="disk lost"):
        store.commit(broken, orphans, base, 5)
    assert names(store.Pinned(spark, base)) == ["A", "b", "run"]
    (state,) = store.repos(spark, base).collect()
    assert state.status == "FAILED" and "disk lost" in state.reason and state.readable == first["version"]

    second = store.commit(tables, orphans, base, 5)
    other = store.commit(*_tables(spark), base, 6)
    assert names(pinned) == ["A", "b", "run"]  # a pinned reader stays where it was
    assert names(store.Pinned(spark, base, 5)) == ["A", "b", "c", "run"]
    both = store.Pinned(spark, base).table("symbol").groupBy("repo_id").count().collect()
    assert sorted(map(tuple, both)) == [(5, 4), (6, 3)]
    assert {(r.repo_id, r.status, r.readable) for r in store.repos(spark, base).collect()} == {(5, "READY", second["version"]), (6, "READY", other["version"])}

    assert store.vacuum(spark, base) == 2 and store.vacuum(spark, base) == 0
    assert names(store.Pinned(spark, base, 5)) == ["A", "b", "c", "run"] and len(os.listdir(f"{base}/data/5")) == 1
    with pytest.raises(ValueError):
        store.Pinned(spark, base, 99).table("symbol")


def test_half_written_manifests_are_not_seen(spark, tmp_path):
    base = str(tmp_path / "store")
    first = store.commit(*_tables(spark), base, 5)
    with open(f"{base}/manifests/.half", "w") as f:
        f.write('{"repo_id": 5, "version": "9')
    assert store.Pinned(spark, base).tables[5] == first["tables"]
