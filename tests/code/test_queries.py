"""Every query against its SQL on the same Parquet tables."""

import glob
import os

import duckdb
import pytest

from prismata.plans import answer_queries, code_queries, index_queries  # noqa: F401
from prismata.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_alike_twice(spark, sf_dir, name):
    first, again = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first == again and first


def test_scans_are_pruned(spark, sf_dir):
    plan = QUERIES["e12_usage_of_repo"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "props" not in plan.split("ReadSchema")[-1]
