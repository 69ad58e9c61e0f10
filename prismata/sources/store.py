"""The index as Parquet tables, with keys resolved to ids, and their store.

A commit writes all tables of a repository into a new folder and then, last of all, one
small manifest that names them. Readers pin the manifests they saw: they never meet half a
commit, and a commit that fails leaves a FAILED manifest beside the older READY one, whose
tables stay readable.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunks as cutting
from ..operators.checkpoints import checkpointed, measured_joins
from . import files as reading
from . import java

TABLES = ("source_file", "symbol", "call_edge", "type_relation", "chunk")


def ids(df: DataFrame, repo_id: int, *order: str) -> DataFrame:
    """Deterministic 64-bit ids from the natural key: no counter, no sort, equal on rebuild."""
    return df.withColumn("id", F.xxhash64(F.lit(repo_id), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])).withColumn("repo_id", F.lit(repo_id).cast("long"))


def built(spark: SparkSession, root: str, repo_id: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, orphans): all tables of one checkout; calls whose caller is unknown."""
    found = reading.scanned(spark, root)
    units = checkpointed(java.parsed(reading.java_files(found)))  # five tables are made of it
    sources = found.where(F.col("path").endswith(".java")).select("path", F.col("content").cast("string").alias("content"))
    return assembled(units, sources, reading.text_files(found), repo_id)


def assembled(units: DataFrame, sources: DataFrame, text: DataFrame, repo_id: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """built() from outlined files, their texts (path, content) and the other text files.

    Of symbols with one qualified name the one of the greatest id stands for it.
    """
    outcome = units.select("path", F.lit("JAVA").alias("kind"), "content_hash", "loc", "parsed_ok", "parse_error")
    outcome = outcome.unionByName(text.select("path", F.lit("TEXT").alias("kind"), F.coalesce("content_hash", F.lit("")).alias("content_hash"), "loc", "parsed_ok", "parse_error"))
    source_file = ids(outcome, repo_id, "path")
    file_ids = source_file.select("path", F.col("id").alias("file_id"))
    raw = ids(java.symbol_rows(units).join(file_ids, "path"), repo_id, "path", "qualified_name", "start_line")
    by_key = raw.groupBy(F.col("qualified_name").alias("key")).agg(F.max("id").alias("kid"))
    symbol = raw.join(by_key.select(F.col("key").alias("parent_key"), F.col("kid").alias("parent_id")), "parent_key", "left")
    edges = java.resolved_calls(units)
    known = edges.join(by_key.select(F.col("key").alias("caller_key"), F.col("kid").alias("caller_symbol_id")), "caller_key")
    orphans = edges.join(by_key.select(F.col("key").alias("caller_key")), "caller_key", "left_anti")
    call_edge = ids(known.join(by_key.select(F.col("key").alias("callee_key"), F.col("kid").alias("callee_symbol_id")), "callee_key", "left"), repo_id, "caller_key", "call_line", "callee_raw")
    relations = java.resolved_supers(units).join(by_key.select(F.col("key").alias("sub_key"), F.col("kid").alias("sub_symbol_id")), "sub_key")
    type_relation = ids(relations.join(by_key.select(F.col("key").alias("super_key"), F.col("kid").alias("super_symbol_id")), "super_key", "left"), repo_id, "sub_key", "super_raw")
    code = cutting.symbol_chunks(sources, java.symbol_rows(units).select("path", "kind", "qualified_name", F.col("start_line").cast("long"), F.col("end_line").cast("long")))
    plain = cutting.text_chunks(text.where("content is not null").select("path", "content")).withColumns({"kind": F.lit("TEXT"), "qualified_name": F.lit(None).cast("string")})
    chunk = code.unionByName(plain).join(file_ids, "path").join(by_key.select(F.col("key").alias("qualified_name"), F.col("kid").alias("symbol_id")), "qualified_name", "left")
    chunk = ids(chunk, repo_id, "path", "start_line", "end_line", "kind", "qualified_name")
    tables = {"source_file": source_file, "symbol": symbol.drop("path"), "call_edge": call_edge.drop("path"), "type_relation": type_relation, "chunk": chunk.withColumnRenamed("path", "file_path")}
    return tables, orphans


#: States of a repository.
READY, FAILED = "READY", "FAILED"
MANIFEST = "repo_id long, version string, at string, status string, reason string, tables map<string,string>, orphan_edge_count long, file_count long, parsed_ok_count long, total_loc long, symbol_count long, call_edge_count long, call_resolved_count long"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _declare(spark: SparkSession, base: str, manifest: dict) -> None:
    """Write a manifest under a name of its own, in one piece: a reader sees it whole or not at all."""
    name = f"{base}/manifests/{manifest['repo_id']}-{manifest['version']}.json"
    part, fs = _folder(spark, f"{base}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(part, _folder(spark, name)[0]):
        raise OSError(f"the manifest {name} could not be put in place")


def commit(tables: dict[str, DataFrame], orphans: DataFrame, base: str, repo_id: int) -> dict:
    """Store a repository's tables as one new version; the manifest, which is returned, makes it visible.

    Where a table cannot be written, a FAILED manifest keeps the reason, and the error goes on.
    """
    spark = next(iter(tables.values())).sparkSession
    at = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    manifest = {"repo_id": repo_id, "version": f"{at}-{uuid.uuid4().hex[:8]}".replace(":", ""), "at": at, "status": READY, "reason": None}
    place = {name: f"{base}/data/{repo_id}/{manifest['version']}/{name}" for name in tables}
    try:
        with measured_joins(spark):
            for name, df in tables.items():
                df.drop("repo_id").write.parquet(place[name])
            lost = orphans.count()
        written = {name: spark.read.parquet(path).withColumn("repo_id", F.lit(repo_id).cast("long")) for name, path in place.items()}
        counts = rollup(written).drop("repo_id", "status").first() or {}
        manifest |= {"tables": place, "orphan_edge_count": lost, **(counts.asDict() if counts else {})}
    except Exception as e:
        _declare(spark, base, manifest | {"status": FAILED, "reason": f"{type(e).__name__}: {e}"[:500], "tables": {}})
        raise
    _declare(spark, base, manifest)
    return manifest


def manifests(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{base}/manifests")


def repos(spark: SparkSession, base: str) -> DataFrame:
    """One row a repository: its newest version's state, and the version that readers get."""
    own = manifests(spark, base)
    last = F.max_by(F.struct("status", "at", "reason"), "version").alias("s")
    ready = F.max(F.when(F.col("status") == READY, F.col("version"))).alias("readable")
    return own.groupBy("repo_id").agg(last, ready).select("repo_id", "s.*", "readable")


class Pinned:
    """The newest READY version of each repository as it was when this was made."""

    def __init__(self, spark: SparkSession, base: str, *repo_ids: int):
        own = manifests(spark, base).where(F.col("status") == READY)
        own = own.where(F.col("repo_id").isin(*repo_ids)) if repo_ids else own
        rows = own.groupBy("repo_id").agg(F.max_by("tables", "version").alias("tables")).collect()  # one row a repository
        self.spark, self.tables = spark, {r.repo_id: r.tables for r in rows}

    def table(self, name: str) -> DataFrame:
        paths = [t[name] for t in self.tables.values()]
        if not paths:
            raise ValueError(f"no repository has a table {name}")
        own = self.spark.read.parquet(*paths)
        return own.withColumn("repo_id", F.regexp_extract(F.input_file_name(), r"/data/(-?\d+)/[^/]+/[^/]+/[^/]+$", 1).cast("long"))


def vacuum(spark: SparkSession, base: str) -> int:
    """Remove the tables and manifests of versions that no new reader gets; returns how many."""
    own = manifests(spark, base)
    keep = repos(spark, base).select("repo_id", F.col("readable").alias("version"))
    last = own.groupBy("repo_id").agg(F.max("version").alias("version"))
    gone = own.join(keep.unionByName(last), ["repo_id", "version"], "left_anti").select("repo_id", "version").collect()
    for r in gone:
        for path in (f"{base}/manifests/{r.repo_id}-{r.version}.json", f"{base}/data/{r.repo_id}/{r.version}"):
            at, fs = _folder(spark, path)
            fs.delete(at, True)
    return len(gone)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace the partitions of the repositories in `df`, leaving others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def store(tables: dict[str, DataFrame], base: str) -> None:
    for name, df in tables.items():
        overwrite(df, f"{base}/{name}")


def rollup(tables: dict[str, DataFrame]) -> DataFrame:
    """Counters of a finished repository."""
    f = tables["source_file"].groupBy("repo_id").agg(F.count("*").alias("file_count"), F.count_if("parsed_ok").alias("parsed_ok_count"), F.sum("loc").alias("total_loc"))
    s = tables["symbol"].groupBy("repo_id").agg(F.count("*").alias("symbol_count"))
    c = tables["call_edge"].groupBy("repo_id").agg(F.count("*").alias("call_edge_count"), F.count_if("resolved").alias("call_resolved_count"))
    return f.join(s, "repo_id", "left").join(c, "repo_id", "left").fillna(0).withColumn("status", F.lit("READY"))


def without_repo(df: DataFrame, repo_id: int) -> DataFrame:
    return df.where(F.col("repo_id") != repo_id)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of equal keys; of equal new rows any one stays."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc("_n"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_n", "_r")


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that older files lack, with their defaults."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def jobs(events: DataFrame) -> DataFrame:
    """Present state of each job from its events (job_id, at, status, done, total, message)."""
    last = F.max_by(F.struct("status", "done", "total", "message"), "at").alias("s")
    return events.groupBy("job_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), last).select("job_id", "created_at", "updated_at", "s.*")


def compacted(spark: SparkSession, path: str, bytes_per_file: int, total_bytes: int) -> DataFrame:
    """The table in files of about one size."""
    return spark.read.parquet(path).repartition(max(1, total_bytes // bytes_per_file))
