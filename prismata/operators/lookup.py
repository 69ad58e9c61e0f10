"""Relational lookups over the symbol tables (joins, filters, ordered limits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_trivial, is_type, ratio

MAX_LIMIT = 200


class NotFound(LookupError):
    """A repository or symbol that was asked for by id does not exist."""


def clamp(limit: int, most: int = MAX_LIMIT) -> int:
    return max(1, min(most, limit))


def with_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def top_level_types(symbols: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    own = symbols.where(F.col("parent_id").isNull() & is_type(F.col("kind")))
    return with_file(own, files).select("name", "qualified_name", "path", "start_line", "end_line").orderBy("qualified_name").limit(limit)


def _ranked(symbols: DataFrame, files: DataFrame, counts: DataFrame, key: str, limit: int) -> DataFrame:
    found = symbols.join(counts.withColumnRenamed(key, "id"), "id")
    return with_file(found, files).select("id", "kind", "name", "qualified_name", "path", "n").orderBy(F.desc("n"), "id").limit(limit)


def most_called_methods(symbols: DataFrame, files: DataFrame, calls: DataFrame, limit: int) -> DataFrame:
    counts = calls.where("resolved = 1").groupBy("callee_symbol_id").agg(F.count("*").alias("n"))
    return _ranked(symbols.where((F.col("kind") == "METHOD") & ~is_trivial(F.col("name"))), files, counts, "callee_symbol_id", limit)


def most_implemented(symbols: DataFrame, files: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    counts = relations.where("resolved = 1").groupBy("super_symbol_id").agg(F.count("*").alias("n"))
    return _ranked(symbols.where("kind = 'INTERFACE'"), files, counts, "super_symbol_id", limit)


def repos(repo: DataFrame) -> DataFrame:
    """All repositories with their derived rates, the last indexed first."""
    parsed = ratio(F.col("parsed_ok_count"), F.col("file_count"))
    resolved = ratio(F.col("call_resolved_count"), F.col("call_edge_count"))
    return repo.withColumns({"parse_rate": parsed, "resolve_rate": resolved}).orderBy(F.col("indexed_at").desc_nulls_last(), F.desc("id"))


def latest_ready(repo: DataFrame) -> DataFrame:
    return repo.where("status = 'READY'").orderBy(F.col("indexed_at").desc_nulls_last(), F.desc("id")).select("id").limit(1)


def repo_by_path(repo: DataFrame, root_path: str) -> DataFrame:
    return repo.where(F.col("root_path") == root_path).orderBy(F.desc("id")).limit(1)


def find_symbols(symbols: DataFrame, files: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """Symbols of that name or with it in the qualified name; exact ones first, short ones next."""
    if not keyword or not keyword.strip():
        raise ValueError("the keyword is empty")
    word = keyword.strip()
    rank = F.when(F.col("name") == word, 0).when(F.col("qualified_name") == word, 1).otherwise(2)
    hit = symbols.where((F.col("name") == word) | F.col("qualified_name").contains(word)).withColumn("rank", rank)
    order = ["rank", F.octet_length("qualified_name"), "qualified_name", "id"]
    return with_file(hit, files).select("id", "kind", "name", "qualified_name", "path", "rank").orderBy(*order).limit(clamp(limit))


def members_in_type(symbols: DataFrame, files: DataFrame, owner: str, name: str) -> DataFrame:
    types = symbols.where(F.col("qualified_name") == owner).select(F.col("id").alias("parent_id"))
    own = symbols.where(F.col("name") == name).join(types, "parent_id")
    return with_file(own, files).select("id", "kind", "name", "qualified_name", "path").orderBy(F.octet_length("qualified_name"), "qualified_name", "id")


def children(symbols: DataFrame, parent: int) -> DataFrame:
    return symbols.where(F.col("parent_id") == parent).select("id", "kind", "name", "start_line").orderBy("kind", "start_line", "id")


def symbol_by_id(symbols: DataFrame, files: DataFrame, ident: int) -> DataFrame:
    return with_file(symbols.where(F.col("id") == ident), files)


def require_symbol(symbols: DataFrame, files: DataFrame, ident: int) -> DataFrame:
    found = symbol_by_id(symbols, files, ident)
    if found.isEmpty():
        raise NotFound(f"no symbol {ident}")
    return found


def _side(symbols: DataFrame, files: DataFrame, side: str) -> DataFrame:
    return with_file(symbols, files).select(F.col("id").alias(f"{side}_symbol_id"), F.col("qualified_name").alias(f"{side}_name"), F.col("path").alias(f"{side}_path"))


def _first(rows: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first rows in order; a whole result is left unsorted, since that would move it once more."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def callers(symbols: DataFrame, files: DataFrame, calls: DataFrame, callee: Column | None = None, limit: int | None = None) -> DataFrame:
    """Call sites of the chosen callees (a condition on callee_symbol_id); with a limit, by path and line."""
    own = calls.where("callee_symbol_id is not null")
    own = own if callee is None else own.where(callee)
    out = own.join(_side(symbols, files, "caller"), "caller_symbol_id").select("callee_symbol_id", "caller_symbol_id", "caller_name", "caller_path", "call_line")
    return _first(out, limit, "callee_symbol_id", "caller_path", "call_line", "caller_symbol_id")


def callees(symbols: DataFrame, files: DataFrame, calls: DataFrame, caller: Column | None = None, limit: int | None = None) -> DataFrame:
    """What the chosen callers call; unresolved calls stay, with their reason."""
    own = (calls if caller is None else calls.where(caller)).join(_side(symbols, files, "caller"), "caller_symbol_id")
    out = own.join(_side(symbols, files, "callee"), "callee_symbol_id", "left").select("caller_symbol_id", "caller_path", "call_line", "callee_symbol_id", "callee_name", "callee_path", "callee_raw", "resolved", "reason")
    return _first(out, limit, "caller_symbol_id", "call_line", "callee_raw")


def implementations(symbols: DataFrame, files: DataFrame, relations: DataFrame, super_type: Column | None = None, limit: int | None = None) -> DataFrame:
    own = (relations if super_type is None else relations.where(super_type)).join(symbols.withColumnRenamed("id", "sub_symbol_id").drop("kind"), "sub_symbol_id")
    return _first(with_file(own, files).select("super_symbol_id", "sub_symbol_id", "qualified_name", "path", "kind"), limit, "super_symbol_id", "qualified_name")


def resolve_type(symbols: DataFrame, name: str) -> DataFrame:
    """The one type with this id, name or qualified name; an error if there is none or several."""
    own = symbols.where(F.col("id") == int(name)) if name.isdigit() else symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
    found = own.where(is_type(F.col("kind"))).limit(2)
    n = found.count()
    if n != 1:
        raise NotFound(f"{'no type' if not n else 'several types'} {name}")
    return found


