"""Rule-based review of classes: each rule yields rows of one finding table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_callable, lines, parameter_count

LONG_LINES = 60
MANY_PARAMETERS = 4
MANY_MEMBERS = 25
LEAST_CALLS = 5
UNRESOLVED = 0.5

COLUMNS = ["rule", "severity", "symbol_id", "start_line", "end_line", "value"]


def _finding(df: DataFrame, rule: str, severity: str, value: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("id").alias("symbol_id"), "start_line", "end_line", value.cast("long").alias("value"))


def long_methods(symbols: DataFrame) -> DataFrame:
    size = F.col("end_line") - F.col("start_line") + 1
    return _finding(symbols.where(is_callable(F.col("kind")) & (size >= LONG_LINES)), "LONG_METHOD", "low", size)


def many_parameters(symbols: DataFrame) -> DataFrame:
    own = symbols.where(is_callable(F.col("kind")) & F.col("signature").isNotNull()).withColumn("n", parameter_count(F.col("signature")))
    return _finding(own.where(F.col("n") > MANY_PARAMETERS), "MANY_PARAMS", "low", F.col("n"))


def god_classes(symbols: DataFrame) -> DataFrame:
    per = symbols.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > MANY_MEMBERS)
    return _finding(symbols.join(per, "id"), "GOD_CLASS", "low", F.col("n"))


def unresolved_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Types of whose members' calls half or more are unresolved, from five calls on."""
    owner = symbols.where(is_callable(F.col("kind"))).select(F.col("id").alias("caller_symbol_id"), F.col("parent_id").alias("id"))
    per_caller = calls.groupBy("caller_symbol_id").agg(F.count("*").alias("n"), F.count_if(F.col("resolved") == 0).alias("u"))
    per = per_caller.join(owner, "caller_symbol_id").groupBy("id").agg(F.sum("n").alias("n"), F.sum("u").alias("u"))
    return _finding(symbols.join(per.where((F.col("n") >= LEAST_CALLS) & (F.col("u") / F.col("n") >= UNRESOLVED)), "id"), "UNRESOLVED_CALLS", "info", F.col("u"))


def empty_catch_lines(source: Column) -> Column:
    """Numbers (from 0) of lines that open a catch block with nothing but comments in it."""
    own = F.transform(lines(source), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    opening = F.filter(own, lambda s: s["x"].rlike(r"catch\s*\([^)]*\)\s*\{"))

    def empty(s: Column) -> Column:
        rest = F.trim(F.regexp_replace(s["x"], r"^.*?catch\s*\([^)]*\)\s*\{", ""))
        code = F.filter(F.slice(own, s["i"] + 2, F.greatest(F.size(own) - s["i"] - 1, F.lit(0))), lambda t: ~F.trim(t["x"]).rlike(r"^($|//|\*|/\*)"))
        below = F.when(F.size(code) == 0, True).otherwise(F.trim(F.get(code, F.lit(0))["x"]).startswith("}"))
        return F.when(rest.startswith("}"), True).when((rest != "") & ~rest.startswith("//"), False).otherwise(below)

    return F.transform(F.filter(opening, empty), lambda s: s["i"])


def empty_catches(sources: DataFrame) -> DataFrame:
    """sources: id, start_line and content of types."""
    own = sources.select("id", F.col("start_line").alias("base"), F.explode(empty_catch_lines(F.col("content"))).alias("i"))
    at = own.select("id", (F.col("base") + F.col("i")).alias("start_line")).withColumn("end_line", F.col("start_line"))
    return _finding(at, "EMPTY_CATCH", "medium", F.lit(1))


def inspected(symbols: DataFrame, calls: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All findings of all rules."""
    out = long_methods(symbols).unionByName(many_parameters(symbols)).unionByName(god_classes(symbols)).unionByName(unresolved_calls(symbols, calls))
    return out if sources is None else out.unionByName(empty_catches(sources))


def class_callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(owner_id, caller_symbol_id, call_line): call sites of every callable member of each type."""
    members = symbols.where(is_callable(F.col("kind")) & F.col("parent_id").isNotNull()).select(F.col("id").alias("callee_symbol_id"), F.col("parent_id").alias("owner_id"))
    return calls.where("callee_symbol_id is not null").join(members, "callee_symbol_id").select("owner_id", "caller_symbol_id", "call_line").distinct()
