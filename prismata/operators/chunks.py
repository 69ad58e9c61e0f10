"""Cutting source and text files into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_type, line_slice, lines, token_estimate

LINES = 60


def text_chunks(files: DataFrame, size: int = LINES) -> DataFrame:
    """(path, start_line, end_line, content, content_hash, token_estimate) of plain files."""
    own = files.withColumn("l", lines(F.col("content")))
    starts = F.when(F.size("l") > 0, F.sequence(F.lit(0), F.size("l") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cut = own.select("path", "l", F.explode(starts).alias("s"))
    cut = cut.select("path", (F.col("s") + 1).cast("long").alias("start_line"), F.least(F.col("s") + size, F.size("l")).cast("long").alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, F.lit(size)), "\n").alias("content"))
    return cut.where(F.trim(F.regexp_replace("content", r"\s+", "")) != "").withColumns({"content_hash": F.sha2("content", 256), "token_estimate": token_estimate(F.col("content"), 3)})


def symbol_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One chunk for each member, and one header for each file up to its first member.

    files: path, content; symbols: path, kind, qualified_name, start_line, end_line.
    """
    src = files.select("path", lines(F.col("content")).alias("l"))
    members = symbols.where(~is_type(F.col("kind")))
    own = members.join(src, "path").select("path", F.lit("SYMBOL").alias("kind"), "qualified_name", "start_line", "end_line", line_slice(F.col("l"), F.col("start_line"), F.col("end_line")).alias("content"))
    first = members.groupBy("path").agg((F.min("start_line") - 1).alias("end_line"))
    head = src.join(first, "path", "left").withColumn("end_line", F.coalesce("end_line", F.size("l").cast("long")))
    head = head.select("path", F.lit("FILE_HEADER").alias("kind"), F.lit(None).cast("string").alias("qualified_name"), F.lit(1).cast("long").alias("start_line"), "end_line", line_slice(F.col("l"), F.lit(1), F.col("end_line")).alias("content"))
    out = own.unionByName(head).where(F.trim(F.coalesce("content", F.lit(""))) != "")
    return out.withColumns({"content_hash": F.sha2("content", 256), "token_estimate": token_estimate(F.col("content"))})


def window(files: DataFrame, path: str, first: int | None = None, last: int | None = None, most: int = 400) -> DataFrame:
    """(line, text, changed): at most `most` lines of one file; changed: other text than indexed."""
    if path.startswith("/") or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"the path leaves the repository: {path}")
    lo = max(1, first or 1)
    hi = min(last or lo + most - 1, lo + most - 1)
    own = files.where(F.col("path") == path).select(F.posexplode(lines(F.col("content"))).alias("i", "text"), (F.sha2("content", 256) != F.col("content_hash")).alias("changed"))
    return own.select((F.col("i") + 1).alias("line"), "text", "changed").where(F.col("line").between(lo, hi)).orderBy("line")
