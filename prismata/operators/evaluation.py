"""Deterministic evaluation: question sets, set grading, recall by spans, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_type
from .evidence import spans

HIT = 0.999


def key(file: Column, line: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"))


def graded(answers: DataFrame) -> DataFrame:
    """Precision, recall, F1 and hit of claimed against truth keys (two arrays).

    LOCATE hits when all truth is claimed, whatever else is; an empty truth is a miss.
    """
    both = F.size(F.array_intersect("truth", "claimed")).cast("double")
    p = F.when(F.size("claimed") > 0, both / F.size(F.array_distinct("claimed"))).otherwise(0.0)
    r = F.when(F.size("truth") > 0, both / F.size(F.array_distinct("truth"))).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    empty, locate = F.size("truth") == 0, F.col("qtype") == "LOCATE"
    found = r == 1.0
    one = F.when(found, 1.0).otherwise(0.0)
    pick = lambda x: F.when(empty, 0.0).when(locate, one).otherwise(x)
    out = answers.withColumns({"precision": pick(p), "recall": pick(r), "f1": pick(f1)})
    return out.withColumn("hit", F.when(empty, False).when(locate, found).otherwise(F.col("f1") >= HIT))


def report(results: DataFrame) -> DataFrame:
    """By question type and in all: counts by outcome, hit rate, mean F1 of graded ones, mean latency.

    Columns of results: qtype, status (ANSWERED, REFUSED, FAILED), hit, f1, latency_ms.
    """
    said = F.col("status") == "ANSWERED"
    agg = [F.count("*").alias("total"), F.count_if(said).alias("answered"), F.count_if(F.col("status") == "REFUSED").alias("refused"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(said & F.col("hit")).alias("hits"), F.avg(F.when(said, F.col("f1"))).alias("avg_f1"), F.avg("latency_ms").alias("avg_latency")]
    out = results.rollup("qtype").agg(*agg)
    return out.select(F.coalesce("qtype", F.lit("ALL")).alias("qtype"), "total", "answered", "refused", "failed", "hits", (F.col("hits") / F.col("total")).alias("hit_rate"), F.coalesce("avg_f1", F.lit(0.0)).alias("avg_f1"), "avg_latency")


def span_scores(keys: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, recall, precision): truth keys inside a hit; hits around a key."""
    found = spans(keys, hits)
    r = found.select("question_id", "key").distinct().groupBy("question_id").agg(F.count("*").alias("k"))
    p = found.select("question_id", "hit_id").distinct().groupBy("question_id").agg(F.count("*").alias("h"))
    all_k = keys.groupBy("question_id").agg(F.count_distinct("key").alias("keys"))
    all_h = hits.groupBy("question_id").agg(F.count_distinct("id").alias("hits"))
    out = all_k.join(all_h, "question_id", "left").join(r, "question_id", "left").join(p, "question_id", "left")
    return out.select("question_id", (F.coalesce("k", F.lit(0)) / F.col("keys")).alias("recall"), F.when(F.col("hits") > 0, F.coalesce("h", F.lit(0)) / F.col("hits")).otherwise(0.0).alias("precision"))


def compared(vector: DataFrame, routed: DataFrame) -> DataFrame:
    """Two result sets side by side on their question."""
    cols = ["recall", "precision", "f1", "latency_ms"]
    side = lambda df, s: df.select("question_id", "qtype", *[F.col(c).alias(f"{s}_{c}") for c in cols])
    return side(vector, "vector").join(side(routed, "route"), ["question_id", "qtype"])


def comparison(pairs: DataFrame) -> DataFrame:
    means = [F.avg(c).alias(c) for c in pairs.columns if c.startswith(("vector_", "route_"))]
    return pairs.rollup("qtype").agg(F.count("*").alias("n"), *means).withColumn("qtype", F.coalesce("qtype", F.lit("ALL")))


def unique_names(symbols: DataFrame) -> DataFrame:
    """Symbols whose name no other symbol has."""
    once = symbols.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")
    return symbols.join(once, "name", "left_semi")


def identifiable(symbols: DataFrame) -> DataFrame:
    """Members whose name is unique in their owner, whose owner's name is unique among types."""
    types = symbols.where(is_type(F.col("kind")))
    owners = types.join(types.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name"), "name", "left_semi").select(F.col("id").alias("parent_id"), F.col("name").alias("owner_name"))
    once = symbols.where("parent_id is not null").groupBy("parent_id", "name").agg(F.count("*").alias("n")).where("n = 1").select("parent_id", "name")
    return symbols.join(once, ["parent_id", "name"], "left_semi").join(owners, "parent_id")


def questions(symbols: DataFrame, files: DataFrame, calls: DataFrame, relations: DataFrame, seed: int, n: int) -> DataFrame:
    """(qtype, target_id, truth): n questions of each of five types, truth as sorted keys.

    The order of a pool is a hash of seed and id, so equal seeds give equal questions.
    """
    place = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("nid"), "path", "start_line", "parent_id")
    here = key(F.col("path"), F.col("start_line"))
    named = unique_names(symbols)
    locate = named.select(F.col("id").alias("target_id")).join(place, F.col("target_id") == F.col("nid")).select("target_id", here.alias("k"))
    callable_ = identifiable(symbols).where(F.col("kind").isin("METHOD", "CONSTRUCTOR")).select(F.col("id").alias("target_id"))
    up = callable_.join(calls.select(F.col("callee_symbol_id").alias("target_id"), F.col("caller_symbol_id").alias("nid"), "call_line"), "target_id").join(place, "nid").select("target_id", key(F.col("path"), F.col("call_line")).alias("k"))
    down = callable_.join(calls.where("resolved = 1").select(F.col("caller_symbol_id").alias("target_id"), F.col("callee_symbol_id").alias("nid")), "target_id").join(place, "nid").select("target_id", here.alias("k"))
    types = named.where(is_type(F.col("kind"))).select(F.col("id").alias("target_id"))
    kids = types.join(place.withColumnRenamed("parent_id", "target_id"), "target_id").select("target_id", here.alias("k"))
    impl = types.join(relations.select(F.col("super_symbol_id").alias("target_id"), F.col("sub_symbol_id").alias("nid")), "target_id").join(place, "nid").select("target_id", here.alias("k"))
    out = None
    for name, truth in (("LOCATE", locate), ("CALLERS", up), ("CALLEES", down), ("STRUCTURE", kids), ("IMPLEMENTS", impl)):
        own = truth.groupBy("target_id").agg(F.array_sort(F.collect_set("k")).alias("truth")).orderBy(F.xxhash64(F.lit(seed), F.lit(name), F.col("target_id")), "target_id").limit(n)
        own = own.select(F.lit(name).alias("qtype"), "target_id", "truth")
        out = own if out is None else out.unionByName(own)
    return out


def chain_metrics(runs: DataFrame) -> DataFrame:
    """By mode: mean recall of found against truth (arrays), questions, mean seconds."""
    recall = F.when(F.size("truth") > 0, F.size(F.array_intersect("truth", "found")) / F.size("truth")).otherwise(0.0)
    return runs.groupBy("mode").agg(F.count("*").alias("n"), F.avg(recall).alias("recall"), F.avg("seconds").alias("seconds"))


def fingerprint(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Order-free digest of an index: equal for equal builds, whatever their ids.

    Each symbol counts as kind:name:path:line:parent; hashes are summed, so nothing is sorted
    or gathered.
    """
    parent = symbols.select(F.col("id").alias("parent_id"), F.col("qualified_name").alias("parent_name"))
    own = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").join(parent, "parent_id", "left")
    line = F.concat_ws(":", "kind", "qualified_name", "path", F.col("start_line").cast("string"), F.coalesce("parent_name", F.lit("-")))
    low = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    high = F.conv(F.substring(F.md5(line), 9, 8), 16, 10).cast("long")
    return own.agg(F.count("*").alias("symbols"), F.sum(low).alias("low"), F.sum(high).alias("high"))


