"""Graph operators over the call table: bounded reverse search, distances, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpointed


def direct_callers(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): distinct callers one hop away; seeds has a column seed."""
    edges = calls.where("callee_symbol_id is not null").select(F.col("callee_symbol_id").alias("seed"), F.col("caller_symbol_id").alias("node"))
    return edges.join(seeds, "seed").where("node <> seed").distinct()


#: Seeds of a row: LANES columns of 64 bits; and numbered seeds that may be broadcast.
LANES, SMALL_SEEDS = 4, 100_000
BITS = [f"b{k}" for k in range(LANES)]


def _numbered(seeds: DataFrame) -> DataFrame:
    """(seed, word, lane, bit): the row, and the bit in it, that stands for each distinct seed."""
    own = seeds.select("seed").where("seed is not null").distinct()
    blocks = max(1, -(-own.count() // (64 * 64 * LANES)))
    own = own.withColumn("block", F.pmod(F.xxhash64("seed"), F.lit(blocks)))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("seed")) - 1)
    place = F.col("place")
    return checkpointed(own.select("seed", F.struct("block", F.floor(place / (64 * LANES)).alias("part")).alias("word"), F.floor(place / 64).cast("int").alias("lane"), (place % 64).cast("int").alias("bit")).withColumn("lane", F.col("lane") % LANES))


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _has(bits: list[Column], lane: Column, bit: Column) -> Column:
    return F.element_at(F.array(*bits), lane + 1).bitwiseAND(_mask(bit)) != 0


def _or(names: list[str]) -> list[Column]:
    return [F.bit_or(b).alias(n) for b, n in zip(BITS, names)]


def _but(rows: DataFrame, taken: list[Column]) -> DataFrame:
    """`rows` without the bits that are taken; rows without bits are dropped."""
    left = {b: F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(x, F.lit(0).cast("long")))) for b, x in zip(BITS, taken)}
    return rows.withColumns(left).where(" or ".join(f"{b} <> 0" for b in BITS))


def _levels(calls: DataFrame, numbered: DataFrame, depth: int, lines: bool = False) -> DataFrame:
    """(node, word, hops, bits): transitive callers at their least distance from the seeds of a word.

    The bits say which seeds reach a node with so many hops: a row stands for up to 64 * LANES
    seeds, so rows grow with calls and not with pairs of a call and a seed. With `lines`, a
    row has the seeds whose nodes, one hop nearer, are first called at its line.

    Calls are first reduced to one row a pair, so that a frequent call moves once. Level by
    level the frontier joins them, and what was reached before drops out; each level but the
    last is cut off by a checkpoint, so the plan does not grow with the depth.
    """
    own = calls.where("callee_symbol_id is not null and caller_symbol_id <> callee_symbol_id")
    steps = own.groupBy(F.col("callee_symbol_id").alias("at"), F.col("caller_symbol_id").alias("node")).agg(F.min("call_line").alias("line"))
    if depth > 1:
        steps = checkpointed(steps)
    key, old = ["node", "word"], [f"_{b}" for b in BITS]
    earlier = Window.partitionBy(*key).orderBy(F.col("line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    seen = numbered.select(F.col("seed").alias("node"), "word", *[F.when(F.col("lane") == k, _mask(F.col("bit"))).otherwise(F.lit(0).cast("long")).alias(b) for k, b in enumerate(BITS)])
    frontier, out = seen.withColumnRenamed("node", "at"), None
    for d in range(1, depth + 1):
        met = frontier.join(steps, "at")
        # lines of a node are gathered where its window is, by one shuffle
        reached = (met.repartition(*key).groupBy(*key, "line") if lines else met.groupBy(*key)).agg(*_or(BITS))
        new = _but(reached.join(seen.groupBy(*key).agg(*_or(old)), key, "left"), [F.col(o) for o in old]).drop(*old)
        if lines:
            new = _but(new, [F.bit_or(b).over(earlier) for b in BITS])
        new = new.withColumn("hops", F.lit(d))
        new = checkpointed(new) if d < depth else new
        out = new if out is None else out.unionByName(new)
        seen = seen.unionByName(new.select(*key, *BITS))
        frontier = new.groupBy(F.col("node").alias("at"), "word").agg(*_or(BITS)) if lines else new.select(F.col("node").alias("at"), "word", *BITS)
    return out


def _by_seed(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """`rows` (word, bits, ...) once for each seed whose bit is set, with its lane and bit."""
    words = numbered.groupBy("word").agg(F.collect_list(F.struct("seed", "lane", "bit")).alias("seeds"))
    met = rows.join(F.broadcast(words) if numbered.count() <= SMALL_SEEDS else words, "word")
    there = F.filter("seeds", lambda s: _has([F.col(b) for b in BITS], s["lane"], s["bit"]))
    return met.withColumn("s", F.explode(there)).select("s.*", *[c for c in rows.columns if c not in ("word", *BITS)])


def reverse_search(calls: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node, hops): all transitive callers up to `depth`, at their least distance."""
    numbered = _numbered(seeds)
    return _by_seed(_levels(calls, numbered, depth), numbered).select("seed", "node", "hops")


def transitive_callers(calls: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node): the distinct nodes of reverse_search."""
    return _levels(calls, _numbered(seeds), depth).select("node").distinct()


def chain_only(calls: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, truth, direct, chain): callers in all, direct ones, and those only a chain finds."""
    reached = reverse_search(calls, seeds, depth).groupBy("seed").agg(F.count("*").alias("truth"), F.count_if(F.col("hops") == 1).alias("direct"))
    return reached.withColumn("chain", F.col("truth") - F.col("direct"))


def chain_call_sites(calls: DataFrame, symbols: DataFrame, files: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, site, callers): the first call site of every transitive caller, as path:line.

    All calls of a caller stand in its own file, so the first site is that of the least line.
    A site's names are collected for all seeds of a row at once.
    """
    numbered = _numbered(seeds)
    names = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("node"), "qualified_name", "path")
    rows = _levels(calls, numbered, depth, lines=True).join(names, "node")
    sites = rows.groupBy("word", F.concat_ws(":", "path", F.col("line").cast("string")).alias("site"), "qualified_name").agg(*_or(BITS))
    packed = F.array_sort(F.collect_list(F.struct("qualified_name", *[F.col(b).alias(f"_{b}") for b in BITS])))
    told = _by_seed(sites.groupBy("word", "site").agg(packed.alias("names"), *_or(BITS)), numbered)
    own = F.filter("names", lambda n: n["qualified_name"].isNotNull() & _has([n[f"_{b}"] for b in BITS], F.col("lane"), F.col("bit")))
    return told.select("seed", "site", F.array_join(F.transform(own, lambda n: n["qualified_name"]), ",").alias("callers"))


def sampled(pool: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """A sample that depends on the seed and the keys only, not on partitions."""
    return pool.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def chain_questions(calls: DataFrame, seed: int, n: int, pool: int = 200, depth: int = 3) -> DataFrame:
    """Targets among the most-called symbols whose callers need a chain to be found."""
    top = calls.where("resolved = 1").groupBy(F.col("callee_symbol_id").alias("seed")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "seed").limit(pool).select("seed")
    return sampled(chain_only(calls, top, depth).where("truth > direct"), "seed", seed, n)


def first_visits(steps: DataFrame, session: str, key: str, order: str) -> DataFrame:
    """Steps whose key is new in their session."""
    return steps.withColumn("visit", F.row_number().over(Window.partitionBy(session, key).orderBy(order)))
