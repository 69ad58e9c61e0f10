"""Sharding along a Hilbert curve: sort by curve index, cut equal runs.

Three metadata dimensions are quantised to four bits each, in their order, so that runs have
narrow ranges of each: source and language by cuts between their distinct values, the text's
size by cuts between rows. A table of the 4,096 curve indexes is made by Skilling's transform
with SQL expressions and broadcast (its size is fixed by the bits).
Rows are ordered by (curve index, bucket, crc32 of the text, id); the bucket is a hash of
the crc32 and the id, so a cell that holds a third of all rows still spreads over many
tasks; their number grows with the rows. Global ranks come from counts: per cell, per bucket in its cell, per row in its
bucket; the first two are bounded tables, so no task ever holds all rows. The runs follow
the law `rows`: shard sizes differ by one row at most.

Nulls: a null text counts as no bytes and crc32 zero, a null dimension as its own value
zero; a null id sorts first. Very long texts are measured whole. Ties in the order are
repeated rows (or a hash collision of equal ids); they are placed in any order. An empty
table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

BITS = 4
DIMENSIONS = 3
#: The columns of the named dimensions, and the bytes of a value that its cuts tell apart.
NAMED, BYTES = ("source", "lang"), 7
#: Buckets of a cell, more of them when a bucket would hold more rows than these.
BUCKETS, BUCKET_ROWS = 512, 200_000


def _fixed_width(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def curve(spark: SparkSession, bits: int = BITS, dimensions: int = DIMENSIONS) -> DataFrame:
    """All cells of the grid with their Hilbert index: columns cell (dimension 0 highest) and h."""
    cells = spark.range(1 << (bits * dimensions), numPartitions=1).withColumnRenamed("id", "cell")
    x = F.array(*[_fixed_width(F.shiftright("cell", bits * (dimensions - 1 - d)), bits) for d in range(dimensions)])

    def flip_or_swap(a: Column, d: int, q: int) -> Column:
        """One step of the inverse undo for dimension d and bit q."""
        first, own = a[0], a[d]
        on = own.bitwiseAND(F.lit(q)) != 0
        t = first.bitwiseXOR(own).bitwiseAND(F.lit(q - 1))
        flipped = F.when(on, first.bitwiseXOR(F.lit(q - 1))).otherwise(first.bitwiseXOR(t))
        other = F.when(on, own).otherwise(own.bitwiseXOR(t))
        if d == 0:
            return F.array(flipped, *[a[k] for k in range(1, dimensions)])
        return F.array(flipped, *[other if k == d else a[k] for k in range(1, dimensions)])

    def encoded(a: Column, d: int) -> Column:
        return F.array(*[a[k].bitwiseXOR(a[k - 1]) if k == d else a[k] for k in range(dimensions)])

    def bind(df: DataFrame, f) -> DataFrame:
        """Apply a step; a higher-order function over one element evaluates its input once."""
        return df.select("cell", F.transform(F.array("x"), lambda a: f(a))[0].alias("x"))

    table = cells.select("cell", x.alias("x"))
    for b in range(bits - 1, 0, -1):
        for d in range(dimensions):
            table = bind(table, partial(flip_or_swap, d=d, q=1 << b))
    for d in range(1, dimensions):
        table = bind(table, partial(encoded, d=d))
    last = dimensions - 1

    def gray(a: Column) -> Column:
        t = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(a[last].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.array(*[a[k].bitwiseXOR(t) for k in range(dimensions)])

    table = bind(table, gray)
    h = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for d in range(dimensions):
            h = F.shiftleft(h, 1).bitwiseOR(_fixed_width(F.shiftright(F.col("x")[d], b), 1))
    return table.select("cell", h.alias("h"))


def _number(column: str, skip: int) -> Column:
    """BYTES bytes of a value from byte `skip` on, as a whole number in the order of the values."""
    digits = F.substring(F.hex(F.col(column).cast("string").cast("binary")), 2 * skip + 1, 2 * BYTES)
    return F.conv(F.rpad(digits, 2 * BYTES, "0"), 16, 10).cast("long")


def _levels(rows: DataFrame, column: str) -> Column:
    """The values of a column as 1 to 15 in their order, cut evenly between distinct values; null is 0.

    What reaches the driver is the least and the greatest value and 14 cuts.
    """
    ends = rows.agg(F.min(F.col(column).cast("string")).alias("a"), F.max(F.col(column).cast("string")).alias("b")).first()
    if ends["a"] is None:
        return F.lit(0)
    low, high = ends["a"].encode(), ends["b"].encode()
    skip = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    top = (1 << BITS) - 1
    values = rows.where(F.col(column).isNotNull()).select(_number(column, skip).alias("x")).distinct()
    cuts = sorted(set(values.agg(F.percentile_approx("x", [k / top for k in range(1, top)], 10_000).alias("c")).first()["c"]))
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < _number(column, skip)))
    # few values are spread over all levels, else they would differ in the lowest bits only
    return F.when(F.col(column).isNull(), 0).otherwise(F.floor(above * (top - 1) / len(cuts)) + 1)


def _sizes(rows: DataFrame) -> Column:
    """Sizes as 0 to 15, cut evenly between rows."""
    top = 1 << BITS
    cuts = rows.agg(F.percentile_approx("size", [k / top for k in range(1, top)], 10_000).alias("c")).first()["c"] or [0]
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("size")))


def shards(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, h, shard, slot): runs of the curve of equal row counts.

    size is the UTF-8 bytes of the text plus one; slots count from zero in each shard.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    named = [F.col(c).alias(f"d{k}") if c in docs.columns else F.lit(None).cast("string").alias(f"d{k}") for k, c in enumerate(NAMED)]
    # texts are read once; all that follows works on narrow rows
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("crc"), *named))
    place = F.lit(0).cast("long")
    for level in (*[_levels(rows, f"d{k}") for k in range(len(NAMED))], _sizes(rows)):
        place = F.shiftleft(place, BITS).bitwiseOR(level.cast("long"))
    buckets_of = max(BUCKETS, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("cell", place).join(F.broadcast(curve(spark)), "cell").withColumn("bucket", F.pmod(F.xxhash64("crc", "id"), F.lit(buckets_of)))
    counts = rows.groupBy("h", "bucket").agg(F.count("*").alias("n"))
    within = Window.partitionBy("h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # one row a cell: 4,096 at most
    per_cell = counts.groupBy("h").agg(F.sum("n").alias("in_cell"))
    along = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    per_cell = per_cell.select("h", F.coalesce(F.sum("in_cell").over(along), F.lit(0)).alias("start"), F.sum("in_cell").over(everywhere).alias("total"))
    offsets = buckets.join(F.broadcast(per_cell), "h").select("h", "bucket", (F.col("start") + F.col("ahead")).alias("before"), "total")
    in_bucket = Window.partitionBy("h", "bucket").orderBy("crc", F.col("id").asc_nulls_first())
    ranked = rows.withColumn("r", F.row_number().over(in_bucket) - 1).join(offsets, ["h", "bucket"]).withColumn("rank", F.col("before") + F.col("r"))
    base, more = F.floor(F.col("total") / n), F.pmod(F.col("total"), F.lit(n))
    # the first `more` shards hold one row more than the others
    cut = more * (base + 1)
    shard = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (base + 1))).otherwise(more + F.floor((F.col("rank") - cut) / F.greatest(base, F.lit(1))))
    first = shard * base + F.least(shard, more)
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "h", shard.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"))
