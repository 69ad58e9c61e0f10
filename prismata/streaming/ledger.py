"""Structured Streaming forms of the stateful parts: ledger append, job states, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import jobs, upsert


def answers(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The append-only ledger sink."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_answers(stream: DataFrame, key: str, at: str, period: str = "24 hours") -> DataFrame:
    """Answers whose key was not seen within the period: the cache's fresh ones."""
    return stream.withWatermark(at, period).dropDuplicatesWithinWatermark([key])


def usage_by_hour(stream: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Questions and refusals by hour and mode, final once the watermark has passed."""
    hourly = stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "mode")
    return hourly.agg(F.count("*").alias("n"), F.sum("refused").alias("refusals")).select(F.col("window.start").alias("hour"), "mode", "n", "refusals")


def job_states(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest state of each job, kept as a table; a replayed batch changes nothing.

    Each batch writes a new version folder named after the batch id and reads the one before.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = jobs(batch)
        if number:
            new = upsert(spark.read.parquet(f"{path}/v{number - 1}"), new, ["job_id"])
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_bad(stream: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Messages that parse, and those for the dead-letter folder."""
    both = stream.withColumn("parsed", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    first = F.col("parsed").getField(schema.split()[0])
    return both.where(first.isNotNull()), both.where(F.coalesce(first.isNull(), F.lit(True)))
