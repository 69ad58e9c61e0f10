"""Cutting a plan's lineage by a table in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one machine (a local master) takes
    its own; a cluster has no folder that all see, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "prismata-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder of the session."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Bytes up to which a join may be broadcast by an estimate, and by a size measured at run time.
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """What runs within broadcasts no side of a join by its estimate, which is far too low for
    exploded arrays, parsed files and small files of many rows; adaptive execution still
    broadcasts what it has measured, up to the session's limit."""
    before = {k: spark.conf.get(k, None) for k in (ESTIMATED, MEASURED)}
    spark.conf.set(MEASURED, before[MEASURED] or spark.conf.get(ESTIMATED))
    spark.conf.set(ESTIMATED, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
