"""Indexing jobs as a stream: run once each, dead letters, progress and limits as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import _folder

#: States that a job does not leave, the kinds of tasks, the longest message.
TERMINAL = ("READY", "FAILED", "DONE")
KINDS = ("LOCAL", "GIT", "ARCHIVE")
MESSAGE = 500
JOB = "job_id long, type string, payload string, status string, message string, batch long"


def _there(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def _newest(spark: SparkSession, base: str, before: int) -> DataFrame | None:
    """The job table as the newest whole version before a batch left it."""
    at, fs = _folder(spark, f"{base}/jobs")
    if not fs.exists(at):
        return None
    done = [int(f.getPath().getName()[1:]) for f in fs.listStatus(at) if f.getPath().getName()[1:].isdigit()]
    done = [n for n in done if n < before and _there(spark, f"{base}/jobs/v{n}")]
    return spark.read.schema(JOB).parquet(f"{base}/jobs/v{max(done)}") if done else None


def present(spark: SparkSession, base: str) -> DataFrame:
    """The job table after the last whole batch."""
    own = _newest(spark, base, 1 << 62)
    return own if own is not None else spark.createDataFrame([], JOB)


def run_batch(tasks: DataFrame, number: int, base: str, work: Callable[[int, str, str], str], known: Callable[[SparkSession], DataFrame]) -> None:
    """One batch of tasks (job_id, type, payload).

    A job runs once: copies within the batch are one, jobs in a terminal state are passed
    over, and a batch whose table of jobs is whole was done before and changes nothing.
    `work` gives the message of a job that succeeds; an error fails the job, whose task, like
    one without a job or of an unknown kind, goes to the dead letters of the batch. Both
    outputs carry the batch's number, so an attempt that broke off is overwritten.
    """
    spark = tasks.sparkSession
    if _there(spark, f"{base}/jobs/v{number}"):
        return
    before = _newest(spark, base, number)
    before = before if before is not None else spark.createDataFrame([], JOB)
    own = tasks.groupBy("job_id").agg(F.min(F.struct("type", "payload")).alias("t")).select("job_id", "t.*")
    over = before.where(F.col("status").isin(*TERMINAL)).select("job_id")
    own = own.join(over, "job_id", "left_anti").join(known(spark).select("job_id", F.lit(True).alias("known")), "job_id", "left")
    results, dead = [], []
    # each task is a job of its own on the cluster; they are started one after the other
    for t in own.orderBy("job_id").toLocalIterator():
        try:
            if not t.known:
                raise LookupError(f"no job {t.job_id}")
            if t.type not in KINDS:
                raise ValueError(f"unknown kind of task {t.type}")
            results.append((t.job_id, t.type, t.payload, "READY", work(t.job_id, t.type, t.payload)[:MESSAGE], number))
        except Exception as e:  # noqa: BLE001
            reason = f"{type(e).__name__}: {e}"[:MESSAGE]
            dead.append((t.job_id, t.type, t.payload, "FAILED", reason, number))
            if t.known:
                results.append(dead[-1])
    new = spark.createDataFrame(results, JOB)
    spark.createDataFrame(dead, JOB).write.mode("overwrite").parquet(f"{base}/dead/v{number}")
    before.join(new.select("job_id"), "job_id", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{base}/jobs/v{number}")


def run(stream: DataFrame, base: str, checkpoint: str, work: Callable[[int, str, str], str], known: Callable[[SparkSession], DataFrame]) -> StreamingQuery:
    put = lambda batch, number: run_batch(batch, number, base, work, known)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(stream: DataFrame, key: str, order: list[str], step: Callable[[tuple | None, tuple], tuple[tuple, tuple | None]], state: str, out: str) -> DataFrame:
    """A running fold of each key's rows in order; its state is all that is kept between batches.

    step(state or None, row as a tuple in the order of `out`'s leading columns) gives the
    new state and a row to emit, or None. Within a batch rows come by `order`; the stream's
    batches are taken to be in order, as those of a log by key are.
    """
    columns = stream.columns

    def fold(_: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = kept.get if kept.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        emitted = []
        for row in rows[columns].itertuples(index=False, name=None):
            now, given = step(now, row)
            if given is not None:
                emitted.append(given)
        kept.update(now)
        if emitted:
            yield pd.DataFrame(emitted, columns=[c.strip().split()[0] for c in out.split(",")])

    return stream.groupBy(key).applyInPandasWithState(fold, out, state, "append", GroupStateTimeout.NoTimeout)


def allowed(requests: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """Token bucket on a stream of (client, at in seconds, id): a client's state is two numbers."""

    def step(now: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        client, at, number = row
        level = capacity if now is None else min(capacity, now[0] + (at - now[1]) * per_second)
        passed = level >= 1
        return (level - passed, at), (client, at, number, passed)

    return folded(requests.select("client", "at", "id"), "client", ["at", "id"], step, "level double, at double", "client long, at double, id long, allowed boolean")


def throttled(progress: DataFrame, every_ms: int = 300) -> DataFrame:
    """Progress rows (job_id, at in ms, done, total) that are written: a stage's first and last, else one an interval."""

    def step(now: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        job, at, done, total = row
        if done <= 1 or (total > 0 and done >= total) or now is None or at - now[0] >= every_ms:
            return (at,), (job, at, done, total)
        return now, None

    return folded(progress.select("job_id", "at", "done", "total"), "job_id", ["at", "done"], step, "at long", "job_id long, at long, done long, total long")


def stale(progress: DataFrame, after: str, late: str = "0 seconds") -> DataFrame:
    """(job_id, quiet_since) of jobs from which nothing came for `after`, once the watermark has passed."""
    sessions = progress.withWatermark("at", late).groupBy(F.session_window("at", after), "job_id").agg(F.max(F.struct("at", "status")).alias("last"))
    return sessions.where(~F.col("last.status").isin(*TERMINAL)).select("job_id", F.col("last.at").alias("quiet_since"))
