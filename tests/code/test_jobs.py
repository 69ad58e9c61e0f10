"""Streams of jobs: once each, dead letters, throttled progress, token buckets, quiet jobs."""

import random

from pyspark.sql import functions as F

from prismata.operators import control
from prismata.streaming import jobs

TASK = "job_id long, type string, payload string"


def test_jobs_run_once(spark, tmp_path):
    base, ran = str(tmp_path / "base"), []

    def work(job, kind, payload):
        ran.append(job)
        if payload == "bad":
            raise RuntimeError("x" * 900)
        return f"{kind} {payload}"

    known = lambda s: s.range(1, 8).withColumnRenamed("id", "job_id")
    one = spark.createDataFrame([(1, "LOCAL", "a"), (1, "LOCAL", "a"), (2, "GIT", "bad"), (3, "ODD", "c"), (99, "LOCAL", "d")], TASK)
    jobs.run_batch(one, 0, base, work, known)
    assert ran == [1, 2]
    got = {r.job_id: (r.status, r.message) for r in jobs.present(spark, base).collect()}
    assert got[1] == ("READY", "LOCAL a") and got[2][0] == got[3][0] == "FAILED" and len(got[2][1]) == jobs.MESSAGE and 99 not in got
    letters = lambda n: {r.job_id for r in spark.read.parquet(f"{base}/dead/v{n}").collect()}
    assert letters(0) == {2, 3, 99}
    jobs.run_batch(one, 0, base, work, known)  # the batch again
    assert ran == [1, 2]
    jobs.run_batch(spark.createDataFrame([(1, "LOCAL", "a"), (2, "GIT", "ok"), (4, "ARCHIVE", "z")], TASK), 3, base, work, known)
    assert ran == [1, 2, 4] and letters(3) == set()  # terminal jobs are passed over, numbers may have gaps
    assert {r.job_id: r.batch for r in jobs.present(spark, base).collect()} == {1: 0, 2: 0, 3: 0, 4: 3}

    broken = spark.createDataFrame([(5, "LOCAL", "a")], TASK)
    spark.createDataFrame([(5, "LOCAL", "a", "FAILED", "half", 4)], jobs.JOB).write.parquet(f"{base}/dead/v4")  # an attempt that broke off
    jobs.run_batch(broken, 4, base, work, known)
    assert letters(4) == set() and ran[-1] == 5


def test_the_stream_of_jobs(spark, tmp_path):
    src, base, ran = str(tmp_path / "in"), str(tmp_path / "base"), []
    spark.createDataFrame([(1, "LOCAL", "a"), (2, "LOCAL", "b")], TASK).coalesce(1).write.parquet(src)
    known = lambda s: s.range(10).withColumnRenamed("id", "job_id")
    work = lambda job, kind, payload: ran.append(job) or "done"
    for _ in range(2):
        stream = spark.readStream.schema(TASK).parquet(src)
        jobs.run(stream, base, str(tmp_path / "check"), work, known).awaitTermination()
        assert sorted(ran) == [1, 2]
    spark.createDataFrame([(2, "LOCAL", "b"), (3, "LOCAL", "c")], TASK).coalesce(1).write.mode("append").parquet(src)
    jobs.run(spark.readStream.schema(TASK).parquet(src), base, str(tmp_path / "check"), work, known).awaitTermination()
    assert sorted(ran) == [1, 2, 3]


def _streamed(spark, tmp_path, name, batches, schema, plan):
    """Rows of a streaming plan over batches that arrive one after the other."""
    src, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = plan(spark.readStream.schema(schema).parquet(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def test_token_bucket_state_equals_the_whole_fold(spark, tmp_path):
    r = random.Random(1)
    rows = sorted((r.randrange(3), float(r.randrange(4000)), k) for k in range(300))
    rows.sort(key=lambda x: (x[1], x[2]))
    schema = "client long, at double, id long"
    got = _streamed(spark, tmp_path, "bucket", [rows[:100], rows[100:180], rows[180:]], schema, lambda s: jobs.allowed(s, 5.0, 0.01))
    whole = control.allowed(spark.createDataFrame(rows, schema), "client", "at", 5.0, 0.01, "id").select("client", "at", "id", "allowed")
    assert got == sorted(map(tuple, whole.collect())) and len({x[3] for x in got}) == 2


def test_progress_is_throttled(spark, tmp_path):
    rows = [(1, t, 1 + t // 40, 60) for t in range(0, 2400, 40)] + [(2, 5, 1, 0), (2, 10, 2, 0), (2, 400, 3, 0)]
    rows.sort(key=lambda x: (x[1], x[0]))
    got = _streamed(spark, tmp_path, "progress", [rows[:20], rows[20:]], "job_id long, at long, done long, total long", jobs.throttled)
    want, last = [], {}
    for job, at, done, total in rows:
        if done <= 1 or (total and done >= total) or at - last.get(job, -10**9) >= 300:
            last[job] = at
            want.append((job, at, done, total))
    assert got == sorted(want) and 9 < len(got) < 15


def test_quiet_jobs_are_found(spark, tmp_path):
    src = str(tmp_path / "quiet")
    rows = [(1, 0, "RUNNING"), (1, 100, "RUNNING"), (2, 0, "RUNNING"), (2, 500, "READY"), (3, 4000, "RUNNING")]
    spark.createDataFrame(rows, "job_id long, s long, status string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("job_id long, s long, status string").parquet(src).withColumn("at", F.timestamp_seconds("s"))
    out = str(tmp_path / "quiet-out")
    for extra in (None, [(9, 9000, "RUNNING")]):
        if extra:
            spark.createDataFrame(extra, "job_id long, s long, status string").coalesce(1).write.mode("append").parquet(src)
        jobs.stale(stream, "600 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start().awaitTermination()
    assert {(r.job_id, r.quiet_since.timestamp() % 86400) for r in spark.read.parquet(out).collect()} == {(1, 100.0), (3, 4000.0)}
