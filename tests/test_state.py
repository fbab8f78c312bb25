"""Keyed state over several batches: what a cache answers, which entries its timers remove, and jobs that fall silent."""

import datetime as dt
import random

from sparkloom.streaming import state

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def batches(spark, tmp_path, rows, schema, size):
    """rows as a stream of files, each a batch."""
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, mode):
    got = []
    df.writeStream.outputMode(mode).foreachBatch(lambda b, n: got.extend((n, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    return got


def test_cache_over_batches(spark, tmp_path):
    r, at, rows = random.Random(2), START, []
    for i in range(240):
        at += dt.timedelta(minutes=r.choice([0, 1, 7, 90]))
        rows.append((r.choice("abcde"), i, at))
    want, expires = {}, {}
    for key, i, at in rows:
        want[i] = key in expires and at <= expires[key]
        if not want[i]:
            expires[key] = at + dt.timedelta(hours=1)
    source = batches(spark, tmp_path, rows, "key string, id long, at timestamp", 60)
    got = run(state.cache_requests(source, 3_600_000, "2 hours"), tmp_path, "append")
    assert {i: hit for _, _, i, hit in got} == want and len(got) == len(rows) and any(want.values()) and len({n for n, *_ in got}) > 1


def test_last_moment_counts_and_late_requests_go(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("a", 1, at(0)), ("a", 2, at(60)), ("a", 3, at(61)), ("b", 4, at(1000)), ("c", 5, at(2000)), ("a", 6, at(10))]
    got = run(state.cache_requests(batches(spark, tmp_path, rows, "key string, id long, at timestamp", 1), 3_600_000, "1 minute"), tmp_path, "append")
    assert sorted((i, hit) for _, _, i, hit in got) == [(1, False), (2, True), (3, False), (4, False), (5, False)]


def test_silent_jobs_are_given_up(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("j", 1, at(0), "Progress: 10%"), ("k", 2, at(1), "step 1/2"), ("j", 3, at(2), "Cloning"), ("k", 4, at(3), "100%"), ("n", 5, at(4), "no news"), ("x", 6, at(500), "5%"), ("x", 7, at(1000), "6%"), ("j", 8, at(1001), "again 20%")]
    got = run(state.job_progress(batches(spark, tmp_path, rows, "job string, id long, at timestamp, value string", 1), 60 * 60_000, "1 minute"), tmp_path, "update")
    of = lambda job: [tuple(x[2:]) for x in got if x[1] == job]
    assert of("j") == [(10, None, 1, "running"), (10, "fetching", 2, "running"), (10, "fetching", 2, "failed"), (20, None, 1, "running")]
    assert of("k") == [(50, None, 1, "running"), (100, None, 2, "completed")] and of("n") == []
    assert of("x") == [(5, None, 1, "running"), (6, None, 2, "running")]  # the watermark lay at 499 minutes when it spoke again
