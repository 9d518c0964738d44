"""Streams against their batch results, with late, repeated and incomplete rows."""

import os
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from themeloom.session import scratch_path
from themeloom.streaming import topics as streams

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
SCHEMA = "id long, ts timestamp, topic int"


def at(hours):
    return START + timedelta(hours=hours)


def drop_files(spark, base, batches):
    """Each batch as one file; file times say in which order they arrive."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/part{i}")
        (name,) = [f for f in os.listdir(f"{base}/part{i}") if f.endswith(".parquet")]
        os.makedirs(f"{base}/in", exist_ok=True)
        os.rename(f"{base}/part{i}/{name}", f"{base}/in/{i}.parquet")
        os.utime(f"{base}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return f"{base}/in"


def counts_of(df):
    return {(r.window_start.replace(tzinfo=timezone.utc), r.topic): r.n for r in df.collect()}


def expected(batches, width, delay, slide=None, once=False):
    """The counts by the rules of the watermark, and how many rows are late."""
    # Spark drops rows by the clock that the batch before already had
    clock, coming, seen, counts, late = None, None, set(), Counter(), 0
    slide = slide or width
    for rows in batches:
        for key, ts, topic in rows:
            if ts is None:
                continue
            hours = (ts - START) / timedelta(hours=1)
            if once:
                if clock is not None and ts <= clock:
                    late += 1
                    continue
                if key in seen:
                    continue
                seen.add(key)
            first = int(hours // slide) * slide
            for begin in range(first, first - width, -slide):
                if clock is not None and at(begin + width) <= clock:
                    late += 1
                else:
                    counts[at(begin), topic] += 1
        times = [ts for _, ts, _ in rows if ts is not None]
        clock = coming
        if times:
            coming = max([*([coming] if coming else []), max(times) - timedelta(hours=delay)])
    return dict(counts), late


@pytest.fixture(scope="module")
def batches():
    rows = [[(i, at(i * 0.7), i % 3) for i in range(20)], [(20 + i, at(14 + i * 0.5), i % 2) for i in range(30)], [(50 + i, at(40 + i), 1) for i in range(12)]]
    # late beyond the delay, late within it, repeated within and across batches, without a time
    rows[1] += [(200, at(12.9), 0), (201, None, 1), (25, at(16.5), 1), (25, at(16.5), 1)]
    rows[2] += [(300, at(2), 2), (301, at(26), 2), (30, at(19), 0), (302, at(26.5), None)]
    return rows


@pytest.mark.parametrize("slide", [None, 3])
def test_windows_with_late_rows(spark, tmp_path, batches, slide):
    path = drop_files(spark, str(tmp_path), batches)
    stream = streams.read_files(spark, path, files_per_batch=1)
    clock = streams.Clock("ts", "6 hours", f"{slide} hours" if slide else None, "2 hours")
    done = streams.run_to_end(streams.windowed_counts(stream, clock))
    want, late = expected(batches, 6, 2, slide)
    assert counts_of(streams.read_counts(spark, done.path)) == want
    assert late > 0 and done.late > 0 and done.batches >= 3


def test_each_key_once(spark, tmp_path, batches):
    path = drop_files(spark, str(tmp_path), batches)
    stream = streams.read_files(spark, path, files_per_batch=1)
    found = streams.topics_of_stream(stream, streams.Clock("ts", "6 hours", None, "30 hours"), key="id")
    want, _ = expected(batches, 6, 30, once=True)
    assert counts_of(found) == want
    shares = found.groupBy("window_start").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)


def test_a_later_run_goes_on_where_the_first_stopped(spark, tmp_path, batches):
    out, state = scratch_path(spark, "counts"), scratch_path(spark, "state")
    path = drop_files(spark, str(tmp_path / "a"), batches[:2])
    clock = streams.Clock("ts", "6 hours", None, "100 hours")

    def run():
        return streams.run_to_end(streams.windowed_counts(streams.read_files(spark, path, SCHEMA), clock), out, state)

    run()
    before = counts_of(streams.read_counts(spark, out))
    assert before == expected(batches[:2], 6, 100)[0]
    more = drop_files(spark, str(tmp_path / "b"), [batches[2]])
    os.rename(f"{more}/0.parquet", f"{path}/9.parquet")
    run()
    assert counts_of(streams.read_counts(spark, out)) == expected(batches, 6, 100)[0]
    # nothing new: nothing changes
    run()
    assert counts_of(streams.read_counts(spark, out)) == expected(batches, 6, 100)[0]


def test_nearest_centroid(spark):
    centroids = spark.createDataFrame([(5, [0.0, 0.0]), (2, [4.0, 0.0]), (9, [0.0, 9.0])], "topic int, centroid array<double>")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 8.0]), (4, None), (5, [1.0]), (6, [float("nan"), 0.0]), (7, [100.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {r.id: r.topic for r in streams.assign_nearest(df, centroids).collect()}
    assert got == {1: 5, 2: 2, 3: 9, 4: -1, 5: -1, 6: -1, 7: 2}
    near = {r.id: r.topic for r in streams.assign_nearest(df, centroids, farthest=2.0).collect()}
    assert near == {**got, 7: -1}
    assert {r.topic for r in streams.assign_nearest(df, centroids.limit(0)).collect()} == {-1}
