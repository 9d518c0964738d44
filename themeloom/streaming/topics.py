"""Topics of a stream: nearest-centroid assignment and windowed counts with bounded state.

A stream is read in micro-batches from the files of a folder, deduplicated and counted per event-time window and topic. A
watermark bounds what is remembered: a window stays open until the stream's clock (its latest event time less
the allowed delay) has passed its end; rows that come after that, by the clock that the batch before them had, are dropped and
counted as late. The counts of a window are
written again whenever a batch changes them; ``read_counts`` keeps the last word on each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from themeloom.session import scratch_path


@dataclass(frozen=True)
class Clock:
    """How a stream's time is cut: windows of ``width`` every ``slide`` (default: side by side), rows up to ``delay`` late."""

    timestamp: str = "ts"
    width: str = "1 day"
    slide: str | None = None
    delay: str = "1 day"

    def window(self) -> Column:
        return F.window(self.timestamp, self.width, self.slide)


def read_files(spark: SparkSession, path: str, schema: StructType | str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder, or over one file; the schema is that of the files there now, if not given."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).schema if schema is None else schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # a file stream watches folders
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def assign_nearest(rows: DataFrame, centroids: DataFrame, vector: str = "embedding", topic: str = "topic", farthest: float | None = None) -> DataFrame:
    """Adds ``topic``: that of the nearest of the ``centroids <topic, centroid>`` (ties: the smallest), for streams and tables alike.

    Rows without a vector, of another width, or farther than ``farthest`` from every centroid get -1. The centroids, one row a
    topic, go to every task.
    """
    held = sorted((int(r[0]), [float(x) for x in r[1]]) for r in centroids.select(topic, "centroid").collect())
    names = np.array([t for t, _ in held], np.int32)
    table = np.array([c for _, c in held], np.float64)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), -1, np.int32)
            fits = np.array([v is not None and len(v) == table.shape[-1] for v in batch], bool) if len(table) else np.zeros(len(batch), bool)
            at = np.flatnonzero(fits)
            for low in range(0, len(at), 1024):
                some = at[low : low + 1024]
                vectors = np.stack([np.asarray(batch.iloc[i], np.float64) for i in some])
                # differences rather than products: near ties must not hang on rounding
                apart = np.stack([((vectors - c) ** 2).sum(1) for c in table], axis=1)
                best = apart.argmin(1)
                near = np.isfinite(apart.min(1))
                if farthest is not None:
                    near &= apart.min(1) <= farthest**2
                out[some[near]] = names[best[near]]
            yield pd.Series(out)

    return rows.withColumn(topic, nearest(F.col(vector)))


def windowed_counts(stream: DataFrame, clock: Clock, topic: str = "topic", key: str | None = None) -> DataFrame:
    """``<window_start, window_end, topic, n>`` of a stream, each window open as long as the clock allows.

    With ``key`` a row that repeats a key within the delay counts once, and a row that is itself later than the delay is dropped even
    where its window is open. Rows without a time are dropped. State is one row for each open window and topic, and one for
    each key of the delay.
    """
    timed = stream.withColumn(clock.timestamp, F.col(clock.timestamp).cast("timestamp")).filter(F.col(clock.timestamp).isNotNull())
    timed = timed.withWatermark(clock.timestamp, clock.delay)
    if key:
        timed = timed.dropDuplicatesWithinWatermark([key])
    counts = timed.groupBy(clock.window().alias("w"), topic).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), topic, "n")


@dataclass(frozen=True)
class Run:
    """Where a finished run left its counts, its micro-batches, and the rows its watermark dropped."""

    path: str
    batches: int
    late: int


def run_to_end(counts: DataFrame, path: str | None = None, checkpoint: str | None = None) -> Run:
    """Process everything that has arrived, then stop; with the same ``checkpoint`` a later call goes on from there.

    Each micro-batch writes the windows it changed below its own number, so a batch that is run again after a failure
    replaces its first attempt.
    """
    spark = counts.sparkSession
    path = path or scratch_path(spark, "stream")
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    query: StreamingQuery = (
        counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.numInputRows or p.stateOperators]
    late = sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)
    return Run(path, len({p.batchId for p in progress}), late)


def read_counts(spark: SparkSession, path: str, topic: str = "topic") -> DataFrame:
    """``<window_start, window_end, topic, n, share>``: the last count written for each window and topic, and its share of the window."""
    keys = ["window_start", "window_end", topic]
    last = spark.read.parquet(path).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("window_start", "window_end"))
    return last.select(*keys, "n", (F.col("n") / whole).alias("share"))


def topics_of_stream(stream: DataFrame, clock: Clock, topic: str = "topic", key: str | None = None, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The counts and shares of all windows once everything that has arrived is processed."""
    done = run_to_end(windowed_counts(stream, clock, topic, key), path, checkpoint)
    return read_counts(stream.sparkSession, done.path, topic)
