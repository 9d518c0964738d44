"""Writing results."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.sources import feather


def write_vectors(df: DataFrame, path: str, columns: list[str] | None = None) -> str:
    """Vectors as parquet; the suffix is added when missing."""
    target = path if path.rstrip("/").endswith(".parquet") else path.rstrip("/") + ".parquet"
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(target)
    return target


def write_topic_info(info: DataFrame, path: str) -> None:
    """Topic summary as CSV; the nested word list becomes JSON text."""
    flat = info.withColumn("Top_words", F.to_json("Top_words"))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_document_info(info: DataFrame, path: str) -> None:
    info.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_parameters(spark: SparkSession, parameters: dict, path: str) -> None:
    """Run parameters as one JSON record."""
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Each output file is one JSON array of records, written without gathering rows in memory."""
    columns = df.columns
    position = df.select(
        F.monotonically_increasing_id().alias("_i"), F.to_json(F.struct(*columns)).alias("_j")
    )
    first = F.shiftright(F.col("_i"), 33) != F.shiftright(F.col("_i") - 1, 33)
    rows = position.select(F.when(first, F.concat(F.lit("["), "_j")).otherwise(F.concat(F.lit(","), "_j")).alias("value"))

    def close(batches):
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                yield batch
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    rows.mapInArrow(close, "value string").write.mode("overwrite").text(path)


def write_feather(df: DataFrame, path: str, overwrite: bool = True, compression: str = "lz4") -> None:
    """One Arrow file a partition; the files appear together when all of them are written."""
    feather.register(df.sparkSession)
    writer = df.write.format(feather.FORMAT).mode("overwrite" if overwrite else "append")
    writer.option("compression", compression).save(path)


def run_stamp(now: datetime | None = None) -> str:
    """Name of a run, from its start time."""
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def append_run(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """Add one run's rows to a table partitioned by run."""
    stamp = run_id or run_stamp()
    df.withColumn("run_id", F.lit(stamp)).write.mode("append").partitionBy("run_id").parquet(path)
    return stamp
