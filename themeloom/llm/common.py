"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.session import scratch_path

#: Separators between words: blank and tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def python_ready(df: DataFrame) -> SparkSession:
    """Make this package importable in Python workers.

    Task functions import what they use from it, so a worker keeps its caches from task to task.
    """
    spark = df.sparkSession
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def stored(df: DataFrame, name: str = "step", compression: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Lost executors replay from the table, and rows keep the values they were given.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold_out(doc_id: str = "doc_id", modulus: int = 10):
    """crc32 of the id as text, modulo ``modulus``; a null id gives null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def ascii_lower(text):
    """A-Z to lower case, all other characters unchanged.

    ``lower`` treats text of one byte per character the same way and is much faster.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def let(value, body):
    """``body`` over a value that is worked out once for the row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text, separators: str = BLANKS):
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")
