"""Column expressions over ``array<double>`` vectors, and vector aggregates."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(
        v, lambda u: let(norm(u), lambda size: F.when(size > 0, F.transform(u, lambda x: x / size)).otherwise(u))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side is a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def mean_vectors(df: DataFrame, key: str, vector: str, out: str = "centroid") -> DataFrame:
    """``<key, out, n>``: mean vector per key.

    Summarizer merges partial sums before the shuffle, so a key that holds most rows costs
    one buffer per partition and nothing more.
    """
    stats = Summarizer.metrics("mean", "count").summary(F.col("_v"))
    return (
        df.select(key, array_to_vector(as_doubles(F.col(vector))).alias("_v"))
        .groupBy(key)
        .agg(stats.alias("_s"))
        .select(key, vector_to_array(F.col("_s.mean")).alias(out), F.col("_s.count").alias("n"))
    )


def sum_vectors(df: DataFrame, key: str, vector: str, out: str = "total") -> DataFrame:
    """``<key, out, n>``: sum vector per key, with the same partial aggregation."""
    stats = Summarizer.metrics("sum", "count").summary(F.col("_v"))
    return (
        df.select(key, array_to_vector(as_doubles(F.col(vector))).alias("_v"))
        .groupBy(key)
        .agg(stats.alias("_s"))
        .select(key, vector_to_array(F.col("_s.sum")).alias(out), F.col("_s.count").alias("n"))
    )
