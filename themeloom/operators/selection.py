"""Projection, filter, limit and sampling operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import clip, snippet, word_count

OUTLIER = -1


def pick_text(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``<key, text>`` with the text as a string and null as empty."""
    return df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def limit_documents(df: DataFrame, count: int | None, key: str = "doc_id") -> DataFrame:
    """The first ``count`` documents by key; None or 0 keeps all."""
    return df.orderBy(key).limit(count) if count else df


def assigned(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Rows that belong to a topic."""
    return df.filter(F.col(topic) >= 0)


def with_word_count(df: DataFrame, text: str = "text", out: str = "n_words") -> DataFrame:
    return df.withColumn(out, word_count(F.col(text)))


def with_snippet(df: DataFrame, text: str = "text", out: str = "snippet", width: int = 120) -> DataFrame:
    return df.withColumn(out, snippet(F.col(text), width))


def with_excerpt(df: DataFrame, text: str = "text", out: str = "excerpt", width: int = 200) -> DataFrame:
    return df.withColumn(out, clip(F.col(text), width))


def shuffle_key(key: str, seed: int) -> Column:
    """A repeatable pseudo-random order that does not depend on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_sample(df: DataFrame, count: int | None, key: str = "doc_id", seed: int = 23) -> DataFrame:
    """Exactly ``min(count, rows)`` rows, the same ones on every run."""
    if count is None:
        return df
    return df.orderBy(shuffle_key(key, seed), key).limit(count)


def sample_per_topic(
    df: DataFrame, count: int, topic: str = "topic", key: str = "doc_id", seed: int = 23
) -> DataFrame:
    """Up to ``count`` repeatable rows per topic.

    Spark keeps only ``count`` rows of a topic per input partition before the shuffle
    (WindowGroupLimit), so one huge topic does not gather in one task.
    """
    order = Window.partitionBy(topic).orderBy(shuffle_key(key, seed), key)
    return assigned(df, topic).withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= count)


def plane_points(df: DataFrame, vector: str, key: str = "doc_id", check: bool = True) -> DataFrame:
    """First two coordinates of each vector as ``x`` and ``y``; other columns stay.

    With ``check``, one aggregate first verifies that all vectors share a width of two or more.
    """
    if check:
        seen = df.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
        if seen["low"] is not None:
            if seen["low"] != seen["high"]:
                raise ValueError(f"vectors differ in width: {seen['low']} to {seen['high']}")
            if seen["low"] < 2:
                raise ValueError(f"a chart takes vectors of two or more numbers, these have {seen['low']}")
    return df.withColumns(
        {"x": F.element_at(vector, 1).cast("double"), "y": F.element_at(vector, 2).cast("double")}
    )


def topic_label(topic: Column) -> Column:
    """Text shown for a topic."""
    return F.when(topic == OUTLIER, F.lit("Outlier")).otherwise(F.concat(F.lit("Topic "), topic.cast("string")))
