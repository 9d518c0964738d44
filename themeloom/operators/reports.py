"""Result tables of a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import word_count
from themeloom.operators.selection import OUTLIER
from themeloom.operators.weighting import nest_words


def topic_sizes(labels: DataFrame, topic: str = "topic") -> DataFrame:
    return labels.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))


def topic_info(labels: DataFrame, ranked: DataFrame, topic: str = "topic") -> DataFrame:
    """``<Topic, Count, Name, Representation, Top_words>``, largest first.

    Counts sum to the documents: a topic without ranked words appears with empty texts.
    """
    sizes = topic_sizes(labels, topic)
    nested = F.coalesce("words", F.array().cast("array<struct<word:string,score:double>>"))
    words = F.transform(F.col("words"), lambda w: w["word"])
    found = (
        sizes.filter(F.col(topic) != OUTLIER)
        .join(nest_words(ranked, topic), topic, "left")
        .withColumn("words", nested)
        .select(
            F.col(topic).cast("int").alias("Topic"),
            F.col("n").alias("Count"),
            F.array_join(F.slice(words, 1, 3), "_").alias("Name"),
            F.array_join(F.slice(words, 1, 5), ", ").alias("Representation"),
            F.col("words").alias("Top_words"),
        )
    )
    outliers = sizes.filter(F.col(topic) == OUTLIER).select(
        F.col(topic).cast("int").alias("Topic"),
        F.col("n").alias("Count"),
        # fixed values: the texts of the outlier row
        F.lit("Outliers").alias("Name"),
        F.lit("Documents not assigned to any topic").alias("Representation"),
        F.array().cast("array<struct<word:string,score:double>>").alias("Top_words"),
    )
    return found.unionByName(outliers).orderBy(F.desc("Count"), "Topic")


def document_info(docs: DataFrame, topic: str = "topic", key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(
        key,
        F.col(text).alias("Document"),
        F.col(topic).cast("int").alias("Topic"),
        word_count(F.col(text)).alias("Document_Length"),
    )


def topic_lines(ranked: DataFrame, count: int = 10, topic: str = "topic") -> DataFrame:
    """``<topic, line>``: words with three-digit scores, for printing."""
    shown = F.transform(F.col("words"), lambda w: F.format_string("%s (%.3f)", w["word"], w["score"]))
    return nest_words(ranked.filter(F.col("rank") <= count), topic).select(
        topic, F.array_join(shown, ", ").alias("line")
    )


def topics_over_time(
    df: DataFrame, timestamp: str, nr_bins: int = 10, topic: str = "topic", fill: bool = True
) -> DataFrame:
    """``<bin, bin_start, topic, n, share>``: topic prevalence in equal-width time bins.

    One bin if all times are equal. With ``fill``, topics absent from a bin get a zero row.
    The range is a scalar subquery; rows collapse to bins x topics before any shuffle.
    """
    stamped = df.select(F.unix_micros(F.col(timestamp).cast("timestamp")).alias("_us"), topic).filter(
        F.col("_us").isNotNull()
    )
    low = stamped.agg(F.min("_us")).scalar()
    width = stamped.agg(F.max("_us") - F.min("_us")).scalar()
    slot = F.least(F.floor((F.col("_us") - F.col("_low")) * nr_bins / F.col("_width")), F.lit(nr_bins - 1))
    counts = (
        stamped.withColumns({"_low": low, "_width": width})
        .withColumn("bin", F.when(F.col("_width") == 0, F.lit(0)).otherwise(slot).cast("int"))
        .groupBy("bin", topic)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if fill:
        last = F.when(F.col("_width") == 0, F.lit(0)).otherwise(F.lit(nr_bins - 1))
        cells = (
            counts.select(topic).distinct().withColumn("_width", width)
            .select(topic, F.explode(F.sequence(F.lit(0), last)).alias("bin"))
        )
        counts = cells.join(counts, ["bin", topic], "left").na.fill(0, ["n"])
    in_bin = F.sum("n").over(Window.partitionBy("bin"))
    return (
        counts.withColumns({"_all": in_bin, "_low": low, "_width": width})
        .select(
            "bin",
            F.timestamp_micros((F.col("_low") + F.floor(F.col("bin") * F.col("_width") / nr_bins)).cast("long")).alias(
                "bin_start"
            ),
            topic,
            "n",
            F.when(F.col("_all") > 0, F.col("n") / F.col("_all")).otherwise(0.0).alias("share"),
        )
    )
