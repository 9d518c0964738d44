"""Tables ready for plotting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import snippet
from themeloom.operators.selection import plane_points, seeded_sample, topic_label

LEGEND_TOPICS = 25


def points_2d(
    points: DataFrame,
    vector: str = "reduced",
    key: str = "doc_id",
    topic: str | None = "topic",
    text: str | None = "text",
    max_points: int | None = 12000,
    seed: int = 23,
) -> DataFrame:
    """``<key, x, y[, snippet][, topic, label, colour]>`` for a scatter plot.

    ``colour`` is the topic number when there are more than 25 topics (null for outliers) and
    null otherwise, when ``label`` serves as legend. Sampling ranks keys alone.
    """
    plane = plane_points(points, vector, key)
    columns = [key, "x", "y"]
    if text:
        plane = plane.withColumn("snippet", snippet(F.col(text)))
        columns.append("snippet")
    if topic:
        topics = points.filter(F.col(topic) != -1).select(topic).distinct().agg(F.count(F.lit(1))).scalar()
        plane = plane.withColumn("label", topic_label(F.col(topic))).withColumn("_n", topics)
        many = (F.col("_n") > LEGEND_TOPICS) & (F.col(topic) >= 0)
        plane = plane.withColumn("colour", F.when(many, F.col(topic)))
        columns += [topic, "label", "colour"]
    plane = plane.select(*columns)
    if max_points is None:
        return plane
    chosen = seeded_sample(points.select(key), max_points, key, seed)
    return plane.join(chosen, key, "left_semi")


def topic_distribution(labels: DataFrame, top_n: int = 25, topic: str = "topic") -> DataFrame:
    """``<topic, label, n, outliers>``: the largest topics beside the outlier total."""
    sizes = labels.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    outliers = labels.filter(F.col(topic) == -1).agg(F.count(F.lit(1))).scalar()
    best = sizes.filter(F.col(topic) != -1).orderBy(F.desc("n"), topic).limit(top_n)
    return best.select(topic, topic_label(F.col(topic)).alias("label"), "n").withColumn("outliers", outliers)


def topic_words_bar(ranked: DataFrame, topic_id: int, count: int = 12, topic: str = "topic") -> DataFrame:
    """``<word, score>`` of one topic, lowest score first."""
    held = ranked.filter((F.col(topic) == topic_id) & (F.col("rank") <= count))
    if not held.head(1):
        raise ValueError(f"topic {topic_id} not found or without words")
    return held.select("word", "score").orderBy("score", F.desc("word"))


def topic_words_grid(
    ranked: DataFrame, n_topics: int = 9, count: int = 7, n_cols: int = 3, topic: str = "topic"
) -> DataFrame:
    """``<topic, grid_row, grid_col, rank, word, score>``: first topics by number, laid out in a grid.

    The topics are picked by a bounded top-n first, so the numbering window sees at most
    ``n_topics`` rows.
    """
    first = ranked.filter(F.col(topic) != -1).select(topic).distinct().orderBy(topic).limit(n_topics)
    place = F.row_number().over(Window.orderBy(topic)) - 1
    cells = first.select(
        topic,
        F.floor(place / n_cols + 1).cast("int").alias("grid_row"),
        (place % n_cols + 1).cast("int").alias("grid_col"),
    )
    return ranked.filter(F.col("rank") <= count).join(cells, topic).select(topic, "grid_row", "grid_col", "rank", "word", "score")


def chart_tables(points: DataFrame, ranked: DataFrame, vector: str = "reduced", path: str | None = None) -> dict[str, DataFrame]:
    """All chart tables of a run by name, written as parquet below ``path`` when given."""
    tables = {
        "points_2d": points_2d(points, vector),
        "topic_distribution": topic_distribution(points),
        "topic_words_grid": topic_words_grid(ranked),
    }
    if path:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/charts/{name}")
    return tables
