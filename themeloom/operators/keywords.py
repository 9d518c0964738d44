"""Re-ranking of topic keywords by meaning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.vectors import as_doubles, cosine, mean_vectors
from themeloom.operators.embedding import embed_terms
from themeloom.operators.selection import assigned
from themeloom.operators.weighting import top_words
from themeloom.session import cut_lineage


def candidate_words(scores: DataFrame, count: int = 50, topic: str = "topic") -> DataFrame:
    """Best ``count`` terms per topic by weight."""
    return top_words(scores, count, topic)


def topic_centroids(points: DataFrame, topic: str = "topic", vector: str = "embedding") -> DataFrame:
    """``<topic, centroid, n>`` over original vectors."""
    return mean_vectors(assigned(points, topic), topic, vector)


def word_relevance(
    candidates: DataFrame,
    centroids: DataFrame,
    encoder: Callable[[], Callable] | str = "hash",
    topic: str = "topic",
    **options,
) -> DataFrame:
    """``<topic, rank, word, vector, relevance>``: cosine of each candidate with its centroid."""
    candidates = cut_lineage(candidates)
    vectors = embed_terms(candidates, encoder, "word", "vector", **options).withColumnRenamed("term", "word")
    return (
        candidates.join(vectors, "word").join(centroids.select(topic, "centroid"), topic)
        .select(topic, "rank", "word", as_doubles(F.col("vector")).alias("vector"), cosine(F.col("vector"), F.col("centroid")).alias("relevance"))
    )


def refine_by_similarity(relevance: DataFrame, count: int = 10, topic: str = "topic") -> DataFrame:
    """``<topic, rank, word, score>``: candidates by similarity to the centroid."""
    order = Window.partitionBy(topic).orderBy(F.desc("score"), F.asc("word"))
    return (
        relevance.select(topic, "word", F.col("relevance").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= count)
        .select(topic, "rank", "word", "score")
    )


def refine_by_diversity(
    relevance: DataFrame, count: int = 10, diversity: float = 0.5, topic: str = "topic"
) -> DataFrame:
    """``<topic, rank, word, score>``: maximal marginal relevance; the score is the relevance.

    A group holds one topic's candidates, as many as the candidate ranking allows.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        relevance_, vecs = pdf["relevance"].to_numpy(), np.stack(pdf["vector"].to_numpy())
        size = np.linalg.norm(vecs, axis=1)
        unit = np.divide(vecs, size[:, None], out=np.zeros_like(vecs), where=size[:, None] > 0)
        alike = unit @ unit.T
        picked = [int(relevance_.argmax())]
        closest = alike[picked[0]].copy()
        while len(picked) < min(count, len(pdf)):
            gain = (1 - diversity) * relevance_ - diversity * closest
            gain[picked] = -np.inf
            picked.append(int(gain.argmax()))
            closest = np.maximum(closest, alike[picked[-1]])
        return pd.DataFrame(
            {
                topic: pdf[topic].iloc[0],
                "rank": np.arange(1, len(picked) + 1, dtype=np.int32),
                "word": pdf["word"].iloc[picked].to_numpy(),
                "score": relevance_[picked],
            }
        )

    kind = relevance.schema[topic].dataType.simpleString()
    return relevance.groupBy(topic).applyInPandas(choose, f"{topic} {kind}, rank int, word string, score double")
