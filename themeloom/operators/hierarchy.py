"""Merging topics into a tree, with the words of every level.

Topics are compared by the cosine of their term weights. A merge joins the two nearest clusters; a cluster is named by its
smallest topic. Terms are counted once, for the topics; the counts of a cluster are the sums of its topics' counts, and
each level is weighed anew, as if its clusters were the topics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.weighting import bm25, ctfidf, top_words
from themeloom.session import cut_lineage

#: Topics in a tree, at most: their distances, one number a pair, are held in one place.
MOST_TOPICS = 2000
LINKAGES = ("average", "complete", "single")


def topic_distances(weights: DataFrame, topic: str = "topic", value: str = "score") -> tuple[list[int], np.ndarray]:
    """The topics in order and ``1 - cosine`` of their weights <topic, term, value>; a topic without weight is 1 from all others.

    The terms stay where they are: a term's weights, one a topic at most, meet in one task, and a task sends one product for
    each pair of topics it has met.
    """
    names = sorted(r[0] for r in weights.select(topic).distinct().limit(MOST_TOPICS + 1).collect())
    if len(names) > MOST_TOPICS:
        raise ValueError(f"a tree takes at most {MOST_TOPICS} topics")
    place = {t: i for i, t in enumerate(names)}
    n = len(names)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for pdf in batches:
            rows = np.zeros((len(pdf), n))
            for i, held in enumerate(pdf["held"]):
                for r in held:
                    rows[i, place[r["topic"]]] = r["x"]
            total += rows.T @ rows
        a, b = np.nonzero(np.triu(total))
        yield pd.DataFrame({"a": a, "b": b, "x": total[a, b]})

    by_term = weights.filter(F.col(value) != 0).groupBy("term").agg(
        F.collect_list(F.struct(F.col(topic).alias("topic"), F.col(value).cast("double").alias("x"))).alias("held")
    )
    cells = by_term.select("held").mapInPandas(products, "a int, b int, x double").groupBy("a", "b").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((n, n))
    for a, b, x in cells:
        gram[a, b] = gram[b, a] = x
    size = np.sqrt(np.diag(gram))
    scale = np.outer(size, size)
    cosine = np.divide(gram, scale, out=np.zeros_like(gram), where=scale > 0)
    return names, 1.0 - cosine


def merge_order(distances: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float]]:
    """``(kept, merged, height)`` of each merge, by places in the matrix; ties by the smallest places."""
    if linkage not in LINKAGES:
        raise ValueError(f"no linkage named {linkage!r}; there are {', '.join(LINKAGES)}")
    apart, size = distances.astype(float).copy(), np.ones(len(distances))
    apart[np.tril_indices(len(apart))] = np.inf
    out = []
    for _ in range(len(distances) - 1):
        a, b = divmod(int(apart.argmin()), len(apart))
        out.append((a, b, float(apart[a, b])))
        full = np.minimum(apart, apart.T)
        left, right = full[a], full[b]
        if linkage == "single":
            row = np.minimum(left, right)
        elif linkage == "complete":
            row = np.where(np.isinf(left) | np.isinf(right), np.inf, np.maximum(left, right))
        else:
            row = (left * size[a] + right * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        row[a] = row[b] = np.inf
        apart[a, a + 1 :], apart[:a, a] = row[a + 1 :], row[:a]
        apart[b, :] = apart[:, b] = np.inf
    return out


def merge_topics(counts: DataFrame, topic: str = "topic", linkage: str = "average") -> DataFrame:
    """``<level, kept, merged, height, n_clusters, n_topics>``: at each level the cluster ``merged`` joins ``kept``.

    ``counts <topic, term, n>`` as counted for the weights. ``height`` is the distance of the merge, ``n_clusters`` how many
    clusters are left, ``n_topics`` how many topics the new cluster has. One topic or none gives no rows.
    """
    names, distances = topic_distances(ctfidf(counts, topic), topic)
    size = {t: 1 for t in names}
    rows = []
    for level, (a, b, height) in enumerate(merge_order(distances, linkage), 1):
        kept, merged = names[a], names[b]
        size[kept] += size[merged]
        rows.append((level, int(kept), int(merged), height, len(names) - level, size[kept]))
    return counts.sparkSession.createDataFrame(rows, "level int, kept int, merged int, height double, n_clusters int, n_topics int")


def halving(n: int) -> list[int]:
    """``n`` and its halves down to one."""
    out = [n]
    while out[-1] > 1:
        out.append(out[-1] // 2)
    return out


def cut_tree(tree: DataFrame, topics: DataFrame, cuts: list[int] | None = None, topic: str = "topic") -> DataFrame:
    """``<n_clusters, topic, cluster>``: the cluster of every topic where so many clusters are left.

    ``cuts`` defaults to the number of topics and its halves, so that the words of all levels together stay within a factor of
    the logarithm of the number of topics.
    """
    names = sorted(r[0] for r in topics.select(topic).distinct().collect())
    chosen = set(halving(len(names)) if cuts is None else cuts) if names else set()
    home = {t: t for t in names}
    rows = [(len(names), int(t), int(c)) for t, c in home.items() if len(names) in chosen]
    for _, kept, merged, left in tree.select("level", "kept", "merged", "n_clusters").orderBy("level").collect():
        home = {t: kept if c == merged else c for t, c in home.items()}
        if left in chosen:
            rows += [(left, int(t), int(c)) for t, c in home.items()]
    return topics.sparkSession.createDataFrame(rows, f"n_clusters int, {topic} int, cluster int")


def level_counts(counts: DataFrame, levels: DataFrame, topic: str = "topic") -> DataFrame:
    """``<n_clusters, cluster, term, n>``: the topics' counts rolled up to the clusters of each level."""
    return cut_lineage(counts.join(levels, topic).groupBy("n_clusters", "cluster", "term").agg(F.sum("n").alias("n")))


def level_words(counts: DataFrame, levels: DataFrame, count: int = 10, topic: str = "topic", use_bm25: bool = False) -> DataFrame:
    """``<n_clusters, cluster, rank, word, score>``: the best words of every cluster, weighed within its level."""
    rolled = level_counts(counts, levels, topic)
    out = None
    for (left,) in sorted(rolled.select("n_clusters").distinct().collect(), reverse=True):
        mine = rolled.filter(F.col("n_clusters") == left).select("cluster", "term", "n")
        scores = ctfidf(mine, "cluster")
        if use_bm25:
            scores = bm25(scores, topic="cluster", topics=mine.select("cluster").distinct()).withColumnRenamed("bm25", "score")
        words = top_words(scores, count, "cluster").select(F.lit(left).alias("n_clusters"), "cluster", "rank", "word", "score")
        out = words if out is None else out.unionByName(words)
    if out is None:
        return counts.sparkSession.createDataFrame([], "n_clusters int, cluster int, rank int, word string, score double")
    return out


def relabel(labels: DataFrame, levels: DataFrame, n_clusters: int, topic: str = "topic") -> DataFrame:
    """``labels`` with each topic replaced by its cluster at a level; noise and topics outside the tree stay."""
    mine = levels.filter(F.col("n_clusters") == n_clusters).select(topic, "cluster")
    return labels.join(mine, topic, "left").withColumn(topic, F.coalesce("cluster", topic)).drop("cluster").select(*labels.columns)
