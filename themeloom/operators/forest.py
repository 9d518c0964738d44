"""Approximate nearest neighbours by a forest of random projections, refined by neighbours of neighbours.

Every tree cuts the points in two at the median of a projection, and again, until a leaf has at most ``leaf`` points; a level is one
grouped median over all trees and leaves at once. Leaves are compared exactly, and each point keeps its nearest ones from all
trees. Refinement then compares each point with the neighbours of its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.vectors import normalize
from themeloom.operators.neighbors import EDGES, _nearest_in_block, expand_copies
from themeloom.operators.tiles import collapse_copies, map_pairs, pack
from themeloom.session import cut_lineage

TREES, LEAF = 8, 1024


def projected(points: DataFrame, key: str, vector: str, trees: int, levels: int, seed: int) -> DataFrame:
    """``<key, tree, place array<double>>``: each point's place along the random direction of every level of every tree."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                # the same directions in every task, drawn for the width
                ways = np.random.default_rng([seed, vectors.shape[1]]).normal(size=(trees, vectors.shape[1], max(1, levels)))
                for t in range(trees):
                    yield pd.DataFrame({key: pdf[key], "tree": np.int32(t), "place": list(vectors @ ways[t])})

    return points.select(key, vector).mapInPandas(work, f"{key} long, tree int, place array<double>")


def leaves(points: DataFrame, key: str, vector: str, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """``<key, tree, leaf>``. Cuts are near the median, so the leaves of a tree are about equal in size."""
    n = points.count()
    levels = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    held = cut_lineage(projected(points, key, vector, trees, levels, seed).withColumn("leaf", F.lit(1).cast("long")))
    for level in range(levels):
        place = F.col("place")[level]
        cuts = held.groupBy("tree", "leaf").agg(F.percentile_approx(place, 0.5, 1000).alias("cut"))
        # a row a leaf: the planner sends the few leaves of the first levels to every task
        held = held.join(cuts, ["tree", "leaf"]).withColumn("leaf", F.col("leaf") * 2 + F.when(place > F.col("cut"), 1).otherwise(0)).drop("cut")
        held = cut_lineage(held)
    return held.select(key, "tree", "leaf")


def nearest_by_forest(distinct: DataFrame, k: int, key: str, vector: str, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """``<src, dst, dist>``: for each point the nearest ``k`` of those that share a leaf with it in some tree."""
    placed = leaves(distinct, key, vector, trees, leaf, seed)
    sizes = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("_n"))
    # equal projections may leave a leaf larger than asked for; it becomes several tiles that all meet
    placed = placed.join(sizes, ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / (2 * leaf))))
    tiles = cut_lineage(pack(placed.join(distinct.select(key, vector), key), ["tree", "leaf", "chunk"], key, vector).withColumn("tile", F.xxhash64("tree", "leaf", "chunk")))
    heads = tiles.select("tree", "leaf", F.col("tile").alias("a_tile"))
    pairs = heads.join(heads.withColumnRenamed("a_tile", "b_tile"), ["tree", "leaf"]).select("a_tile", "b_tile")
    found = map_pairs(pairs, tiles, tiles, lambda a, b: _nearest_in_block(a, b, k), EDGES)
    return cut_lineage(_best(found, k))


def _best(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return once.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def refine(graph: DataFrame, distinct: DataFrame, k: int, key: str, vector: str, width: int) -> DataFrame:
    """Each point meets the ``width`` nearest neighbours of its ``width`` nearest, both ways round; the ``k`` nearest stay.

    A point that many others name takes part with its own nearest ones and, of those that name it, the ``width`` nearest, so no
    point meets more than about ``4 * width ** 2`` others.
    """
    near = Window.partitionBy("src").orderBy("dist", "dst")
    ahead = graph.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= width).drop("_r")
    named = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    behind = named.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= width).drop("_r")
    both = cut_lineage(ahead.unionByName(behind).select("src", "dst").distinct())
    step = both.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    new = both.join(step, both["dst"] == step["mid"]).select("src", F.col("to").alias("dst")).filter("src <> dst").distinct()
    new = cut_lineage(new.join(graph.select("src", "dst"), ["src", "dst"], "left_anti"))
    left = distinct.select(F.col(key).alias("src"), F.col(vector).alias("a"))
    right = distinct.select(F.col(key).alias("dst"), F.col(vector).alias("b"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = np.stack(pdf["a"].to_numpy()).astype(np.float64), np.stack(pdf["b"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"src": pdf["src"], "dst": pdf["dst"], "dist": np.sqrt(((a - b) ** 2).sum(1))})

    found = new.join(right, "dst").join(left, "src").select("src", "dst", "a", "b").mapInPandas(measure, EDGES)
    return cut_lineage(_best(graph.select("src", "dst", "dist").unionByName(found), k))


def approximate_knn(
    points: DataFrame,
    k: int = 15,
    key: str = "doc_id",
    vector: str = "embedding",
    metric: str = "euclidean",
    trees: int = TREES,
    leaf: int = LEAF,
    rounds: int = 1,
    width: int = 5,
    seed: int = 42,
) -> DataFrame:
    """``<src, dst, rank, dist>`` like ``knn_graph``, with most but not all of the nearest points.

    The work grows with the rows times the logarithm of their number. Copies of a vector are searched once and expanded at the
    end. More ``trees``, larger leaves and more ``rounds`` find more; ``neighbor_recall`` measures how many.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"no metric named {metric!r}; there are cosine and euclidean")
    if k < 1 or trees < 1 or leaf < 2:
        raise ValueError("k and trees must be at least 1, a leaf must hold at least 2 points")
    if metric == "cosine":
        points = points.withColumn(vector, normalize(F.col(vector).cast("array<double>")))
    members, distinct = collapse_copies(points, key, vector)
    members, distinct = cut_lineage(members), cut_lineage(distinct)
    graph = nearest_by_forest(distinct, k, "rep", vector, trees, max(leaf, k + 1), seed)
    for _ in range(rounds):
        graph = refine(graph, distinct, k, "rep", vector, width)
    return expand_copies(graph, members, distinct, k, key, metric)


def neighbor_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``<n_points, n_edges, recall>``: the share of the exact graph's edges that are found."""
    hits = exact.select("src", "dst").join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hits.agg(F.count_distinct("src").alias("n_points"), F.count(F.lit(1)).alias("n_edges"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
