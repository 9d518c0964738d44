"""Centre-based clustering, and the common entry to all clustering methods."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.vectors import as_doubles
from themeloom.operators.contraction import ward_labels, ward_merges
from themeloom.operators.density import dbscan, hdbscan, single_linkage
from themeloom.operators.selection import shuffle_key
from themeloom.operators.tiles import block_squares, collapse_copies
from themeloom.session import cut_lineage

# Bound of the centres merged on the driver.
MICRO_CLUSTERS = 2000


def kmeans_fit(
    points: DataFrame,
    n_clusters: int,
    vector: str = "reduced",
    seed: int = 42,
    restarts: int = 10,
    max_iter: int = 300,
    parallelism: int = 4,
) -> tuple[KMeansModel, float]:
    """The best of several seeded runs, some at a time, and its inertia (sum of squared distances)."""
    held = points.select(array_to_vector(as_doubles(F.col(vector))).alias("features"))

    # a run keeps the vectors themselves; over a stored table it would decode them anew in every step
    def one(run: int) -> tuple[float, int, KMeansModel]:
        model = KMeans(k=n_clusters, seed=seed + run, maxIter=max_iter, featuresCol="features").fit(held)
        return model.summary.trainingCost, run, model

    with ThreadPoolExecutor(min(parallelism, restarts)) as pool:
        runs = list(pool.map(inheritable_thread_target(held.sparkSession)(one), range(restarts)))
    cost, _, best = min(runs, key=lambda r: r[:2])
    return best, cost


def kmeans(
    points: DataFrame,
    n_clusters: int | None = None,
    key: str = "doc_id",
    vector: str = "reduced",
    out: str = "topic",
    seed: int = 42,
    restarts: int = 10,
    max_iter: int = 300,
) -> tuple[DataFrame, float]:
    """``<key, out>`` and the inertia; every point gets a topic."""
    if n_clusters is None:
        raise ValueError("k-means needs the number of clusters (n_clusters)")
    model, cost = kmeans_fit(points, n_clusters, vector, seed, restarts, max_iter)
    features = points.select(key, array_to_vector(as_doubles(F.col(vector))).alias("features"))
    return model.setPredictionCol(out).transform(features).select(key, F.col(out).cast("int").alias(out)), cost


def _ward(centers: np.ndarray, sizes: np.ndarray, n_clusters: int) -> np.ndarray:
    """The place of the cluster that each weighted centre is in when n_clusters are left."""
    home = np.arange(len(centers))
    for kept, merged, _ in ward_merges(np.arange(len(centers)), centers, sizes)[: len(centers) - n_clusters]:
        home[home == merged] = kept
    return home


def micro_clusters(distinct: DataFrame, centers: np.ndarray, vector: str, max_iter: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Centres moved to the weighted means of their points until they rest, with their weights, and
    ``<rep, micro>``: the number of the centre of each point of ``distinct <rep, vector, copies>``.

    Each task sends one sum a centre. Centres that lose all their points are dropped.
    """

    def nearest(pdf: pd.DataFrame, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vecs = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        return vecs, np.concatenate([block_squares(vecs[i : i + 1024], held)[0].argmin(axis=1) for i in range(0, len(vecs), 1024)])

    def summed(held: np.ndarray):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, weight = np.zeros(held.shape), np.zeros(len(held))
            for pdf in batches:
                if len(pdf):
                    vecs, at = nearest(pdf, held)
                    copies = pdf["copies"].to_numpy(np.float64)
                    np.add.at(sums, at, vecs * copies[:, None])
                    weight += np.bincount(at, copies, len(held))
            used = np.flatnonzero(weight)
            if len(used):
                yield pd.DataFrame({"micro": used, "weight": weight[used], "total": list(sums[used])})

        return work

    rows = distinct.select("rep", vector, "copies")
    for _ in range(max(1, max_iter)):
        parts = rows.mapInPandas(summed(centers), "micro long, weight double, total array<double>")
        cells = parts.select("micro", "weight", F.posexplode("total").alias("pos", "x")).groupBy("micro", "pos").agg(
            F.sum("weight").alias("weight"), F.sum("x").alias("x")
        )
        moved = cells.groupBy("micro").agg(
            F.first("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("total")
        ).orderBy("micro").collect()
        before = centers[[r["micro"] for r in moved]]
        sizes = np.array([r["weight"] for r in moved])
        centers = np.array([[p["x"] for p in r["total"]] for r in moved]) / sizes[:, None]
        scale = max(1.0, float(np.abs(centers).max()))
        if len(before) == len(sizes) and np.abs(centers - before).max() <= 1e-9 * scale:
            break
    resting = centers

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"rep": pdf["rep"], "micro": nearest(pdf, resting)[1]})

    return centers, sizes, cut_lineage(rows.mapInPandas(place, "rep long, micro long"))


def ward(
    points: DataFrame,
    n_clusters: int | None = None,
    key: str = "doc_id",
    vector: str = "reduced",
    out: str = "topic",
    seed: int = 42,
    micro: int | None = None,
    max_iter: int = 20,
) -> DataFrame:
    """``<key, out>``: the clusters of Ward's tree over all distinct vectors, numbered by their smallest key.

    With ``micro`` the tree is built over at most so many weighted centres instead, which costs one pass a round rather than a search
    for nearest pairs: they start as the distinct vectors of lowest hash and move to the means of their points on the cluster.
    """
    if n_clusters is None:
        raise ValueError("merging clusters needs the number to stop at (n_clusters)")
    if micro is None:
        return ward_labels(points, n_clusters, key, vector, out)
    if micro < n_clusters:
        raise ValueError(f"micro ({micro}) must be at least n_clusters ({n_clusters})")
    if micro > MICRO_CLUSTERS:
        raise ValueError(f"micro ({micro}) may be at most {MICRO_CLUSTERS}: the centres meet in one place")
    members, distinct = collapse_copies(points, key, vector)
    members, distinct = cut_lineage(members), cut_lineage(distinct)
    total = distinct.count()
    if n_clusters < 1 or n_clusters > total:
        raise ValueError(f"n_clusters must lie between 1 and the number of distinct vectors, got {n_clusters}")
    chosen = distinct.orderBy(shuffle_key("rep", seed), "rep").limit(micro).select("rep", vector).collect()
    chosen = sorted(chosen, key=lambda r: r["rep"])
    centers, sizes, placed = micro_clusters(distinct, np.array([r[vector] for r in chosen], dtype=float), vector, max_iter)
    if len(centers) < n_clusters:
        raise ValueError(f"only {len(centers)} centres kept points; raise micro ({micro}) to get {n_clusters} clusters")
    home = _ward(centers, sizes, n_clusters)
    small = list(enumerate(home.tolist()))
    number = {h: i for i, h in enumerate(sorted({h for _, h in small}))}
    # at most micro rows
    mapping = points.sparkSession.createDataFrame([(u, number[h]) for u, h in small], f"micro long, {out} int")
    labels = placed.join(F.broadcast(mapping), "micro").select("rep", out)
    return members.join(labels, "rep").select(key, out)


def cluster_vectors(
    points: DataFrame,
    method: str = "hdbscan",
    n_clusters: int | None = None,
    key: str = "doc_id",
    vector: str = "reduced",
    out: str = "topic",
    seed: int = 42,
    **options,
) -> DataFrame:
    """``<key, out>`` by the named method: hdbscan, kmeans, dbscan or agglomerative."""
    name = method.lower()
    if name == "hdbscan":
        return hdbscan(points, key=key, vector=vector, out=out, **options)
    if name == "kmeans":
        return kmeans(points, n_clusters, key, vector, out, seed, **options)[0]
    if name == "dbscan":
        return dbscan(points, key=key, vector=vector, out=out, **options)
    if name == "agglomerative":
        if n_clusters is None:
            raise ValueError("merging clusters needs the number to stop at (n_clusters)")
        linkage = options.pop("linkage", "ward")
        if linkage == "ward":
            return ward(points, n_clusters, key, vector, out, seed, **options)
        if linkage == "single":
            return single_linkage(points, n_clusters, key, vector, out)
        raise ValueError(f"no linkage named {linkage!r}; there are ward and single")
    raise ValueError(f"no clustering named {method!r}; there are agglomerative, dbscan, hdbscan and kmeans")


def cluster_summary(labels: DataFrame, topic: str = "topic") -> DataFrame:
    """One row: number of topics, outliers and the outlier percentage."""
    sizes = labels.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    outliers = F.coalesce(F.sum(F.when(F.col(topic) == -1, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.count(F.when(F.col(topic) != -1, 1)).alias("n_topics"),
        outliers.alias("n_outliers"),
        (outliers / F.sum("n") * 100).alias("outlier_pct"),
    )
