"""Quality measures of a labelled set of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.vectors import as_doubles, distance, mean_vectors, norm, normalize, sum_vectors
from themeloom.operators.reports import topic_sizes
from themeloom.operators.selection import assigned, shuffle_key
from themeloom.operators.tiles import TILE_ROWS, Block, block_distances, map_pairs, meet_all, meet_strips, pack
from themeloom.session import cut_lineage


def coverage(labels: DataFrame, topic: str = "topic") -> DataFrame:
    """One row: topics, documents, assigned, outliers, coverage percentage."""
    held = F.sum(F.when(F.col(topic) != -1, 1).otherwise(0))
    out = F.sum(F.when(F.col(topic) == -1, 1).otherwise(0))
    return labels.groupBy(topic).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.when(F.col(topic) != -1, 1)).alias("n_topics"),
        F.sum("n").alias("n_documents"),
        F.coalesce(F.sum(F.when(F.col(topic) != -1, F.col("n"))), F.lit(0)).alias("n_assigned"),
        F.coalesce(F.sum(F.when(F.col(topic) == -1, F.col("n"))), F.lit(0)).alias("n_outliers"),
    ).withColumn("coverage_pct", F.col("n_assigned") / F.col("n_documents") * 100)


def _tile_points(points: DataFrame, groups: list[str], key: str, vector: str, extras: tuple[str, ...], rows: int):
    """Tiles whose points share the ``groups`` values, cut by hash into bounded chunks."""
    sizes = points.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")) if groups else None
    if groups:
        chunks = F.ceil(F.col("_n") / rows)
        placed = points.join(sizes, groups).withColumn("chunk", F.pmod(F.xxhash64(key), chunks))
    else:
        chunks = max(1, math.ceil(points.count() / rows))
        placed = points.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)))
    return cut_lineage(pack(placed, [*groups, "chunk"], key, vector, extras))


def silhouette_samples(
    points: DataFrame, key: str = "doc_id", vector: str = "reduced", topic: str = "topic", tile_rows: int | None = None
) -> DataFrame:
    """``<key, topic, copies, a, b, s>`` per distinct vector of a topic, exactly.

    The measure is defined over all pairs, so its work is quadratic; what moves is one sum per
    (point, topic, strip) and a tile per strip. Copies inside a topic are one weighted point. See ``silhouette_squared``
    for the linear variant.
    """
    rows = tile_rows or TILE_ROWS
    held = assigned(points, topic).select(key, F.col(topic).cast("int").alias(topic), as_doubles(F.col(vector)).alias("_v"))
    packed = held.groupBy(topic, "_v").agg(F.min(key).alias(key), F.count(F.lit(1)).cast("double").alias("copies"))
    packed = cut_lineage(packed)
    tiles = _tile_points(packed, [topic], key, "_v", ("copies",), rows)

    def sums(left: list[Block], right: list[Block]) -> pd.DataFrame:
        out = []
        for a in left:
            found: dict[int, np.ndarray] = {}
            for b in right:
                part = block_distances(a.vecs, b.vecs) @ b.extra("copies")
                found[b.value(topic)] = found[b.value(topic)] + part if b.value(topic) in found else part
            out.extend(pd.DataFrame({key: a.ids, "other": np.full(len(a.ids), t, np.int32), "part": x}) for t, x in found.items())
        return pd.concat(out, ignore_index=True)

    parts = meet_strips(tiles, tiles, sums, f"{key} long, other int, part double")
    sizes = topic_sizes(held, topic).select(F.col(topic).alias("other"), "n")
    far = parts.groupBy(key, "other").agg(F.sum("part").alias("part")).join(sizes, "other")
    own = packed.select(key, topic, "copies")
    mean_own = F.max(F.when(F.col("other") == F.col(topic), F.col("part") / F.nullif(F.col("n") - 1, F.lit(0))))
    mean_other = F.min(F.when(F.col("other") != F.col(topic), F.col("part") / F.col("n")))
    top = F.greatest("a", "b")
    return (
        far.join(own, key)
        .groupBy(key, topic, "copies")
        .agg(mean_own.alias("a"), mean_other.alias("b"))
        .withColumn("s", F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top))
    )


def silhouette(
    points: DataFrame, key: str = "doc_id", vector: str = "reduced", topic: str = "topic", tile_rows: int | None = None
) -> DataFrame:
    """One row: mean silhouette over assigned points; null with fewer than two topics."""
    per_point = silhouette_samples(points, key, vector, topic, tile_rows)
    weighted = F.sum(F.col("s") * F.col("copies")) / F.sum("copies")
    return per_point.agg(F.when(F.count_distinct(topic) > 1, weighted).alias("silhouette"))


#: Points at which the estimated silhouette is worked out.
SILHOUETTE_SAMPLE = 2000


def silhouette_estimate(
    points: DataFrame, key: str = "doc_id", vector: str = "reduced", topic: str = "topic", sample: int = SILHOUETTE_SAMPLE, seed: int = 42
) -> DataFrame:
    """One row: ``silhouette``, its ``silhouette_error`` and ``silhouette_points``; nulls with fewer than two topics.

    The measure of a point is exact, from its distances to all points; the mean is taken over ``sample`` points, those of lowest
    hash, so copies weigh as often as they occur. The work is linear: every point meets the sample once, and a task sends one sum for each
    topic it has met. The error is three standard errors of the mean, with the correction for a sample of a finite
    table; a sample that holds every point gives the exact silhouette and an error of zero.
    """
    rows = cut_lineage(
        assigned(points, topic).select(F.col(key).cast("string").alias("k"), F.col(topic).cast("int").alias("t"), as_doubles(F.col(vector)).alias("v"))
    )
    chosen = rows.orderBy(shuffle_key("k", seed), "k", "t", "v").limit(sample).select("t", "v").collect()
    total = rows.count()
    spark = rows.sparkSession
    if not chosen:
        return spark.createDataFrame([(None, None, 0)], "silhouette double, silhouette_error double, silhouette_points long")
    home = np.array([r.t for r in chosen])
    held = np.array([r.v for r in chosen], dtype=np.float64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for pdf in batches:
            for t, group in pdf.groupby("t"):
                entry = found.setdefault(int(t), [0, np.zeros(len(held))])
                vectors = np.stack(group["v"].to_numpy()).astype(np.float64)
                for low in range(0, len(vectors), 1024):
                    entry[1] += block_distances(held, vectors[low : low + 1024]).sum(1)
                entry[0] += len(group)
        if found:
            yield pd.DataFrame({"t": list(found), "n": [n for n, _ in found.values()], "sums": [x.tobytes() for _, x in found.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0)
        n, t = int(pdf["n"].sum()), int(pdf["t"].iloc[0])
        # the point itself is no neighbour of its own
        mean = np.where(home == t, whole / (n - 1) if n > 1 else np.nan, whole / n)
        return pd.DataFrame({"i": np.arange(len(home)), "own": home == t, "mean": mean})

    parts = rows.mapInPandas(sums, "t int, n long, sums binary")
    means = parts.groupBy("t").applyInPandas(add, "i int, own boolean, mean double")
    own = F.max(F.when(F.col("own") & ~F.isnan("mean"), F.col("mean")))
    other = F.min(F.when(~F.col("own"), F.col("mean")))
    top = F.greatest("a", "b")
    each = means.groupBy("i").agg(own.alias("a"), other.alias("b")).select(
        "b", F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("s")
    )
    m = len(chosen)
    left = math.sqrt(max(0.0, (total - m) / max(1, total - 1)))
    error = 3.0 * left * F.coalesce(F.stddev_samp("s"), F.lit(0.0)) / math.sqrt(m)
    several = F.count("b") > 0
    return each.agg(
        F.when(several, F.avg("s")).alias("silhouette"),
        F.when(several, error).alias("silhouette_error"),
        F.when(several, F.lit(m)).otherwise(0).cast("long").alias("silhouette_points"),
    )


def silhouette_squared(
    points: DataFrame, key: str = "doc_id", vector: str = "reduced", topic: str = "topic", tile_rows: int | None = None
) -> DataFrame:
    """One row: silhouette under squared Euclidean distance.

    A different number from ``silhouette``. With a sum vector and a sum of squares per topic,
    the mean squared distance to a topic needs no pairs: points meet topics, tile by tile.
    """
    rows = tile_rows or TILE_ROWS
    held = cut_lineage(
        assigned(points, topic).select(
            F.col(key).cast("long").alias(key), F.col(topic).cast("long").alias(topic), as_doubles(F.col(vector)).alias("_v")
        )
    )
    square = F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x)
    squares = held.groupBy(topic).agg(F.sum(square).alias("q"))
    sums = sum_vectors(held, topic, "_v").join(squares, topic).withColumn("size", F.col("n").cast("double"))
    left = _tile_points(held, [], key, "_v", (topic,), rows)
    right = _tile_points(cut_lineage(sums), [], topic, "total", ("size", "q"), rows)

    def means(a: Block, b: Block) -> pd.DataFrame:
        n, q = b.extra("size"), b.extra("q")
        part = (a.vecs**2).sum(1)[:, None] * n[None, :] + q[None, :] - 2.0 * (a.vecs @ b.vecs.T)
        own = a.extra(topic, np.int64)[:, None] == b.ids[None, :]
        held_own = own.any(axis=1)
        inside = np.where(own, part / np.maximum(n - 1, 1)[None, :], 0.0).sum(axis=1)
        single = (own & (n == 1)[None, :]).any(axis=1)
        inside = np.where(held_own & ~single, inside, np.nan)
        far = np.where(own, np.inf, part / n[None, :]).min(axis=1)
        return pd.DataFrame({key: a.ids, "a": inside, "b": far})

    pairs = meet_all(left, right, max(1, min(4096, right.count())))
    parts = map_pairs(pairs, left, right, means, f"{key} long, a double, b double")
    per_point = parts.groupBy(key).agg(F.max(F.nanvl("a", F.lit(None))).alias("a"), F.min("b").alias("b"))
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return per_point.agg(F.avg(F.when(F.col("b") < float("inf"), value)).alias("silhouette_sq"))


def davies_bouldin(
    points: DataFrame, vector: str = "reduced", topic: str = "topic", tile_rows: int | None = None
) -> DataFrame:
    """One row: mean over topics of the worst (S_i + S_j) / M_ij; null with fewer than two topics."""
    held = assigned(points, topic).select(F.col(topic).cast("long").alias(topic), as_doubles(F.col(vector)).alias("_v"))
    centers = mean_vectors(held, topic, "_v")
    spread = held.join(centers, topic).groupBy(topic).agg(F.avg(distance(F.col("_v"), F.col("centroid"))).alias("spread"))
    both = cut_lineage(centers.join(spread, topic).select(topic, "centroid", "spread"))
    tiles = _tile_points(both, [], topic, "centroid", ("spread",), tile_rows or TILE_ROWS)

    def worst(a: Block, b: Block) -> pd.DataFrame:
        apart = block_distances(a.vecs, b.vecs)
        ratio = np.divide(
            a.extra("spread")[:, None] + b.extra("spread")[None, :], apart, out=np.zeros_like(apart), where=apart > 0
        )
        ratio[a.ids[:, None] == b.ids[None, :]] = 0.0
        return pd.DataFrame({topic: a.ids, "worst": ratio.max(axis=1)})

    pairs = meet_all(tiles, tiles, max(1, min(4096, tiles.count())))
    per_topic = map_pairs(pairs, tiles, tiles, worst, f"{topic} long, worst double").groupBy(topic).agg(F.max("worst").alias("worst"))
    return per_topic.agg(F.when(F.count(F.lit(1)) > 1, F.avg("worst")).alias("davies_bouldin"))


def coherence(points: DataFrame, vector: str = "embedding", topic: str = "topic") -> DataFrame:
    """One row: mean over topics of the mean pairwise cosine inside the topic.

    On unit vectors the pairwise sum is (|sum|^2 - sum |u|^2) / 2, so no pair is formed.
    """
    unit = assigned(points, topic).select(topic, normalize(as_doubles(F.col(vector))).alias("u"))
    ones = unit.groupBy(topic).agg(F.count(F.when(norm(F.col("u")) > 0, 1)).alias("nonzero"))
    sums = sum_vectors(unit, topic, "u").join(ones, topic).filter(F.col("n") > 1)
    square = F.aggregate("total", F.lit(0.0), lambda acc, x: acc + x * x)
    mean = (square - F.col("nonzero")) / (F.col("n") * (F.col("n") - 1))
    return sums.agg(F.coalesce(F.avg(mean), F.lit(0.0)).alias("coherence"))


def diversity(points: DataFrame, vector: str = "embedding", topic: str = "topic") -> DataFrame:
    """One row: 1 - mean pairwise cosine of topic centroids; 0 with fewer than two topics."""
    unit = mean_vectors(assigned(points, topic), topic, vector).select(
        F.lit(0).alias("g"), normalize(F.col("centroid")).alias("u")
    )
    nonzero = unit.groupBy("g").agg(F.count(F.when(norm(F.col("u")) > 0, 1)).alias("nonzero"))
    sums = sum_vectors(unit, "g", "u").join(nonzero, "g")
    square = F.aggregate("total", F.lit(0.0), lambda acc, x: acc + x * x)
    mean = (square - F.col("nonzero")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    return sums.agg(F.coalesce(F.max(F.lit(1.0) - mean), F.lit(0.0)).alias("diversity"))


def balance(labels: DataFrame, topic: str = "topic") -> DataFrame:
    """One row: exp(-population sd / mean) of topic sizes; 1 with fewer than two topics."""
    return topic_sizes(labels.filter(F.col(topic) != -1), topic).agg(
        F.when(F.count(F.lit(1)) > 1, F.exp(-F.stddev_pop("n") / F.avg("n"))).otherwise(1.0).alias("balance")
    )


def evaluate(
    points: DataFrame,
    key: str = "doc_id",
    original: str = "embedding",
    reduced: str = "reduced",
    topic: str = "topic",
    exact: bool | None = None,
    sample: int = SILHOUETTE_SAMPLE,
) -> DataFrame:
    """One row with every measure. The silhouette is the estimate from ``sample`` points with its error, in linear work;
    ``exact=True`` works it out over all pairs, ``exact=False`` gives ``silhouette_sq``, another number under another name."""
    if exact is None:
        shape = silhouette_estimate(points, key, reduced, topic, sample).drop("silhouette_points")
    else:
        shape = silhouette(points, key, reduced, topic) if exact else silhouette_squared(points, key, reduced, topic)
    shape = cut_lineage(shape)
    return coverage(points, topic).withColumns(
        {
            **{name: shape.select(name).scalar() for name in shape.columns},
            "davies_bouldin": davies_bouldin(points, reduced, topic).scalar(),
            "coherence": coherence(points, original, topic).scalar(),
            "diversity": diversity(points, original, topic).scalar(),
            "balance": balance(points, topic).scalar(),
        }
    )


def as_report(metrics: DataFrame) -> DataFrame:
    """``<metric, value>``; measures that do not apply are absent."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns]
    return metrics.select(F.explode(F.array(*pairs)).alias("m")).select("m.metric", "m.value").filter(
        F.col("value").isNotNull()
    )
