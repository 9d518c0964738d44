"""Fewer dimensions: principal components, truncated SVD, spectral layout of a neighbour graph."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.vectors import as_doubles
from themeloom.operators.forest import approximate_knn
from themeloom.operators.neighbors import fuzzy_edges, knn_graph
from themeloom.operators.selection import shuffle_key
from themeloom.operators.stochastic import stochastic_layout
from themeloom.session import cut_lineage


def _signs(basis: np.ndarray) -> np.ndarray:
    """Flip columns so that the entry of largest magnitude is positive."""
    lead = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
    return basis * np.where(lead < 0, -1.0, 1.0)


def _project(df: DataFrame, vector: str, basis: np.ndarray, shift: np.ndarray, out: str) -> DataFrame:
    """``vector @ basis - shift``: one matrix product a batch; the basis is width x components, model-sized."""

    @F.pandas_udf("array<double>")
    def product(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch):
                yield pd.Series(list(np.stack(batch.to_numpy()).astype(np.float64) @ basis - shift))
            else:
                yield pd.Series([], dtype=object)

    return df.withColumn(out, product(as_doubles(F.col(vector))))


def _check(method: str, components: int, width: int) -> None:
    if not 1 <= components <= width:
        raise ValueError(f"{method} needs 1 to {width} components, got {components}")


def pca(
    df: DataFrame, components: int = 5, vector: str = "embedding", out: str = "reduced"
) -> tuple[DataFrame, np.ndarray]:
    """Centred principal components and the explained variance ratio of each."""
    held = df.select(array_to_vector(as_doubles(F.col(vector))).alias("_v"))
    mean = held.select(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    _check("PCA", components, len(mean))
    model = PCA(k=components, inputCol="_v", outputCol="_o").fit(held)
    basis = _signs(model.pc.toArray())
    return _project(df, vector, basis, mean @ basis, out), model.explainedVariance.toArray()


def gram_matrix(df: DataFrame, vector: str = "embedding") -> tuple[np.ndarray, int]:
    """``X^T X`` and the row count, from distributed moments (correlation, deviation, mean)."""
    held = df.select(array_to_vector(as_doubles(F.col(vector))).alias("_v"))
    stats = held.select(Summarizer.metrics("mean", "std", "count").summary(F.col("_v")).alias("s")).select("s.*").first()
    mean, std, n = stats["mean"].toArray(), stats["std"].toArray(), int(stats["count"])
    if n < 2:
        return n * np.outer(mean, mean), n
    matrix: DenseMatrix = Correlation.corr(held, "_v").first()[0]
    cov = np.nan_to_num(matrix.toArray()) * np.outer(std, std)
    cov[np.diag_indices_from(cov)] = std**2
    return cov * (n - 1) + n * np.outer(mean, mean), n


def truncated_svd(
    df: DataFrame, components: int = 5, vector: str = "embedding", out: str = "reduced"
) -> tuple[DataFrame, np.ndarray]:
    """Projection on the leading right singular vectors (no centring) and the share of variance
    in each projected column."""
    gram, n = gram_matrix(df, vector)
    _check("SVD", components, len(gram))
    values, vectors = np.linalg.eigh(gram)
    basis = _signs(vectors[:, np.argsort(values)[::-1][:components]])
    reduced = _project(df, vector, basis, np.zeros(components), out)
    held = df.select(array_to_vector(as_doubles(F.col(vector))).alias("_v"))
    stats = held.select(Summarizer.metrics("mean", "variance").summary(F.col("_v")).alias("s")).select("s.*").first()
    total = stats["variance"].toArray().sum()
    mean = stats["mean"].toArray() @ basis
    spread = (np.einsum("ij,ik,kj->j", basis, gram, basis) - n * mean**2) / max(n - 1, 1)
    return reduced, spread / total if total > 0 else np.zeros(components)


def _inner_products(state: DataFrame, width: int) -> np.ndarray:
    """``X^T X`` of the packed rows ``x`` (``width`` numbers each): one small matrix a batch, summed by entry."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((width, width))
        for pdf in batches:
            for packed in pdf["x"]:
                rows = np.frombuffer(packed).reshape(-1, width)
                held += rows.T @ rows
        yield pd.DataFrame({"m": [held.ravel()]})

    cells = state.select("x").mapInPandas(partial, "m array<double>").select(F.posexplode("m").alias("pos", "x"))
    sums = cells.groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()
    return np.array([r["x"] for r in sums]).reshape(width, width)


#: Strips of points that a graph is cut into, as far as each holds POINTS_LOW; more once a strip would hold over POINTS_HIGH points or a
#: pair of strips over PAIR_EDGES edges, which bounds what a task holds.
GRAPH_STRIPS, POINTS_LOW, POINTS_HIGH, PAIR_EDGES = 16, 2048, 1 << 16, 1 << 20


def _strip_count(points: int, edges: int) -> int:
    few = min(GRAPH_STRIPS, math.ceil(points / POINTS_LOW))
    return max(1, few, math.ceil(points / POINTS_HIGH), math.ceil(math.sqrt(edges / PAIR_EDGES)))


def _graph_blocks(norm: DataFrame) -> DataFrame:
    """``<strip, to_strip, at, starts, froms, s>``: the edges between two strips, packed and sorted by the end that receives.

    ``norm <to_strip, to_place, strip, place, s>``: an edge carries ``s`` times the value of its point at ``place`` of ``strip``.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["to_place", "place"])
        to = pdf["to_place"].to_numpy(np.int32)
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]).astype(np.int32)
        row = {"strip": [pdf["strip"].iloc[0]], "to_strip": [pdf["to_strip"].iloc[0]], "at": [to[starts].tobytes()], "starts": [starts.tobytes()]}
        return pd.DataFrame({**row, "froms": [pdf["place"].to_numpy(np.int32).tobytes()], "s": [pdf["s"].to_numpy(np.float64).tobytes()]})

    return norm.groupBy("strip", "to_strip").applyInPandas(build, "strip int, to_strip int, at binary, starts binary, froms binary, s binary")


PARTS = "strip int, at binary, part binary"


def _krylov(blocks: DataFrame, state: DataFrame, width: int, depth: int) -> DataFrame:
    """``state <strip, x>`` with ``depth`` more blocks of ``width`` numbers a point: (I + S) / 2 applied to the last one, again and again.

    A strip meets its own edges, and what the edges carry is added up for each point that they reach before it moves on, once a step. The
    strip's own rows go along, without places.
    """

    def added(parts: pd.DataFrame, total: int) -> np.ndarray:
        own = parts["at"].isna().to_numpy()
        x = np.frombuffer(parts["part"].to_numpy()[own][0]).reshape(-1, total)
        if own.all():
            return x
        image = np.zeros((len(x), width))
        for at, part in zip(parts["at"].to_numpy()[~own], parts["part"].to_numpy()[~own]):
            image[np.frombuffer(at, np.int32)] += np.frombuffer(part).reshape(-1, width)
        return np.hstack([x, (x[:, -width:] + image) / 2])

    def carry(total: int):
        def work(graph: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            x = added(parts, total)
            last = x[:, -width:]
            out = {"strip": [parts["strip"].iloc[0]], "at": [None], "part": [x.tobytes()]}
            for row in graph.to_dict("records"):
                carried = np.frombuffer(row["s"])[:, None] * last[np.frombuffer(row["froms"], np.int32)]
                out["strip"].append(row["to_strip"])
                out["at"].append(row["at"])
                out["part"].append(np.add.reduceat(carried, np.frombuffer(row["starts"], np.int32)).tobytes())
            return pd.DataFrame(out)

        return work

    def combine(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"strip": [parts["strip"].iloc[0]], "x": [added(parts, width * depth).tobytes()]})

    met = state.select("strip", F.lit(None).cast("binary").alias("at"), F.col("x").alias("part"))
    for number in range(depth):
        met = blocks.groupBy("strip").cogroup(met.groupBy("strip")).applyInPandas(carry(width * max(number, 1)), PARTS)
    return met.groupBy("strip").applyInPandas(combine, "strip int, x binary")


def _turned(state: DataFrame, turn: np.ndarray) -> DataFrame:
    """``x @ turn`` for the packed rows of every strip."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(x=[(np.frombuffer(packed).reshape(-1, len(turn)) @ turn).tobytes() for packed in pdf["x"]])

    return state.select("strip", "x").mapInPandas(work, "strip int, x binary")


def spectral_layout(
    edges: DataFrame, components: int = 5, restarts: int = 6, depth: int = 6, seed: int = 42, tolerance: float = 1e-3
) -> DataFrame:
    """``<id, reduced>``: leading non-trivial eigenvectors of the normalized weighted graph.

    A restarted block Krylov iteration on (I + S) / 2. Points are dealt to strips and packed; a step moves each strip's rows once and, for
    every other strip, one sum for each point that an edge reaches, so it grows with the points and the edges. Rayleigh-Ritz over all steps
    of a restart needs only their inner products, a matrix of
    (components + 1) * (depth + 1) squared, on the driver. It goes on until every eigenvector's
    residual is at most ``tolerance`` (eigenvalues lie between 0 and 1); if ``restarts`` restarts do not reach it, a warning says how
    far it got. A graph without edges gives no rows.
    """
    width = components + 1
    both = edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    degree = cut_lineage(both.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("deg"), F.count(F.lit(1)).alias("n_edges")))
    size = degree.agg(F.count("id").alias("points"), F.sum("n_edges").alias("edges")).first()
    if not size["points"]:
        return degree.select("id", F.array_repeat(F.lit(0.0), components).alias("reduced"))
    strips = _strip_count(size["points"], size["edges"])
    place = F.row_number().over(Window.partitionBy("strip").orderBy("id")) - 1
    homes = degree.filter("id IS NOT NULL").withColumn("strip", F.pmod(F.xxhash64("id"), F.lit(strips)).cast("int"))
    homes = cut_lineage(homes.withColumn("place", place).select("id", "deg", "strip", "place"))
    du = homes.select(F.col("id").alias("u"), F.col("deg").alias("deg_u"), F.col("strip").alias("to_strip"), F.col("place").alias("to_place"))
    dv = homes.select(F.col("id").alias("v"), F.col("deg").alias("deg_v"), "strip", "place")
    scale = F.col("w") / F.sqrt(F.col("deg_u") * F.col("deg_v"))
    norm = both.join(du, "u").join(dv, "v").select("to_strip", "to_place", "strip", "place", scale.alias("s"))
    blocks = cut_lineage(_graph_blocks(norm))

    def start(j: int):
        if j == 0:
            return F.sqrt("deg")
        return F.conv(F.substring(shuffle_key("id", seed + j), 1, 8), 16, 10).cast("double") / 2.0**32 - 0.5

    names = [f"x{j}" for j in range(width)]

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.ascontiguousarray(pdf.sort_values("place")[names].to_numpy(np.float64))
        return pd.DataFrame({"strip": [pdf["strip"].iloc[0]], "x": [rows.tobytes()]})

    placed = homes.select("strip", "place", *[start(j).alias(name) for j, name in enumerate(names)])
    krylov = cut_lineage(placed.groupBy("strip").applyInPandas(gather, "strip int, x binary"))
    for _ in range(restarts):
        krylov = cut_lineage(_krylov(blocks, krylov, width, depth))
        gram = _inner_products(krylov, width * (depth + 1))
        inner = gram[:-width, :-width]
        image = gram[:-width, width:]
        size = np.sqrt(np.maximum(np.diag(inner), 1e-300))
        values, vectors = np.linalg.eigh(inner / np.outer(size, size))
        keep = values > values.max() * 1e-10
        basis = vectors[:, keep] / np.sqrt(values[keep]) / size[:, None]
        small = basis.T @ ((image + image.T) / 2) @ basis
        ritz, turn = np.linalg.eigh(small)
        first = np.argsort(ritz)[::-1][:width]
        top, found = basis @ turn[:, first], ritz[first]
        # |M y - r y|^2 from inner products alone
        parts = [np.einsum("ij,ik,kj->j", top, m, top) for m in (gram[width:, width:], (image + image.T) / 2, inner)]
        residual = float(np.sqrt(np.maximum(parts[0] - 2 * found * parts[1] + found**2 * parts[2], 0.0)).max())
        padded = np.vstack([top, np.zeros((width, top.shape[1]))])
        krylov = cut_lineage(_turned(krylov, padded))
        width = padded.shape[1]
        if residual <= tolerance:
            break
    else:
        warnings.warn(f"spectral layout stopped at a residual of {residual:.2g}, above {tolerance:.2g}", stacklevel=2)
    count = min(components, width - 1)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for strip, packed in zip(pdf["strip"], pdf["x"]):
                rows = np.frombuffer(packed).reshape(-1, width)
                yield pd.DataFrame({"strip": np.int32(strip), "place": np.arange(len(rows), dtype=np.int32), "x": list(rows)})

    rows = cut_lineage(krylov.mapInPandas(unpack, "strip int, place int, x array<double>").join(homes, ["strip", "place"]).select("id", "x"))
    ends = rows.agg(
        *[f(F.col("x")[j + 1]).alias(f"{t}{j}") for j in range(count) for t, f in (("low", F.min), ("high", F.max))]
    ).first()
    scaled = []
    for j in range(count):
        low, high = ends[f"low{j}"], ends[f"high{j}"]
        sign = 1.0 if high >= -low else -1.0
        scaled.append(F.col("x")[j + 1] * (sign * 10.0 / (max(abs(low), abs(high)) or 1.0)))
    return rows.select("id", F.array(*scaled).alias("reduced"))


def graph_layout(
    df: DataFrame,
    components: int = 5,
    n_neighbors: int = 15,
    metric: str = "cosine",
    key: str = "doc_id",
    vector: str = "embedding",
    out: str = "reduced",
    seed: int = 42,
    min_dist: float | None = None,
    neighbors: str = "exact",
) -> DataFrame:
    """Neighbour graph -> fuzzy weights -> spectral layout, joined back by key.

    With ``min_dist`` the spectral layout is where a stochastic one starts, which pulls neighbours together and keeps them about
    so far apart. ``neighbors`` is ``exact`` or ``approximate``. A point without neighbours stays, at the origin.
    """
    if neighbors not in ("exact", "approximate"):
        raise ValueError(f"neighbors must be exact or approximate, got {neighbors!r}")
    search = knn_graph if neighbors == "exact" else approximate_knn
    graph = cut_lineage(search(df, n_neighbors, key, vector, metric))
    edges = cut_lineage(fuzzy_edges(graph))
    laid = spectral_layout(edges, components, seed=seed)
    if min_dist is not None:
        laid = stochastic_layout(edges, laid, min_dist, seed=seed)
    laid = laid.withColumnRenamed("id", key).withColumnRenamed("reduced", out)
    width = laid.agg(F.max(F.size(out))).first()[0] or components
    return df.join(laid, key, "left").withColumn(out, F.coalesce(out, F.array_repeat(F.lit(0.0), width)))


def reduce_vectors(
    df: DataFrame,
    method: str = "graph",
    components: int = 5,
    key: str = "doc_id",
    vector: str = "embedding",
    out: str = "reduced",
    seed: int = 42,
    **options,
) -> DataFrame:
    """Adds ``out`` by the named method: ``graph``, ``pca`` or ``svd``."""
    name = method.lower()
    if name == "graph":
        return graph_layout(df, components, key=key, vector=vector, out=out, seed=seed, **options)
    if name == "pca":
        return pca(df, components, vector, out)[0]
    if name == "svd":
        return truncated_svd(df, components, vector, out)[0]
    raise ValueError(f"no reduction named {method!r}; there are graph, pca and svd")
