"""Factors of wide sparse matrices: truncated SVD and non-negative factors of tables <row, column, value>.

The matrix stays a long table, and factors are tables of one short array for each row or column. The driver holds matrices of
components times components only; nothing of the matrix's width is ever collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.session import cut_lineage

#: A row or column with more than one in so many cells is heavy: its factors go to every task.
HEAVY = 500
#: Partial triangles of a factorization meet in so many groups first.
GROUPS = 32


class SparseTable:
    """A matrix as cells ``<r, c, x>``, each place once; rows and columns without cells do not exist."""

    def __init__(self, cells: DataFrame, row: str, column: str, value: str):
        named = cells.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("x"))
        named = cut_lineage(named.filter(F.col("r").isNotNull() & F.col("c").isNotNull() & (F.col("x") != 0)))
        self.square, total = named.agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)), F.count(F.lit(1))).first()
        self.cells, self.heavy, self.keys = named, {}, {}
        for side in ("r", "c"):
            counts = named.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
            self.keys[side] = cut_lineage(counts)
            # fewer than HEAVY by their definition
            self.heavy[side] = [k for (k,) in self.keys[side].filter(F.col("n") * HEAVY > total).select(side).collect()]

    def __bool__(self) -> bool:
        return self.square > 0

    def times(self, factors: DataFrame, width: int, over: str) -> DataFrame:
        """The matrix times ``factors <over, f>``, summed over the key ``over`` ("c", or "r" for the transposed matrix)."""
        to = "r" if over == "c" else "c"
        held = self.heavy[over]
        if held:
            many = F.col(over).isin(held)
            joined = self.cells.filter(many).join(F.broadcast(factors.filter(many)), over)
            joined = joined.unionByName(self.cells.filter(~many).join(factors, over))
        else:
            joined = self.cells.join(factors, over)
        sums = joined.groupBy(to).agg(*[F.sum(F.col("x") * F.col("f")[j]).alias(f"f{j}") for j in range(width)])
        return cut_lineage(sums.select(to, F.array(*[F.col(f"f{j}") for j in range(width)]).alias("f")))


def _stacked(pdf: pd.DataFrame, column: str = "f") -> np.ndarray:
    return np.stack(pdf[column].to_numpy()).astype(np.float64)


def triangle(factors: DataFrame) -> np.ndarray:
    """The triangular factor of a tall table of arrays: one small triangle a task, joined in two steps."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = None
        for pdf in batches:
            if len(pdf):
                rows = _stacked(pdf)
                held = np.linalg.qr(rows if held is None else np.vstack([held, rows]), mode="r")
        if held is not None:
            yield pd.DataFrame({"g": [TaskContext.get().partitionId() % GROUPS], "m": [held.tobytes()], "w": [held.shape[1]]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["w"].iloc[0])
        rows = np.vstack([np.frombuffer(m).reshape(-1, width) for m in pdf["m"]])
        return pd.DataFrame({"m": [np.linalg.qr(rows, mode="r").tobytes()], "w": [width]})

    parts = factors.select("f").mapInPandas(reduce, "g int, m binary, w int").groupBy("g").applyInPandas(join, "m binary, w int").collect()
    if not parts:
        return np.empty((0, 0))
    return np.linalg.qr(np.vstack([np.frombuffer(p.m).reshape(-1, p.w) for p in parts]), mode="r")


def turned(factors: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """Every array times a small matrix."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], "f": list(_stacked(pdf) @ turn)})

    return cut_lineage(factors.select(key, "f").mapInPandas(multiply, f"{key} {factors.schema[key].dataType.simpleString()}, f array<double>"))


def orthonormal(factors: DataFrame, key: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """A table with orthonormal columns that span the same space, the singular values, and the turn that led there.

    Columns that depend on others to rounding are left out. A second round removes what rounding left in the first.
    """
    _, values, right = np.linalg.svd(triangle(factors), full_matrices=False)
    keep = values > values.max(initial=0.0) * 1e-12
    turn = right[keep].T / values[keep]
    once = turned(factors, key, turn)
    _, again, fix = np.linalg.svd(triangle(once), full_matrices=False)
    return turned(once, key, fix.T / again), values[keep], turn @ (fix.T / again)


@dataclass
class Decomposition:
    """``values`` falling; ``left <r, f>`` and ``right <c, f>`` with one number for each value, of length one by column."""

    values: np.ndarray
    left: DataFrame
    right: DataFrame
    rounds: int


def sparse_svd(matrix: SparseTable, components: int, oversample: int = 10, tolerance: float = 1e-9, seed: int = 42) -> Decomposition:
    """The leading singular values and vectors by a random range finder with subspace iteration.

    The range starts from random signs, made from the hash of each column's key; each round multiplies by the matrix and its
    transpose and brings the range back to orthonormal columns by tall-skinny QR. It goes on until no leading value changes by
    more than ``tolerance`` of the largest one. With fewer independent rows than ``components`` there are fewer values.
    """
    if components < 1:
        raise ValueError("SVD needs at least one component")
    if not matrix:
        raise ValueError("the matrix has no cells")
    width = components + oversample
    bits = [F.shiftright(F.xxhash64(F.col("c").cast("string"), F.lit(seed + j // 60)), j % 60).bitwiseAND(1) for j in range(width)]
    signs = matrix.keys["c"].select("c", F.array(*[(bit * 2 - 1).cast("double") for bit in bits]).alias("f"))
    span, _, _ = orthonormal(matrix.times(signs, width, "c"), "r")
    before, rounds = np.zeros(components), 0
    while True:
        width = len(span.select("f").first()[0])
        right, _, _ = orthonormal(matrix.times(span, width, "r"), "c")
        image = matrix.times(right, len(right.select("f").first()[0]), "c")
        _, values, turn = np.linalg.svd(triangle(image), full_matrices=False)
        rounds += 1
        now = np.pad(values[:components], (0, max(0, components - len(values))))
        if np.abs(now - before).max() <= tolerance * now[0]:
            break
        before = now
        span, _, _ = orthonormal(image, "r")
    kept = min(components, int((values > values[0] * 1e-12).sum()))
    side = turn[:kept].T
    return Decomposition(values[:kept], turned(image, "r", side / values[:kept]), turned(right, "c", side), rounds)


def small_gram(factors: DataFrame, width: int, other: str | None = None) -> np.ndarray:
    """The sum of the outer products of ``f`` with itself or with the array column ``other``: one small matrix a task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                held += _stacked(pdf).T @ _stacked(pdf, other or "f")
        yield pd.DataFrame({"i": np.arange(width * width), "x": held.ravel()})

    columns = ["f", other] if other else ["f"]
    rows = factors.select(*columns).mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for i, x in rows:
        out[i] = x
    return out.reshape(width, width)


@dataclass
class Parts:
    """``rows <r, f>`` and ``columns <c, f>``, nowhere negative; ``residuals`` after each round, relative to the matrix."""

    rows: DataFrame
    columns: DataFrame
    residuals: list[float]


def _descend(products: DataFrame, start: DataFrame, key: str, gram: np.ndarray, sweeps: int) -> DataFrame:
    """The factors of one side by exact steps along one component at a time, nowhere negative; also the products they met."""
    scale = np.where(np.diag(gram) > 0, np.diag(gram), 1.0)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                target, f = _stacked(pdf, "p"), _stacked(pdf)
                for _ in range(sweeps):
                    for j in range(len(gram)):
                        if gram[j, j] > 0:
                            f[:, j] = np.maximum(f[:, j] + (target[:, j] - f @ gram[:, j]) / scale[j], 0.0)
                yield pd.DataFrame({key: pdf[key], "f": list(f), "p": list(target)})

    rows = products.withColumnRenamed("f", "p").join(start.select(key, "f"), key)
    kind = products.schema[key].dataType.simpleString()
    return cut_lineage(rows.mapInPandas(solve, f"{key} {kind}, f array<double>, p array<double>"))


def nonnegative_factors(matrix: SparseTable, components: int, tolerance: float = 1e-3, most_rounds: int = 200, sweeps: int = 3, seed: int = 42) -> Parts:
    """Non-negative factors by alternating least squares: the rows' factors times the columns' factors approach the matrix.

    A round solves one side with the other held, from the matrix times that side and its small Gram matrix; single components
    are minimized exactly, so the residual never rises. It ends when a round lowers the residual by less than ``tolerance`` of
    the matrix. Rows start from numbers made from the hash of their keys, columns from zero.
    """
    if components < 1:
        raise ValueError("factors need at least one component")
    if not matrix:
        raise ValueError("the matrix has no cells")
    hashed = [F.pmod(F.xxhash64(F.col("r").cast("string"), F.lit(seed + j)), F.lit(1_000_003)) / 1_000_003.0 for j in range(components)]
    rows = cut_lineage(matrix.keys["r"].select("r", F.array(*[h + 0.01 for h in hashed]).alias("f")))
    columns = matrix.keys["c"].select("c", F.array_repeat(F.lit(0.0), components).alias("f"))
    residuals: list[float] = []
    while len(residuals) < most_rounds:
        columns = _descend(matrix.times(rows, components, "r"), columns, "c", small_gram(rows, components), sweeps)
        gram = small_gram(columns, components)
        rows = _descend(matrix.times(columns, components, "c"), rows, "r", gram, sweeps)
        along = float(np.trace(small_gram(rows, components, "p")))
        left = matrix.square - 2 * along + float((small_gram(rows, components) * gram).sum())
        residuals.append(float(np.sqrt(max(left, 0.0) / matrix.square)))
        if len(residuals) > 1 and residuals[-2] - residuals[-1] < tolerance:
            break
    return Parts(rows.select("r", "f"), columns.select("c", "f"), residuals)


def residual_of(matrix: SparseTable, parts: Parts) -> float:
    """The relative residual worked out again, cell by cell; places without a cell count by the factors' own squares."""
    joined = matrix.cells.join(parts.rows.withColumnRenamed("f", "a"), "r").join(parts.columns.withColumnRenamed("f", "b"), "c")
    made = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    cells = joined.select("x", made.alias("m")).agg(F.sum((F.col("x") - F.col("m")) ** 2), F.sum(F.col("m") ** 2)).first()
    width = len(parts.rows.select("f").first()[0])
    whole = float((small_gram(parts.rows, width) * small_gram(parts.columns, width)).sum())
    return float(np.sqrt(max(cells[0] + whole - cells[1], 0.0) / matrix.square))


def factor_words(parts: Parts, count: int = 10) -> DataFrame:
    """``<topic, rank, word, score>``: the columns of largest weight in each component, ties by the column."""
    from themeloom.operators.weighting import top_words

    long = parts.columns.select(F.col("c").alias("term"), F.posexplode("f").alias("topic", "score"))
    return top_words(long, count)


def strongest(parts: Parts, key: str = "doc_id") -> DataFrame:
    """``<key, topic, share>``: the component of largest weight of each row, ties by the smallest, and its share; -1 without weight."""
    total = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x)
    at = F.array_position("f", F.array_max("f")) - 1
    return parts.rows.select(
        F.col("r").alias(key), F.when(total > 0, at).otherwise(-1).cast("int").alias("topic"), F.when(total > 0, F.array_max("f") / total).otherwise(0.0).alias("share")
    )
