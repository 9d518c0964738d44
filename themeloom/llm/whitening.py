"""Embedding whitening: principal components from an exact characteristic polynomial.

Entries become integers of 1/256. The fit list holds each distinct vector once. Its sums and the scatter of its centred
vectors are added up exactly in tasks; tasks also reduce the scatter matrix modulo one prime each, and work out
the null space of each leading root. What the driver holds is bounded by the square of the vectors' width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import exact_spectrum
from themeloom.llm.common import python_ready, read, stored

COMPONENTS = 4
#: Bits of a limb: products of two limbs, added over BLOCK rows, are exact in double precision.
LIMB, BLOCK = 21, 2048
#: Bits of the parts in which whole numbers of any size are added up by Spark.
PART = 60


@dataclass
class Whitening:
    """``n`` vectors of ``width`` entries with ``sums``; ``axes`` (unit rows) with the ``variances`` along them, falling."""

    width: int = 0
    n: int = 0
    sums: list[int] = field(default_factory=list)
    axes: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    variances: np.ndarray = field(default_factory=lambda: np.empty(0))
    explained: list[float] = field(default_factory=list)
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: 64-bit integers where they suffice, else Python's."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * _largest(x)
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.axes.T / np.sqrt(self.variances)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that remain, and their entries as integers, one row each.

    Numbers beyond the range of a long stop at its ends.
    """
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.empty(0, int)
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(present & (sizes == width))
    # null entries read as NaN
    values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
    finite = np.isfinite(values).all(1)
    with np.errstate(over="ignore"):
        scaled = np.floor(values[finite] * 256)
    edge = float(1 << 63)
    out = np.where(np.abs(scaled) < edge, scaled, 0).astype(np.int64)
    out[scaled >= edge] = (1 << 63) - 1
    out[scaled <= -edge] = -(1 << 63)
    return at[finite], out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 or 8 bytes a number; rows of one width and length are equal if their bytes are."""
    high, low = x.max(1), x.min(1)
    need = np.where((high < 1 << 15) & (low >= -(1 << 15)), 2, np.where((high < 1 << 31) & (low >= -(1 << 31)), 4, 8))
    out: list[bytes] = [b""] * len(x)
    for size in np.unique(need):
        at = np.flatnonzero(need == size)
        raw = np.ascontiguousarray(x[at].astype(f"<i{size}"))
        for i, row in zip(at.tolist(), raw, strict=True):
            out[i] = row.tobytes()
    return out


def unpacked(rows: pa.Array, width: int) -> np.ndarray:
    raw = rows.to_pylist()
    sizes = np.array([len(r) for r in raw]) // width
    out = np.empty((len(raw), width), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join([raw[i] for i in at]), f"<i{size}").reshape(len(at), width)
    return out


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Parts of LIMB bits, lowest first; all but the last are not negative."""
    out, mask = [], (1 << LIMB) - 1
    while _largest(y) >= 1 << LIMB:
        out.append((y & mask).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def scatter(y: np.ndarray) -> np.ndarray:
    """The exact sum of the outer products of the rows, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for low in range(0, len(y), BLOCK):
        limbs = _limbs(y[low : low + BLOCK])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs[i:], i):
                product = (a.T @ b).astype(np.int64).astype(object)
                total += (product if i == j else product + product.T) << (LIMB * (i + j))
    return total


def _parts(numbers: list[int], places: list[tuple[int, int]]) -> pa.RecordBatch:
    """Rows ``i, j, part, value`` that add up exactly whatever the size of the numbers."""
    rows = []
    for (i, j), number in zip(places, numbers, strict=True):
        part = 0
        while number >> PART not in (0, -1):
            rows.append((i, j, part, number & ((1 << PART) - 1)))
            number, part = number >> PART, part + 1
        rows.append((i, j, part, number))
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "part", "value"])


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    total: dict[tuple[int, int], int] = {}
    # at most (width * width) numbers in a few parts
    for r in parts.groupBy("i", "j", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (int(r.value) << (PART * r.part))
    return total


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of a table of vectors.

    Vectors that are null, empty, hold null or non-finite entries, or have another width than most
    (the smaller width among equals) are left out. Repeated vectors count once. Components of variance zero cannot be
    whitened and are left out, so equal vectors, one vector or an empty table have none.
    """
    spark = python_ready(vectors)
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.filter("size(v) > 0").groupBy(F.size("v").alias("w")).count()
    most = sizes.orderBy(F.desc("count"), "w").first()
    if most is None:
        return Whitening()
    width = most.w

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.whitening import integers, packed

        for batch in batches:
            _, x = integers(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array(packed(x) if len(x) else [], pa.binary())], names=["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.whitening import _parts, unpacked

        total, seen = [0] * (width + 1), False
        for batch in batches:
            x = unpacked(batch.column(0), width)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, [*high, 0], [*low, len(x)], strict=True)]
            seen = True
        if seen:
            yield _parts(total, [(i, 0) for i in range(width + 1)])

    fit_list = stored(rows.mapInArrow(pack, "x binary").distinct(), "fit-list")
    sums = _added(fit_list.mapInArrow(add, "i int, j int, part int, value long"))
    n = sums.get((width, 0), 0)
    made = Whitening(width, n, [sums.get((i, 0), 0) for i in range(width)])
    if not n:
        return made

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.whitening import _parts, scatter, unpacked

        total = np.zeros((width, width), object)
        for batch in batches:
            total = total + scatter(made.centred(unpacked(batch.column(0), width)))
        places = [(i, j) for i in range(width) for j in range(i, width)]
        if total.any():
            yield _parts([int(total[p]) for p in places], places)

    found = _added(fit_list.mapInArrow(multiply, "i int, j int, part int, value long"))
    # scatter of n * x - S is n ** 3 times the covariance, and n times a matrix of integers
    matrix = [[found.get((min(i, j), max(i, j)), 0) // n for j in range(width)] for i in range(width)]
    _solve(spark, matrix, made, components)
    if len(made.axes):
        made.identity_error = _identity_error(fit_list, made)
    return made


def _solve(spark: SparkSession, matrix: list[list[int]], made: Whitening, components: int) -> None:
    """Fills in the leading axes of ``matrix``, which is ``n ** 2`` times the covariance."""
    chosen = exact_spectrum.primes_needed(matrix)
    held = spark.sparkContext.broadcast(matrix)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.exact_spectrum import polynomial_mod

        for batch in batches:
            for i in batch.column(0).to_pylist():
                p = chosen[i]
                found = polynomial_mod(np.array([[x % p for x in row] for row in held.value]), p)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([found], pa.list_(pa.int64()))], names=["id", "found"])

    slots = spark.sparkContext.defaultParallelism
    rows = spark.range(0, len(chosen), 1, min(len(chosen), slots)).mapInArrow(reduce, "id long, found array<long>").collect()
    polynomial = exact_spectrum.remaindered({chosen[r.id]: r.found for r in sorted(rows, key=lambda r: r.id)})
    roots, left = [], components
    for root, shift, multiplicity in exact_spectrum.largest_roots(polynomial, components):
        roots.append((root, shift, min(multiplicity, left)))
        left -= roots[-1][2]
    if not roots:
        return

    def annihilate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.exact_spectrum import null_space

        for batch in batches:
            for i in batch.column(0).to_pylist():
                axes = [[float(x) for x in v] for v in null_space(held.value, *roots[i])]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([axes], pa.list_(pa.list_(pa.float64())))], names=["id", "axes"])

    rows = spark.range(0, len(roots), 1, len(roots)).mapInArrow(annihilate, "id long, axes array<array<double>>").collect()
    made.axes = np.array([axis for r in sorted(rows, key=lambda r: r.id) for axis in r.axes])
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    with localcontext() as context:
        context.prec = 60
        values = [Decimal(root) / Decimal(2) ** shift for root, shift, times in roots for _ in range(times)]
        made.variances = np.array([float(v / made.n / made.n) for v in values])
        made.explained = [float(v / trace) for v in values]


def _identity_error(fit_list: DataFrame, made: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity."""
    k = len(made.axes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.whitening import unpacked

        for batch in batches:
            w = made.project(made.centred(unpacked(batch.column(0), made.width)))
            found = np.concatenate([w.sum(0), (w.T @ w).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["i", "value"])

    rows = fit_list.mapInArrow(add, "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
    sums = np.array([r.value for r in sorted(rows, key=lambda r: r.i)]) / made.n
    mean = sums[:k]
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, made: Whitening, vector: str = "embedding") -> DataFrame:
    """All columns as a struct ``row``, ``deviation`` (decimal: sum of ``(n * x - S) ** 2``, exact, null from 1e38 on) and
    ``whitened``, one number for each component.

    Rows that ``fit`` leaves out are dropped; repeated rows are rows of their own; an empty table gives no rows.
    """
    python_ready(vectors)
    rows = vectors.select(F.struct("*").alias("row"), F.col(vector).cast("array<double>").alias("v"))
    schema = rows.select("row", F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("array<double>").alias("whitened")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.whitening import integers

        for batch in batches:
            at, x = integers(batch.column("v"), made.width) if made.n else (np.empty(0, int), np.empty((0, 0), np.int64))
            y = made.centred(x)
            if _largest(y) ** 2 * max(made.width, 1) < 1 << 62:
                square = (y * y).sum(1)
                high, low = square >> PART, square & ((1 << PART) - 1)
            else:
                square = (y.astype(object) ** 2).sum(1)
                high = [s >> PART if s >> PART < 1 << 62 else None for s in square]
                low = [s & ((1 << PART) - 1) for s in square]
            whitened = made.project(y) if len(made.axes) else np.empty((len(at), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * whitened.shape[1]), pa.array(whitened.ravel()))
            row = batch.column("row").take(pa.array(at))
            yield pa.RecordBatch.from_arrays([row, pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists], names=["row", "high", "low", "whitened"])

    whole = F.try_add(F.try_multiply(F.col("high").cast("decimal(20,0)"), F.lit(1 << PART).cast("decimal(20,0)")).cast("decimal(38,0)"), F.col("low").cast("decimal(38,0)"))
    return rows.mapInArrow(apply, schema).select("row", whole.cast("decimal(38,0)").alias("deviation"), "whitened")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    made = fit(vectors)
    rows = whiten(vectors.select("vec_id", "embedding"), made).select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, made.explained)) if made.explained else F.array().cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(made.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(made.identity_error).alias("identity_error"),
    )
