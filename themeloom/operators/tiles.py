"""Bounded blocks of points ("tiles") for exact pairwise work.

A pairwise operator never joins points with points. Points are packed into tiles of about
``TILE_ROWS`` rows, tiles that cannot contribute are pruned by centre and radius, and the
surviving tile pairs are evaluated as small dense blocks that return reduced rows (a sum, a
top-k, a spanning forest), never the pairs themselves. A crowded region simply becomes more
tiles, so no task ever holds more than two of them at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from themeloom.functions.vectors import as_doubles
from themeloom.operators.selection import shuffle_key
from themeloom.session import cut_lineage

TILE_ROWS = 2048
MAX_CELLS = 1024


def collapse_copies(points: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Identical vectors become one weighted point.

    Returns ``members <key, rep>`` and ``distinct <rep, vector, copies>`` where ``rep`` is the
    smallest key. The group-by counts before it shuffles and the join back has one right row
    per vector, so a vector shared by a third of all rows stays cheap.
    """
    hashed = points.select(F.col(key).cast("long").alias(key), as_doubles(F.col(vector)).alias(vector)).withColumn(
        "_h", F.xxhash64(vector)
    )
    distinct = hashed.groupBy("_h", vector).agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = hashed.join(distinct, ["_h", vector]).select(key, "rep")
    return members, distinct.select("rep", vector, "copies")


def block_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances between the rows of two blocks, and how far rounding may put them off.

    Both blocks are moved to the centre of the second one first, so that points far from the
    origin do not lose their differences.
    """
    origin = b.mean(axis=0)
    a, b = a - origin, b - origin
    left, right = (a * a).sum(1), (b * b).sum(1)
    slack = 4.0 * (a.shape[1] + 4) * np.finfo(float).eps * (left.max(initial=0.0) + right.max(initial=0.0))
    return np.maximum(left[:, None] + right[None, :] - 2.0 * (a @ b.T), 0.0), float(slack)


def block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks, as near as rounding allows.

    For sums and bounds. Where a distance decides, use ``within`` or work it out again.
    """
    return np.sqrt(block_squares(a, b)[0])


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between paired rows, from their differences."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of two blocks are at most ``eps`` apart; pairs too near to the edge for rounding
    are decided by their differences."""
    squares, slack = block_squares(a, b)
    slack += 4.0 * np.finfo(float).eps * eps * eps
    inside = squares <= eps * eps + slack
    sure = squares < eps * eps - slack
    rows, cols = np.nonzero(inside ^ sure)
    for low in range(0, len(rows), 100_000):
        r, c = rows[low : low + 100_000], cols[low : low + 100_000]
        inside[r, c] = pair_distances(a[r], b[c]) <= eps
    return inside


#: Rows of the left block that meet the right one at once.
NEAR_ROWS = 512


def near_pairs(a: np.ndarray, b: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all pairs whose squared distance is at most the row's ``edge``, and of a few that rounding may put there.

    Single precision where its rounding is small beside the edges; the caller decides by ``pair_distances``.
    """
    origin = b.mean(axis=0)
    a, b = a - origin, b - origin
    left, right = (a * a).sum(1), (b * b).sum(1)
    size, width = left.max(initial=0.0) + right.max(initial=0.0), a.shape[1]
    single, double = (8.0 * (width + 4) * float(np.finfo(kind).eps) * size for kind in (np.float32, np.float64))
    kind, slack = (np.float32, single) if 1e-30 < size < 1e30 and single <= 0.02 * np.median(edge) else (np.float64, double)
    # one product makes |b|^2 - 2ab + |a|^2
    x = np.hstack([a, np.ones((len(a), 1)), left[:, None]]).astype(kind)
    y = np.ascontiguousarray(np.hstack([-2.0 * b, right[:, None], np.ones((len(b), 1))]).astype(kind).T)
    limit = (edge * (1 + 1e-12) + slack).astype(kind)[:, None]
    found = []
    for low in range(0, len(x), NEAR_ROWS):
        hit = np.flatnonzero(x[low : low + NEAR_ROWS] @ y <= limit[low : low + NEAR_ROWS])
        if len(hit):
            found.append(hit + low * len(b))
    at = np.concatenate(found) if found else np.empty(0, np.int64)
    return at // max(len(b), 1), at % max(len(b), 1)


def floors_to(points: np.ndarray, others: list[Block]) -> np.ndarray:
    """Lower bounds of the distances between points and the points of other tiles, a row a point."""
    centers = np.array([b.value("center") for b in others], dtype=np.float64)
    radius = np.array([b.value("radius") for b in others])
    squares, slack = block_squares(points, centers)
    apart = np.sqrt(np.maximum(squares - slack, 0.0))
    return apart - radius - 1e-9 * (1.0 + apart + radius)


def spread_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles dealt out for work that takes long for each."""
    n = tiles.count()
    return tiles.repartition(max(1, min(n, max(64, n // 8))), "tile")


def pack(df: DataFrame, tile: list[str], key: str, vector: str, extras: tuple[str, ...] = ()) -> DataFrame:
    """One row per group of the ``tile`` columns: packed keys, vectors and extra numbers (bigint
    or double, the former with their range), plus centre and radius. Groups must be bounded by
    construction. A tile is named by its smallest key."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    width = {c: np.int64 if fields[c] == "bigint" else np.float64 for c in extras}
    kinds = ", ".join(f"{c} {fields[c]}" for c in tile)
    schema = f"tile long, {kinds}, n int, ids binary, vecs binary, center array<double>, radius double" + "".join(
        f", {c} binary" + (f", {c}_low long, {c}_high long" if width[c] is np.int64 else "") for c in extras
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        vecs = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        center = vecs.mean(axis=0)
        row = {"tile": [int(pdf[key].iloc[0])], **{c: [pdf[c].iloc[0]] for c in tile}}
        row.update(
            n=[len(pdf)],
            ids=[pdf[key].to_numpy(np.int64).tobytes()],
            vecs=[vecs.tobytes()],
            center=[center],
            radius=[float(np.sqrt(((vecs - center) ** 2).sum(1)).max())],
        )
        for c in extras:
            row[c] = [pdf[c].to_numpy(width[c]).tobytes()]
            if width[c] is np.int64:
                row[f"{c}_low"], row[f"{c}_high"] = [int(pdf[c].min())], [int(pdf[c].max())]
        return pd.DataFrame(row)

    return df.select(*tile, key, vector, *extras).groupBy(*tile).applyInPandas(build, schema)


class Block:
    """A decoded tile."""

    __slots__ = ("ids", "vecs", "row", "side")

    def __init__(self, row: dict, side: str):
        self.row, self.side = row, side
        self.ids = np.frombuffer(row[f"{side}_ids"], np.int64)
        self.vecs = np.frombuffer(row[f"{side}_vecs"], np.float64).reshape(len(self.ids), -1)

    def extra(self, name: str, dtype: type = np.float64) -> np.ndarray:
        return np.frombuffer(self.row[f"{self.side}_{name}"], dtype)

    def value(self, name: str):
        return self.row[f"{self.side}_{name}"]


def prefixed(tiles: DataFrame, side: str) -> DataFrame:
    return tiles.select(*[F.col(c).alias(f"{side}_{c}") for c in tiles.columns])


def map_pairs(
    pairs: DataFrame, left: DataFrame, right: DataFrame, fn: Callable[[Block, Block], pd.DataFrame | None], schema: str
) -> DataFrame:
    """Evaluate ``fn`` on tile pairs ``<a_tile, b_tile>``; each row carries two bounded tiles."""
    rows = (
        pairs.select("a_tile", "b_tile")
        .join(prefixed(left, "a"), "a_tile")
        .join(prefixed(right, "b"), "b_tile")
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                out = fn(Block(row, "a"), Block(row, "b"))
                if out is not None and len(out):
                    yield out

    return rows.mapInPandas(work, schema)


#: Strips that a table of tiles is cut into where it meets another one, the rows below which one strip is enough, and the bytes of
#: vectors that a strip may hold.
STRIPS, STRIP_ROWS, STRIP_BYTES = 16, 1024, 1 << 26


def _strips(tiles: DataFrame) -> int:
    held = tiles.agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("n"), F.sum(F.length("vecs")).alias("b")).first()
    rows, size = held["n"] or 0, held["b"] or 0
    return max(1, min(held["t"], max(min(STRIPS, math.ceil(rows / STRIP_ROWS)), math.ceil(size / STRIP_BYTES))))


def meet_strips(
    left: DataFrame,
    right: DataFrame,
    fn: Callable[[list[Block], list[Block]], Iterator[pd.DataFrame] | pd.DataFrame | None],
    schema: str,
    half: bool = False,
) -> DataFrame:
    """Evaluate ``fn`` on every pair of a left and a right strip of tiles; it skips tile pairs that cannot contribute.

    A tile moves once for each strip of the other side, whatever the number of tiles it meets, so with a fixed number of strips
    the shuffle grows with the table. Once a strip would exceed STRIP_BYTES there are more of them. With ``half`` (both sides
    the same table) each unordered pair of strips is evaluated once.
    """
    n_left, n_right = _strips(left), _strips(right)

    def dealt(tiles: DataFrame, side: str, here: str, n_here: int, there: str, n_there: int) -> DataFrame:
        others = F.explode(F.sequence(F.lit(0), F.lit(n_there - 1)))
        found = prefixed(tiles, side).withColumn(here, F.pmod(F.xxhash64(f"{side}_tile"), F.lit(n_here)).cast("int")).withColumn(there, others)
        return (found.filter("a_strip <= b_strip") if half else found).repartition(n_left * n_right, "a_strip", "b_strip")

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return empty
        lists = [[Block(row, side) for row in pdf.to_dict("records")] for side, pdf in (("a", a), ("b", b))]
        found = fn(*[sorted(blocks, key=lambda x: x.value("tile")) for blocks in lists])
        return empty if found is None or not len(found) else found

    empty = pd.DataFrame({f.name: [] for f in StructType.fromDDL(schema).fields})
    grouped = [
        dealt(left, "a", "a_strip", n_left, "b_strip", n_right).groupBy("a_strip", "b_strip"),
        dealt(right, "b", "b_strip", n_right, "a_strip", n_left).groupBy("a_strip", "b_strip"),
    ]
    return grouped[0].cogroup(grouped[1]).applyInPandas(work, schema)


def gaps_to(a: Block, others: list[Block]) -> np.ndarray:
    """Lower bounds of the distances between the points of one tile and those of others."""
    centers = np.array([b.value("center") for b in others], dtype=np.float64)
    apart = pair_distances(np.asarray(a.value("center"), dtype=np.float64)[None, :], centers)
    reach = a.value("radius") + np.array([b.value("radius") for b in others])
    return apart - reach - 1e-9 * (1.0 + apart + reach)


def batches_of(blocks: list[Block], rows: int) -> Iterator[list[Block]]:
    """Consecutive tiles with about so many rows together."""
    held, size = [], 0
    for block in blocks:
        held.append(block)
        size += len(block.ids)
        if size >= rows:
            yield held
            held, size = [], 0
    if held:
        yield held


def meet_all(left: DataFrame, right: DataFrame, lanes: int) -> DataFrame:
    """Every pair of a left and a right tile, once: right tiles hash to lanes and left tiles
    visit each lane. For statistics that are defined over all pairs of points."""
    lane = F.pmod(F.xxhash64("b_tile"), F.lit(lanes))
    visits = left.select(F.col("tile").alias("a_tile"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    homes = right.select(F.col("tile").alias("b_tile")).withColumn("lane", lane)
    return visits.join(homes, "lane").select("a_tile", "b_tile")


class CellTiles:
    """Tiles grouped in cells around sampled pivots, with per-cell summaries on the driver
    (never more than ``MAX_CELLS`` of them)."""

    def __init__(self, tiles: DataFrame, cells: np.ndarray, pivots: np.ndarray, reach: np.ndarray, sizes: np.ndarray):
        self.tiles, self.cells, self.pivots, self.reach, self.sizes = tiles, cells, pivots, reach, sizes

    def gaps(self) -> np.ndarray:
        """Lower bound of the distance between points of two cells."""
        squares, slack = block_squares(self.pivots, self.pivots)
        apart = np.sqrt(np.maximum(squares - slack, 0.0))
        return np.maximum(apart - self.reach[:, None] - self.reach[None, :], 0.0)

    def spans(self) -> np.ndarray:
        """Upper bound of the distance between points of two cells."""
        squares, slack = block_squares(self.pivots, self.pivots)
        return np.sqrt(squares + slack) + self.reach[:, None] + self.reach[None, :]

    def cell_pairs(self, keep: np.ndarray, columns: dict[str, np.ndarray] | None = None) -> DataFrame:
        """Kept cell pairs as a table (at most MAX_CELLS squared rows), with values per pair."""
        a, b = np.nonzero(keep)
        frame = {"a_cell": self.cells[a].astype(np.int32), "b_cell": self.cells[b].astype(np.int32)}
        kinds = "a_cell int, b_cell int"
        for name, matrix in (columns or {}).items():
            frame[name] = matrix[a, b].astype(np.float64)
            kinds += f", {name} double"
        return self.tiles.sparkSession.createDataFrame(pd.DataFrame(frame), kinds)


def cell_tiles(
    points: DataFrame,
    key: str,
    vector: str,
    extras: tuple[str, ...] = (),
    tile_rows: int | None = None,
    max_cells: int | None = None,
) -> CellTiles:
    """Assign points to their nearest sampled pivot and pack each cell into tiles."""
    tile_rows, max_cells = tile_rows or TILE_ROWS, max_cells or MAX_CELLS
    n = points.count()
    count = max(1, min(max_cells, math.ceil(n / tile_rows)))
    sample = points.orderBy(shuffle_key(key, 7), key).limit(count).select(vector).collect()
    pivots = np.array([row[0] for row in sample], dtype=np.float64)
    if not len(pivots):
        raise ValueError("no points")
    fields = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in points.select(key, vector, *extras).schema.fields
    )

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vecs = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                cell = block_squares(vecs, pivots)[0].argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), reach=pair_distances(vecs, pivots[cell]))

    placed = points.select(key, vector, *extras).mapInPandas(nearest, f"{fields}, cell int, reach double")
    placed = cut_lineage(placed)
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).orderBy("cell").collect()
    cells = np.array([r["cell"] for r in summary])
    chunks = {r["cell"]: math.ceil(r["n"] / tile_rows) for r in summary}
    size_of = F.create_map(*[F.lit(int(x)) for c in cells for x in (c, chunks[c])])
    chunk = F.pmod(F.xxhash64(key), F.element_at(size_of, F.col("cell")))
    tiles = cut_lineage(pack(placed.withColumn("chunk", chunk), ["cell", "chunk"], key, vector, extras))
    return CellTiles(
        tiles,
        cells,
        pivots[cells],
        np.array([r["reach"] for r in summary]),
        np.array([r["n"] for r in summary]),
    )
