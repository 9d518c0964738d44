"""Exact nearest neighbours and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.vectors import distance, normalize
from themeloom.operators.tiles import (
    Block,
    CellTiles,
    batches_of,
    block_squares,
    cell_tiles,
    collapse_copies,
    floors_to,
    gaps_to,
    meet_strips,
    near_pairs,
    pair_distances,
    spread_tiles,
)
from themeloom.session import cut_lineage


def _nearest_in_block(a: Block, b: Block, k: int) -> pd.DataFrame | None:
    """The k nearest points of ``b`` for each point of ``a`` (not itself), ties by id."""
    apart, slack = block_squares(a.vecs, b.vecs)
    apart[a.ids[:, None] == b.ids[None, :]] = np.inf
    width = min(k, apart.shape[1])
    edge = np.partition(apart, width - 1, axis=1)[:, width - 1]
    # all that rounding may have put behind the edge stay until the exact distance decides
    rows, cols = np.nonzero((apart <= edge[:, None] + 2 * slack) & np.isfinite(apart))
    if not len(rows):
        return None
    exact = pair_distances(a.vecs[rows], b.vecs[cols])
    order = np.lexsort((b.ids[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = place < k
    return pd.DataFrame({"src": a.ids[rows[keep]], "dst": b.ids[cols[keep]], "dist": exact[keep]})


#: Rows of the right side that a tile meets at once.
BATCH_ROWS = 2048
EDGES = "src long, dst long, dist double"


class _Nearest:
    """The ``k`` nearest points found so far of every point of a tile (not itself), ties by id.

    ``bound`` holds a distance per point that its ``k`` nearest do not exceed.
    """

    def __init__(self, a: Block, k: int, bound: np.ndarray):
        self.a, self.k, self.bound = a, k, bound.copy()
        self.pool = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def meet(self, ids: np.ndarray, vecs: np.ndarray, some: np.ndarray | None = None) -> None:
        """``some``: the places of the points that meet them (all if not given)."""
        open_ = np.flatnonzero(~np.isfinite(self.bound))
        if some is None or len(open_):
            some = np.arange(len(self.a.ids))
        edge = self.bound[some] ** 2
        if len(open_):
            # one more than k, since the point itself may be among them; what rounding may have put behind the edge stays
            width = min(self.k + 1, len(ids))
            squares, slack = block_squares(self.a.vecs[open_], vecs)
            edge[open_] = np.partition(squares, width - 1, axis=1)[:, width - 1] + 2 * slack
        rows, cols = near_pairs(self.a.vecs[some], vecs, edge)
        rows = some[rows]
        other = self.a.ids[rows] != ids[cols]
        rows, cols = rows[other], cols[other]
        exact = np.empty(len(rows))
        for low in range(0, len(rows), 100_000):
            part = slice(low, low + 100_000)
            exact[part] = pair_distances(self.a.vecs[rows[part]], vecs[cols[part]])
        near = exact <= self.bound[rows]
        if near.any():
            self.waiting.append((rows[near], ids[cols[near]], exact[near]))
            self.size += int(near.sum())
        if self.size > 4 * len(self.a.ids) or len(open_):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        rows, ids, exact = (np.concatenate(x) for x in zip(self.pool, *self.waiting))
        order = np.lexsort((ids, exact, rows))
        rows, ids, exact = rows[order], ids[order], exact[order]
        starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        last = place == self.k - 1
        self.bound[rows[last]] = exact[last]
        keep = place < self.k
        self.pool, self.waiting, self.size = (rows[keep], ids[keep], exact[keep]), [], 0

    def edges(self) -> pd.DataFrame:
        self.settle()
        rows, ids, exact = self.pool
        return pd.DataFrame({"src": self.a.ids[rows], "dst": ids, "dist": exact})


def _bounded(tiles: DataFrame, k: int) -> DataFrame:
    """Tiles with ``kth``: per point the distance to its ``k``-th neighbour inside the tile (infinite if there is none)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                a = Block({f"a_{c}": v for c, v in row.items()}, "a")
                found = _Nearest(a, k, np.full(len(a.ids), np.inf))
                found.meet(a.ids, a.vecs)
                out.append({"tile": row["tile"], "kth": found.bound.tobytes()})
            yield pd.DataFrame(out)

    return cut_lineage(tiles.join(spread_tiles(tiles.select("tile", "ids", "vecs")).mapInPandas(work, "tile long, kth binary"), "tile"))


def _nearest_in_strips(left: list[Block], right: list[Block], k: int) -> pd.DataFrame:
    """The k nearest points of the right tiles for each point of the left ones, as far as they lie within the bound ``kth``."""
    out = []
    for a in left:
        found = _Nearest(a, k, a.extra("kth"))
        floors = floors_to(a.vecs, right)
        reach = (floors <= found.bound[:, None]).any(0)
        order = np.argsort(gaps_to(a, right), kind="stable")
        place = {id(b): i for i, b in enumerate(right)}
        for batch in batches_of([right[i] for i in order if reach[i]], BATCH_ROWS):
            # bounds have shrunk since; only points whose own ball comes near take part
            some = np.flatnonzero((floors[:, [place[id(b)] for b in batch]] <= found.bound[:, None]).any(1))
            if len(some):
                found.meet(np.concatenate([b.ids for b in batch]), np.concatenate([b.vecs for b in batch]), some)
        out.append(found.edges())
    return pd.concat(out, ignore_index=True)


def _nearest_distinct(grid: CellTiles, k: int) -> DataFrame:
    """``<src, dst, dist>``: the k nearest other points of every (distinct) point.

    A first pass works inside each tile and bounds every point's distances. Then strips of tiles meet; within them
    tiles come by rising distance, are left out once they cannot hold anything nearer, and each strip returns at most ``k``
    neighbours a point. Nothing is approximated.
    """
    tiles = _bounded(grid.tiles, k)
    found = meet_strips(tiles, grid.tiles, lambda a, b: _nearest_in_strips(a, b, k), EDGES)
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")))
    return ranked.filter(F.col("_r") <= k).drop("_r")


def knn_graph(
    points: DataFrame,
    k: int = 15,
    key: str = "doc_id",
    vector: str = "embedding",
    metric: str = "euclidean",
    tile_rows: int | None = None,
    max_cells: int | None = None,
) -> DataFrame:
    """``<src, dst, rank, dist>``: the k nearest other points of each point, ties by id.

    Cosine neighbours are Euclidean neighbours of unit vectors. Copies of a vector are
    searched once and expanded at the end.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"no metric named {metric!r}; there are cosine and euclidean")
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric == "cosine":
        points = points.withColumn(vector, normalize(F.col(vector).cast("array<double>")))
    members, distinct = collapse_copies(points, key, vector)
    members, distinct = cut_lineage(members), cut_lineage(distinct)
    grid = cell_tiles(distinct, "rep", vector, tile_rows=tile_rows, max_cells=max_cells)
    near = _nearest_distinct(grid, k)
    return expand_copies(near, members, distinct, k, key, metric)


def expand_copies(near: DataFrame, members: DataFrame, distinct: DataFrame, k: int, key: str, metric: str) -> DataFrame:
    """``<src, dst, rank, dist>`` of all points from the neighbours ``<src, dst, dist>`` of distinct vectors."""
    # At most k + 1 ids per vector can matter; the window limit trims them before the shuffle.
    lowest = (
        members.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy(key)))
        .filter(F.col("_r") <= k + 1)
        .select(F.col("rep").alias("dst"), F.col(key).alias("id"))
    )
    home = distinct.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(0.0).alias("dist"))
    offered = (
        near.unionByName(home).join(lowest, "dst")
        .withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "id")))
        .filter(F.col("_r") <= k + 1)
        .groupBy("src")
        .agg(F.array_sort(F.collect_list(F.struct("dist", "id"))).alias("offer"))
    )
    picked = F.slice(F.filter("offer", lambda o: o["id"] != F.col(key)), 1, k)
    dist = F.col("o.dist") * F.col("o.dist") / 2 if metric == "cosine" else F.col("o.dist")
    return (
        members.join(offered, members["rep"] == offered["src"])
        .select(F.col(key).alias("src"), F.posexplode(picked).alias("pos", "o"))
        .select("src", F.col("o.id").alias("dst"), (F.col("pos") + 1).alias("rank"), dist.alias("dist"))
    )


def core_distances(graph: DataFrame, min_samples: int = 5) -> DataFrame:
    """``<id, core>``: distance to the ``min_samples``-th neighbour (self not counted), or to the
    farthest one where a point has fewer."""
    near = graph.filter(F.col("rank") <= min_samples)
    return near.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("core"))


def mutual_reachability(graph: DataFrame, cores: DataFrame) -> DataFrame:
    """``<u, v, w>`` with ``w = greatest(core_u, core_v, dist)``, each undirected edge once."""
    edges = graph.groupBy(
        F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    ).agg(F.min("dist").alias("dist"))
    left = cores.select(F.col("id").alias("u"), F.col("core").alias("core_u"))
    right = cores.select(F.col("id").alias("v"), F.col("core").alias("core_v"))
    return edges.join(left, "u").join(right, "v").select("u", "v", F.greatest("core_u", "core_v", "dist").alias("w"))


def fuzzy_edges(graph: DataFrame, rounds: int = 64) -> DataFrame:
    """``<u, v, w>`` (u < v): symmetric membership strengths of a neighbour graph.

    Per point, the nearest positive distance ``rho`` is subtracted and a bandwidth ``sigma``
    is solved so that the strengths sum to log2(k); both directions combine as a + b - ab.
    The bisection runs over all points of a batch at once.
    """
    near = graph.groupBy("src").agg(
        F.collect_list(F.struct("dist", F.col("dst").cast("long").alias("dst"))).alias("near"),
        F.coalesce(F.min(F.when(F.col("dist") > 0, F.col("dist"))), F.lit(0.0)).alias("rho"),
        F.avg("dist").alias("mean"),
    )
    kinds = "src long, rho double, sigma double, dst long, dist double"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, rho, mean = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            size, flat = lists.value_lengths().to_numpy(), lists.flatten()
            dist = flat.field("dist").to_numpy()
            row, starts = np.repeat(np.arange(len(size)), size), np.r_[0, np.cumsum(size)[:-1]]
            gaps, want = np.maximum(dist - rho[row], 0.0), np.log2(size)
            low, high, mid = np.zeros(len(size)), np.full(len(size), np.inf), np.ones(len(size))
            for _ in range(rounds):
                over = np.add.reduceat(np.exp(-gaps / mid[row]), starts) > want
                low, high = np.where(over, low, mid), np.where(over, mid, high)
                mid = np.where(np.isinf(high), mid * 2, (low + high) / 2)
            sigma = np.maximum(np.maximum(mid, mean * 1e-3), 1e-300)
            columns = [batch.column(0).take(pa.array(row)), pa.array(rho[row]), pa.array(sigma[row]), flat.field("dst"), flat.field("dist")]
            yield pa.RecordBatch.from_arrays(columns, names=["src", "rho", "sigma", "dst", "dist"])

    weighed = near.select(F.col("src").cast("long"), "near", "rho", "mean").mapInArrow(solve, kinds)
    weighed = weighed.select("src", "rho", "sigma", F.struct("dist", "dst").alias("e"))
    strength = F.when(F.col("e.dist") <= F.col("rho"), F.lit(1.0)).otherwise(
        F.exp(-(F.col("e.dist") - F.col("rho")) / F.col("sigma"))
    )
    directed = weighed.select("src", F.col("e.dst").alias("dst"), strength.alias("p"))
    forward = F.max(F.when(F.col("src") < F.col("dst"), F.col("p")))
    backward = F.max(F.when(F.col("src") > F.col("dst"), F.col("p")))
    a, b = F.coalesce(F.col("a"), F.lit(0.0)), F.coalesce(F.col("b"), F.lit(0.0))
    return (
        directed.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg(forward.alias("a"), backward.alias("b"))
        .select("u", "v", (a + b - a * b).alias("w"))
    )
