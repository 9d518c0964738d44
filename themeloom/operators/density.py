"""Density-based clustering: DBSCAN, minimum spanning trees, single linkage and HDBSCAN."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from themeloom.functions.vectors import as_doubles, distance, normalize
from themeloom.operators import graph
from themeloom.operators.graph import DisjointSets, connected_components, consecutive, in_one_task, minimum_forest
from themeloom.operators.neighbors import BATCH_ROWS, _nearest_distinct
from themeloom.operators.selection import shuffle_key
from themeloom.operators.tiles import (
    TILE_ROWS,
    Block,
    CellTiles,
    batches_of,
    cell_tiles,
    collapse_copies,
    floors_to,
    gaps_to,
    meet_strips,
    near_pairs,
    pack,
    pair_distances,
    spread_tiles,
    within,
)
from themeloom.session import cut_lineage

KEY_DIMS = 3


# ---------------------------------------------------------------------------------------------
# DBSCAN
# ---------------------------------------------------------------------------------------------


def _grid(points: DataFrame, vector: str, eps: float, tile_rows: int) -> tuple[list[int], float]:
    """Grid dimensions (the widest ones) and a cell side of eps times a power of two, chosen so
    that cells hold a fair part of a tile on average."""
    width = points.select(F.size(vector).alias("w")).first()["w"]
    spans = points.agg(
        *[F.max(F.element_at(vector, i + 1)).alias(f"h{i}") for i in range(width)],
        *[F.min(F.element_at(vector, i + 1)).alias(f"l{i}") for i in range(width)],
        F.count(F.lit(1)).alias("n"),
    ).first()
    extent = [spans[f"h{i}"] - spans[f"l{i}"] for i in range(width)]
    dims = sorted(np.argsort(extent)[::-1][:KEY_DIMS].tolist())
    steps = max(1, min(24, math.ceil(math.log2(max(max(extent) / eps, 1.0))) + 1))
    cells = points.agg(
        *[F.approx_count_distinct(_cell(vector, dims, eps * 2**j)).alias(f"c{j}") for j in range(steps)]
    ).first()
    for j in range(steps):
        if spans["n"] / max(cells[f"c{j}"], 1) >= tile_rows / 8 or j == steps - 1:
            return dims, eps * 2**j
    return dims, eps


def _cell(vector: str, dims: list[int], side: float):
    return F.array(*[F.floor(F.element_at(vector, i + 1) / side).cast("long") for i in dims])


def _grid_tiles(
    points: DataFrame, key: str, vector: str, extras: tuple[str, ...], dims: list[int], side: float, tile_rows: int
) -> DataFrame:
    """Tiles of one grid cell each, cut by hash into bounded chunks; ``cell`` is the grid key."""
    placed = points.withColumn("cell", _cell(vector, dims, side))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("_chunks"))
    placed = placed.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64(key), F.col("_chunks")))
    return cut_lineage(pack(placed, ["cell", "chunk"], key, vector, extras))


def _adjacent(df: DataFrame, width: int) -> DataFrame:
    """Every row once per grid cell equal or adjacent to its own."""
    steps = F.array(*[F.lit(s).cast("long") for s in (-1, 0, 1)])
    for i in range(width):
        moved = [F.col("cell")[j] + F.col("_s") if j == i else F.col("cell")[j] for j in range(width)]
        df = df.withColumn("_s", F.explode(steps)).withColumn("cell", F.array(*moved)).drop("_s")
    return df


def _within_reach(a: Block, others: list[Block], eps: float) -> Iterator[list[Block]]:
    """Batches of the tiles whose balls come within eps of a tile's own."""
    gap = gaps_to(a, others)
    return batches_of([b for b, g in zip(others, gap) if g <= eps * (1 + 1e-9)], BATCH_ROWS)


def _undecided(tiles: DataFrame, width: int) -> DataFrame:
    """Tiles in cells whose surroundings hold more than one node; elsewhere nothing is left to
    link, however crowded it is."""
    ranges = tiles.groupBy("cell").agg(F.min("node_low").alias("low"), F.max("node_high").alias("high"))
    around = _adjacent(ranges, width).groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return tiles.join(around.filter("low < high").select("cell"), "cell", "left_semi")


def _links_in_strips(left: list[Block], right: list[Block], eps: float) -> pd.DataFrame | None:
    """Links between nodes within eps of each other, cut down to a spanning forest. Nodes that the strips have already
    linked count as one, so places that are settled cost nothing more."""
    nodes = np.unique(np.concatenate([b.extra("node", np.int64) for b in left + right]))
    at = {id(b): np.searchsorted(nodes, b.extra("node", np.int64)) for b in left + right}
    home, kept = np.arange(len(nodes)), []
    for a in left:
        for batch in _within_reach(a, right, eps):
            ga, gb = home[at[id(a)]], home[np.concatenate([at[id(b)] for b in batch])]
            if (ga == ga[0]).all() and (gb == ga[0]).all():
                continue
            rows, cols = np.nonzero(within(a.vecs, np.concatenate([b.vecs for b in batch]), eps) & (ga[:, None] != gb[None, :]))
            if not len(rows):
                continue
            links = np.unique(np.minimum(ga[rows], gb[cols]) * len(nodes) + np.maximum(ga[rows], gb[cols]))
            sets = DisjointSets()
            new = [(u, v) for u, v in zip((links // len(nodes)).tolist(), (links % len(nodes)).tolist()) if sets.union(u, v)]
            kept += new
            moved = np.arange(len(nodes))
            for x in list(sets.parent):
                moved[x] = sets.find(x)
            home = moved[home]
    return pd.DataFrame({"u": nodes[[u for u, _ in kept]], "v": nodes[[v for _, v in kept]]}) if kept else None


def _measured(points: DataFrame, vector: str, metric: str) -> DataFrame:
    """Cosine distance is half the squared Euclidean distance of unit vectors."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"no metric named {metric!r}; there are cosine and euclidean")
    return points if metric == "euclidean" else points.withColumn(vector, normalize(as_doubles(F.col(vector))))


def dbscan(
    points: DataFrame,
    eps: float = 0.5,
    min_samples: int = 5,
    key: str = "doc_id",
    vector: str = "reduced",
    out: str = "topic",
    tile_rows: int | None = None,
    metric: str = "euclidean",
) -> DataFrame:
    """``<key, out>``: exact DBSCAN labels, numbered by smallest core key; noise is -1.

    Copies are one weighted point. A fine grid of diagonal eps settles crowded places without
    any distance: a fine cell with ``min_samples`` points is all core and connected. Tiles
    then count neighbours of the remaining points, link groups of core points (first a few
    points per fine cell, then all, skipping tiles already in one component) and give border
    points the smallest label in reach. Under the cosine metric ``eps`` is a cosine distance.
    """
    points, eps = _measured(points, vector, metric), math.sqrt(2 * eps) if metric == "cosine" else eps
    rows = tile_rows or TILE_ROWS
    members, distinct = collapse_copies(points, key, vector)
    members, distinct = cut_lineage(members), cut_lineage(distinct.withColumnRenamed(vector, "v"))
    shape = distinct.select(F.size("v").alias("w")).first()
    if shape is None:
        return members.select(key, F.lit(-1).alias(out))
    fine_side = eps / math.sqrt(shape["w"]) * (1 - 1e-9)
    dims, side = _grid(distinct, "v", eps, rows)

    fined = distinct.withColumn("fine", F.transform("v", lambda x: F.floor(x / fine_side).cast("long")))
    crowds = fined.groupBy("fine").agg(F.sum("copies").alias("_w"), F.min("rep").alias("crowd"))
    placed = cut_lineage(
        fined.join(crowds, "fine").select(
            "rep", "v", F.col("copies").cast("double").alias("copies"), "crowd", (F.col("_w") >= min_samples).alias("crowded")
        )
    )
    everything = _grid_tiles(placed, "rep", "v", ("copies",), dims, side, rows)
    sparse = _grid_tiles(placed.filter("NOT crowded"), "rep", "v", ("copies",), dims, side, rows)

    def reach(left: list[Block], right: list[Block]) -> pd.DataFrame:
        out = []
        for a in left:
            part = np.zeros(len(a.ids))
            for batch in _within_reach(a, right, eps):
                part += within(a.vecs, np.concatenate([b.vecs for b in batch]), eps) @ np.concatenate([b.extra("copies") for b in batch])
            out.append(pd.DataFrame({"rep": a.ids, "part": part}))
        return pd.concat(out, ignore_index=True)

    counted = meet_strips(sparse, everything, reach, "rep long, part double")
    dense = counted.groupBy("rep").agg(F.sum("part").alias("_n")).filter(F.col("_n") >= min_samples).select("rep")
    core = placed.filter("crowded").unionByName(placed.join(dense, "rep", "left_semi"))
    # Core points of one fine cell are within eps of each other: one node per fine cell.
    nodes = core.groupBy("crowd").agg(F.min("rep").alias("node"))
    core = cut_lineage(core.join(nodes, "crowd").select("rep", "v", "node"))

    def linked(tiles: DataFrame) -> DataFrame:
        open_ = _undecided(tiles, len(dims))
        return meet_strips(open_, open_, lambda a, b: _links_in_strips(a, b, eps), "u long, v long", half=True)

    def merged(core: DataFrame, roots: DataFrame) -> DataFrame:
        found = core.join(roots.withColumnRenamed("id", "node"), "node", "left")
        return found.select("rep", "v", F.coalesce("root", "node").alias("node"))

    few = core.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(shuffle_key("rep", 3))))
    quick = _grid_tiles(few.filter(F.col("_r") <= 8).drop("_r"), "rep", "v", ("node",), dims, side, rows)
    core = cut_lineage(merged(core, connected_components(linked(quick))))
    settled = _grid_tiles(core, "rep", "v", ("node",), dims, side, rows)
    roots = cut_lineage(connected_components(linked(settled)))
    if roots.head(1):
        core = cut_lineage(merged(core, roots))
        settled = _grid_tiles(core, "rep", "v", ("node",), dims, side, rows)
    numbers = consecutive(core.select("node").distinct(), ["node"], out)

    def lowest(left: list[Block], right: list[Block]) -> pd.DataFrame:
        out = []
        for a in left:
            least = np.full(len(a.ids), np.iinfo(np.int64).max)
            for batch in _within_reach(a, right, eps):
                node = np.concatenate([b.extra("node", np.int64) for b in batch])
                inside = within(a.vecs, np.concatenate([b.vecs for b in batch]), eps)
                least = np.minimum(least, np.where(inside, node[None, :], np.iinfo(np.int64).max).min(axis=1))
            hit = least < np.iinfo(np.int64).max
            out.append(pd.DataFrame({"rep": a.ids[hit], "node": least[hit]}))
        return pd.concat(out, ignore_index=True)

    loose = _grid_tiles(placed.join(core.select("rep"), "rep", "left_anti"), "rep", "v", ("copies",), dims, side, rows)
    border = meet_strips(loose, settled, lowest, "rep long, node long")
    border = border.groupBy("rep").agg(F.min("node").alias("node"))
    labels = (
        core.select("rep", "node").unionByName(border).join(numbers, "node")
    ).select("rep", out)
    return members.join(labels, "rep", "left").select(key, F.coalesce(F.col(out), F.lit(-1)).cast("int").alias(out))


# ---------------------------------------------------------------------------------------------
# Spanning tree under mutual reachability
# ---------------------------------------------------------------------------------------------

TREE = "u long, v long, w double"
#: Neighbours of a point that the first tree may use where no core distance asks for them.
TREE_NEIGHBORS = 4


def _prim(ids: np.ndarray, vecs: np.ndarray, core: np.ndarray) -> pd.DataFrame | None:
    """Spanning tree of one dense block."""
    m = len(ids)
    if m < 2:
        return None
    best = np.full(m, np.inf)
    parent = np.zeros(m, np.int64)
    open_ = np.ones(m, bool)
    at = 0
    out = np.empty((m - 1, 2), np.int64)
    weight = np.empty(m - 1)
    for step in range(m - 1):
        open_[at] = False
        w = np.maximum(np.maximum(np.sqrt(((vecs - vecs[at]) ** 2).sum(1)), core), core[at])
        nearer = open_ & (w < best)
        best[nearer], parent[nearer] = w[nearer], at
        nxt = int(np.where(open_, best, np.inf).argmin())
        out[step] = ids[parent[nxt]], ids[nxt]
        weight[step] = best[nxt]
        at = nxt
    return pd.DataFrame({"u": out.min(axis=1), "v": out.max(axis=1), "w": weight})


def _first_tree(grid: CellTiles, near: DataFrame) -> tuple[DataFrame, bool]:
    """Edges that join all points: the tree of each tile, the edges to near neighbours (``near <u, v, w>``), and those between each tile's lead
    point and its cell's, and between cells. Also whether there is more than one tile."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a = Block({f"a_{c}": v for c, v in row.items()}, "a")
                tree = _prim(a.ids, a.vecs, a.extra("core"))
                if tree is not None:
                    yield tree

    own = cut_lineage(spread_tiles(grid.tiles.select("tile", "ids", "vecs", "core")).mapInPandas(grow, TREE))

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = [Block({f"a_{c}": v for c, v in row.items()}, "a") for row in batch.to_dict("records")]
            yield pd.DataFrame(
                {
                    "tile": [a.ids[0] for a in blocks],
                    "cell": [a.value("cell") for a in blocks],
                    "lead": [a.vecs[0] for a in blocks],
                    "lead_core": [a.extra("core")[0] for a in blocks],
                }
            )

    heads = cut_lineage(grid.tiles.select("cell", "ids", "vecs", "core").mapInPandas(head, "tile long, cell int, lead array<double>, lead_core double"))
    first = F.min(F.struct("tile", "lead", "lead_core")).alias("f")
    # at most MAX_CELLS of them
    cells = heads.groupBy("cell").agg(first).select("cell", "f.*").orderBy("cell")
    leads = cells.collect()
    ids = np.array([r["tile"] for r in leads], np.int64)
    trunk = _prim(ids, np.array([r["lead"] for r in leads], dtype=float), np.array([r["lead_core"] for r in leads], dtype=float))
    found = own.unionByName(near)
    if trunk is not None:
        found = found.unionByName(grid.tiles.sparkSession.createDataFrame(trunk, TREE))
    ends = cells.select("cell", F.col("tile").alias("u"), F.col("lead").alias("cl"), F.col("lead_core").alias("cl_core"))
    hop = F.greatest(distance(F.col("lead"), F.col("cl")), "lead_core", "cl_core").alias("w")
    hops = heads.join(F.broadcast(ends), "cell").filter("tile != u").select("u", F.col("tile").alias("v"), hop)
    return found.unionByName(hops), heads.count() > 1


#: Joins of the first tree that one task puts in order; the lighter ones are contracted before.
ORDER_EDGES = 1 << 20


def _leaf_order(tree: DataFrame, limit: int) -> tuple[DataFrame, np.ndarray, float]:
    """``<rep, pos>``, the heaviest edge between the places ``i`` and ``i + 1`` for all ``i``, and the floor.

    The heaviest edge on the tree path between two points is at most the largest of the numbers between their places, or the floor if
    they share one. Beyond ``limit`` edges, points joined by lighter ones share a place.
    """
    ids = tree.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    floor, heavy, roots = 0.0, tree, ids.select("rep", F.col("rep").alias("root"))
    if tree.count() > limit:
        floor = tree.orderBy(F.desc("w")).limit(limit).agg(F.min("w")).first()[0]
        light, heavy = tree.filter(F.col("w") <= floor), tree.filter(F.col("w") > floor)
        roots = ids.join(connected_components(light).withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"))
        roots = cut_lineage(roots)
        ru, rv = (roots.select(F.col("rep").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
        heavy = heavy.join(ru, "u").join(rv, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"), "w")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        """Components are lists of points; an edge joins the lists of its ends, and stands between them."""
        pdf = pdf.sort_values("w", kind="stable")
        names, at = np.unique(pdf[["u", "v"]].to_numpy(np.int64), return_inverse=True)
        at, weight = at.reshape(-1, 2).tolist(), pdf["w"].tolist()
        home, size = list(range(len(names))), [1] * len(names)
        first, last = list(range(len(names))), list(range(len(names)))
        after, gap = [-1] * len(names), [0.0] * len(names)

        def find(x: int) -> int:
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        for (u, v), w in zip(at, weight):
            u, v = find(u), find(v)
            after[last[u]], gap[last[u]] = first[v], w
            head, tail = first[u], last[v]
            if size[u] < size[v]:
                u, v = v, u
            home[v], size[u], first[u], last[u] = u, size[u] + size[v], head, tail
        x, row, out = first[find(0)], 0, np.empty(len(names), np.int64)
        gaps = np.empty(len(names))
        while x >= 0:
            out[row], gaps[row] = x, gap[x]
            x, row = after[x], row + 1
        return pd.DataFrame({"root": names[out], "pos": np.arange(len(names)), "gap": gaps})

    placed = cut_lineage(in_one_task(heavy.select("u", "v", "w"), order, "root long, pos long, gap double"))
    gaps = placed.select("pos", "gap").toPandas().sort_values("pos")["gap"].to_numpy()[:-1]
    # without any heavier edge all share one place
    return roots.join(placed.select("root", "pos"), "root", "left").select("rep", F.coalesce("pos", F.lit(0)).alias("pos")), gaps, floor


class _Paths:
    """Bounds of the heaviest edge on the path between points, by their places; only the places given count."""

    def __init__(self, places: np.ndarray, gaps: np.ndarray, floor: float):
        self.places, self.floor = np.unique(places), floor
        between = np.maximum.reduceat(gaps, self.places[:-1]) if len(self.places) > 1 else np.empty(0)
        if len(between):  # the last of them must not reach beyond its place
            between[-1] = gaps[self.places[-2] : self.places[-1]].max()
        self.levels = [between]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            held, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(held[:-step], held[step:]))

    def rank(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.places, places)

    def from_one(self, rank: int) -> np.ndarray:
        """The bound from one rank to every other."""
        between = self.levels[0]
        return np.maximum(np.r_[np.maximum.accumulate(between[:rank][::-1])[::-1], 0.0, np.maximum.accumulate(between[rank:])], self.floor)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.full(len(a), self.floor)
        span = high - low
        level = np.frexp(np.maximum(span, 1))[1] - 1
        for k in np.unique(level[span > 0]):
            at = np.flatnonzero((level == k) & (span > 0))
            out[at] = np.maximum(out[at], np.maximum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << k)]))
        return out


def _parties(ranks: np.ndarray, paths: _Paths, least: int = 64, most: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of a tile's points, and the bounds from one of each group to every rank.

    Points that are far from the one chosen and much nearer to each other form a group of their own, or all pairs within would pass for
    as far apart as that.
    """
    left = np.arange(len(ranks))
    for turn in range(most):
        if not len(left):
            return
        far = paths.from_one(int(np.sort(ranks[left])[len(left) // 2]))
        bound = far[ranks[left]]
        stay = np.ones(len(left), bool)
        if turn < most - 1:
            values, at, n = np.unique(bound, return_inverse=True, return_counts=True)
            for i in np.flatnonzero((n >= least) & (values > values[0])):
                party = ranks[left[at == i]]
                if np.median(paths.from_one(int(np.sort(party)[len(party) // 2]))[party]) < 0.8 * values[i]:
                    stay[at == i] = False
        yield left[stay], far
        left = left[~stay]


def _lighter_edges(left: list[Block], right: list[Block], gaps: np.ndarray, floor: float) -> pd.DataFrame | None:
    """Edges between tiles of two strips that are lighter than the path their ends have in the first tree.

    With ``far``, the heaviest edge on the path to a chosen point, the path between two others is at most the larger of both. So one end of
    such an edge has a ``far`` above its own core distance, and the other end lies within that.
    """
    twins = {a.value("tile") for a in left} == {b.value("tile") for b in right}
    blocks = left if twins else left + right
    paths = _Paths(np.concatenate([b.extra("pos", np.int64) for b in blocks]), gaps, floor)
    # by the object, since the same tile comes as another one on the other side
    rank = {id(b): paths.rank(b.extra("pos", np.int64)) for b in left + right}
    found = []

    def keep(a: Block, rows: np.ndarray, b: Block, cols: np.ndarray) -> None:
        for low in range(0, len(rows), 100_000):
            r, c = rows[low : low + 100_000], cols[low : low + 100_000]
            top = paths.between(rank[id(a)][r], rank[id(b)][c])
            w = np.maximum(np.maximum(pair_distances(a.vecs[r], b.vecs[c]), a.extra("core")[r]), b.extra("core")[c])
            use = (w < top) & (a.ids[r] != b.ids[c])
            if use.any():
                u, v = a.ids[r[use]], b.ids[c[use]]
                found.append(pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v), "w": w[use]}))

    for a in left:
        others = [b for b in right if not twins or a.value("tile") <= b.value("tile")]
        core = a.extra("core")
        floors = floors_to(a.vecs, others)
        nearest = floors.min(0)
        for party, far in _parties(rank[id(a)], paths):
            top = far[rank[id(a)][party]]
            for i, b in enumerate(others):
                b_top, b_core = far[rank[id(b)]], b.extra("core")
                # a point's edge may be as heavy as its own bound, or as that of the other end
                rows = np.flatnonzero((top > core[party]) & (floors[party, i] < top) & (b_core.min() < top))
                if len(rows):
                    r, c = near_pairs(a.vecs[party[rows]], b.vecs, top[rows] ** 2)
                    keep(a, party[rows[r]], b, c)
                cols = np.flatnonzero((b_top > b_core) & (nearest[i] < b_top) & (core[party].min() < b_top))
                if len(cols):
                    cols = cols[(floors_to(b.vecs[cols], [a]) < b_top[cols, None])[:, 0]]
                if len(cols):
                    c, r = near_pairs(b.vecs[cols], a.vecs[party], b_top[cols] ** 2)
                    keep(a, party[r], b, cols[c])
    return _forest(pd.concat(found, ignore_index=True)) if found else None


def _tree(nodes: DataFrame, near: DataFrame, tile_rows: int | None, max_cells: int | None, limit: int) -> DataFrame:
    """A minimum spanning tree of ``nodes <rep, v, core>``.

    A first tree is as light as near neighbours and the tiles' own trees make it. An edge that is no lighter than the heaviest one on its ends'
    path there is not needed, so strips of tiles meet once and return only edges that are lighter: few, and none where the first tree is minimal.
    """
    grid = cell_tiles(nodes, "rep", "v", ("core",), tile_rows, max_cells)
    edges, several = _first_tree(grid, near)
    if not several:
        return cut_lineage(minimum_forest(edges))
    first = cut_lineage(minimum_forest(edges))
    order, gaps, floor = _leaf_order(first, limit)
    placed = cut_lineage(nodes.select("rep", "v", "core").join(order, "rep"))
    tiles = cell_tiles(placed, "rep", "v", ("core", "pos"), tile_rows, max_cells).tiles
    lighter = cut_lineage(meet_strips(tiles, tiles, lambda a, b: _lighter_edges(a, b, gaps, floor), TREE, half=True))
    return cut_lineage(minimum_forest(first.unionByName(lighter))) if lighter.head(1) else first


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The minimum spanning forest of some edges, by (w, u, v)."""
    edges = edges.drop_duplicates().sort_values(["w", "u", "v"])
    sets = DisjointSets()
    return edges[[sets.union(u, v) for u, v in zip(edges["u"].tolist(), edges["v"].tolist())]]


def spanning_tree(
    points: DataFrame,
    min_samples: int = 0,
    key: str = "doc_id",
    vector: str = "reduced",
    tile_rows: int | None = None,
    max_cells: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tree <u, v, w>, nodes <rep, copies, core>, members <key, rep>)`` over distinct vectors.

    With ``min_samples`` the weight is mutual reachability, with 0 the plain distance. Copies of
    one vector hang together at weight ``core`` (0 for the plain distance).
    """
    members, distinct = collapse_copies(points, key, vector)
    members, distinct = cut_lineage(members), cut_lineage(distinct.withColumnRenamed(vector, "v"))
    near = None
    if min_samples or distinct.count() > (tile_rows or TILE_ROWS):
        grid = cell_tiles(distinct, "rep", "v", tile_rows=tile_rows, max_cells=max_cells)
        near = cut_lineage(_nearest_distinct(grid, min_samples or TREE_NEIGHBORS))
    if min_samples:
        weights = distinct.select(F.col("rep").alias("dst"), F.col("copies"))
        home = distinct.select(
            F.col("rep").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit(0.0).alias("dist"), (F.col("copies") - 1).alias("copies")
        )
        offers = near.join(weights, "dst").select("src", "dst", "dist", "copies").unionByName(home)
        seen = F.sum("copies").over(Window.partitionBy("src").orderBy("dist", "dst"))
        core = (
            offers.withColumn("_seen", seen).groupBy("src")
            .agg(F.coalesce(F.min(F.when(F.col("_seen") >= min_samples, F.col("dist"))), F.max("dist")).alias("core"))
            .withColumnRenamed("src", "rep")
        )
        nodes = cut_lineage(distinct.join(core, "rep"))
    else:
        nodes = cut_lineage(distinct.withColumn("core", F.lit(0.0)))
    if near is None or nodes.count() <= (tile_rows or TILE_ROWS):
        edges = nodes.sparkSession.createDataFrame([], TREE)
    else:
        cu, cv = (nodes.select(F.col("rep").alias(c), F.col("core").alias(f"c{c}")) for c in "uv")
        both = near.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("dist").alias("dist"))
        edges = both.join(cu, "u").join(cv, "v").select("u", "v", F.greatest("dist", "cu", "cv").alias("w"))
    tree = _tree(nodes, edges, tile_rows, max_cells, ORDER_EDGES)
    return tree, nodes.select("rep", "copies", "core"), members


def tree_weight(points: DataFrame, min_samples: int = 5, key: str = "doc_id", vector: str = "reduced") -> DataFrame:
    """One row: edges and total weight of the spanning tree over all points, copies included."""
    tree, nodes, _ = spanning_tree(points, min_samples, key, vector)
    extra = nodes.agg(
        F.sum(F.col("copies") - 1).alias("n"), F.sum((F.col("copies") - 1) * F.col("core")).alias("w")
    )
    return tree.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).unionByName(extra).agg(
        F.sum("n").alias("n_edges"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total_weight")
    )


def single_linkage(
    points: DataFrame, n_clusters: int, key: str = "doc_id", vector: str = "reduced", out: str = "topic"
) -> DataFrame:
    """``<key, out>``: cut the n_clusters - 1 heaviest spanning-tree edges; exact and distributed."""
    tree, nodes, members = spanning_tree(points, 0, key, vector)
    if n_clusters < 1 or n_clusters > nodes.count():
        raise ValueError(f"n_clusters must lie between 1 and the number of distinct vectors, got {n_clusters}")
    heaviest = tree.orderBy(F.desc("w"), F.desc("u"), F.desc("v")).limit(n_clusters - 1)
    light = tree.join(heaviest, ["u", "v"], "left_anti")
    roots = nodes.select("rep").join(
        connected_components(light).withColumnRenamed("id", "rep"), "rep", "left"
    ).select("rep", F.coalesce("root", "rep").alias("root"))
    roots = cut_lineage(roots)
    numbers = consecutive(roots.select("root").distinct(), ["root"], out)
    return members.join(roots.join(numbers, "root"), "rep").select(key, F.col(out).cast("int").alias(out))


# ---------------------------------------------------------------------------------------------
# HDBSCAN
# ---------------------------------------------------------------------------------------------


def _joining_edges(tree: DataFrame, nodes: DataFrame, size: int, limit: int) -> DataFrame:
    """``<id, at, w>``: per node the tree edge (by rank ``at``) at which, adding edges by rising
    rank, its component first holds ``size`` points. Nodes that never get there are absent; a
    node with that many copies of its own has rank -1 and its core distance as weight."""
    alone = nodes.filter(F.col("copies") >= size).select(F.col("rep").alias("id"), F.lit(-1).cast("long").alias("at"), F.col("core").alias("w"))
    if tree.count() > limit:
        return alone.unionByName(_joining_rounds(tree, nodes, size))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        sets = DisjointSets()
        weight: dict[int, int] = {}
        waiting: dict[int, list[int]] = {}
        found = []
        for u, v, cu, cv, at, w in pdf[["u", "v", "cu", "cv", "at", "w"]].itertuples(index=False):
            for x, c in ((u, cu), (v, cv)):
                if x not in weight:
                    weight[x] = c
                    waiting[x] = [x] if c < size else []
            a, b = sets.find(u), sets.find(v)
            sets.union(a, b)
            top = sets.find(a)
            mass = weight.get(a, 0) + weight.get(b, 0)
            pending = waiting.pop(a, []) + waiting.pop(b, [])
            weight[top] = mass
            if mass >= size:
                found.extend((x, at, w) for x in pending)
                pending = []
            waiting[top] = pending
        return pd.DataFrame(found, columns=["id", "at", "w"])

    cu = nodes.select(F.col("rep").alias("u"), F.col("copies").alias("cu"))
    cv = nodes.select(F.col("rep").alias("v"), F.col("copies").alias("cv"))
    joined = in_one_task(
        tree.join(cu, "u").join(cv, "v").select("u", "v", "cu", "cv", "at", "w"), finish, "id long, at long, w double"
    )
    return alone.unionByName(joined)


def _joining_rounds(tree: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The same in rounds, for trees of any size.

    Components smaller than ``size`` point along their lightest outgoing edge. Pointers lead to
    ever lighter edges, so a component settles at its own edge as soon as the components ahead
    of it (at most ``size`` steps) or a settled one complete the count. Where the pointers end
    in two components choosing each other, these merge. Each round lengthens every unsettled
    chain's head, so about ``size`` rounds suffice whatever the table holds.
    """
    comp = cut_lineage(nodes.select(F.col("rep").alias("id"), F.col("rep").alias("c")))
    state = cut_lineage(nodes.select(F.col("rep").alias("c"), F.col("copies").alias("mass"), (F.col("copies") >= size).alias("big")))
    live = cut_lineage(tree.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "at", "w"))
    found = None
    while True:
        small = state.filter("NOT big").select("c", "mass")
        both = live.unionByName(live.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "at", "w"))
        best = both.join(small, both["cu"] == small["c"], "left_semi").groupBy(F.col("cu").alias("c")).agg(
            F.min(F.struct("at", "w", F.col("cv").alias("p"))).alias("b")
        )
        best = cut_lineage(best.select("c", "b.at", "b.w", "b.p"))
        if not best.head(1):
            break
        # Mass along the pointer chain, by doubling; a settled (big) component completes it.
        ahead = state.select(F.col("c").alias("p"), F.col("mass").alias("p_mass"), F.col("big").alias("p_big"))
        back = best.select(F.col("c").alias("p"), F.col("p").alias("back"))
        chain = best.join(ahead, "p").join(back, "p", "left").join(small, "c").select(
            "c", "at", "w", "p", "mass",
            F.coalesce(F.col("back") == F.col("c"), F.lit(False)).alias("mutual"),
            F.when(F.col("p_big"), F.lit(size)).otherwise(F.lit(0)).cast("long").alias("bonus"),
        )
        chain = cut_lineage(chain)
        walk = chain.select(
            "c", (F.col("mass") + F.col("bonus")).alias("sum"),
            F.when((F.col("bonus") > 0) | (F.col("mutual") & (F.col("c") < F.col("p"))), F.lit(None)).otherwise(F.col("p")).alias("next"),
        )
        for _ in range(max(1, math.ceil(math.log2(size + 1)))):
            step = walk.select(F.col("c").alias("next"), F.col("sum").alias("next_sum"), F.col("next").alias("next_next"))
            walk = cut_lineage(
                walk.join(step, "next", "left").select(
                    "c", F.least(F.col("sum") + F.coalesce("next_sum", F.lit(0)), F.lit(2 * size)).alias("sum"), F.col("next_next").alias("next")
                )
            )
        settled = cut_lineage(
            chain.filter("NOT mutual").join(walk.filter(F.col("sum") >= size), "c", "left_semi").select("c", "at", "w")
        )
        merging = chain.filter("mutual").select(
            F.least("c", "p").alias("root"), "c", "mass", "at", "w"
        )
        merged = cut_lineage(merging.groupBy("root").agg(F.sum("mass").alias("mass"), F.min("at").alias("at"), F.min("w").alias("w")))
        parts = cut_lineage(merging.select("c", "root").join(merged.select("root", F.col("mass").alias("m"), "at", "w"), "root"))
        done = settled.unionByName(parts.filter(F.col("m") >= size).select("c", "at", "w"))
        new = cut_lineage(comp.join(done, "c").select("id", "at", "w"))
        found = new if found is None else found.unionByName(new)
        # Settled and large merged components stop; they stay as marks that others can lean on.
        into = cut_lineage(parts.select("c", F.col("root").alias("to")))
        comp = cut_lineage(
            comp.join(done.select("c"), "c", "left_anti").join(into, "c", "left").select("id", F.coalesce("to", "c").alias("c"))
        )
        grown = state.join(into, "c", "left").join(settled.select("c", F.lit(True).alias("stop")), "c", "left").select(
            F.coalesce("to", "c").alias("c"), "mass", (F.col("big") | F.coalesce("stop", F.lit(False))).alias("big")
        )
        state = cut_lineage(
            grown.groupBy("c").agg(F.sum("mass").alias("mass"), F.bool_or("big").alias("big"))
            .withColumn("big", F.col("big") | (F.col("mass") >= size))
        )
        iu = into.select(F.col("c").alias("cu"), F.col("to").alias("tu"))
        iv = into.select(F.col("c").alias("cv"), F.col("to").alias("tv"))
        live = live.join(iu, "cu", "left").join(iv, "cv", "left").select(
            F.coalesce("tu", "cu").alias("cu"), F.coalesce("tv", "cv").alias("cv"), "at", "w"
        ).filter("cu != cv")
        open_ = state.filter("NOT big").select("c")
        ends = live.join(open_, live["cu"] == open_["c"], "left_semi").unionByName(
            live.join(open_, live["cv"] == open_["c"], "left_semi")
        )
        live = cut_lineage(ends.distinct())
    if found is None:
        return tree.sparkSession.createDataFrame([], StructType.fromDDL("id long, at long, w double"))
    return found


NODE = "node long, parent long, at long, w double"


def _merge_tree(pieces: DataFrame, splits: DataFrame, limit: int) -> DataFrame:
    """``<node, parent, at, w>``: who merges into whom at which split edge.

    Leaves are piece ids, inner nodes are ``-(at + 1)``. Two pieces that choose each other by
    their lightest split edge merge first, in rounds; once few edges are left, one task ends it.
    """
    live = cut_lineage(splits.select(F.col("pu").alias("cu"), F.col("pv").alias("cv"), "at", "w"))
    made = None
    left = live.count()
    while left > limit:
        both = live.unionByName(live.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "at", "w"))
        best = both.groupBy(F.col("cu").alias("node")).agg(F.min(F.struct("at", "w")).alias("b")).select("node", "b.at", "b.w")
        agreed = best.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("at")
        now = cut_lineage(best.join(agreed, "at").select("node", (-(F.col("at") + 1)).alias("parent"), "at", "w"))
        made = now if made is None else made.unionByName(now)
        pu = now.select(F.col("node").alias("cu"), F.col("parent").alias("tu"))
        pv = now.select(F.col("node").alias("cv"), F.col("parent").alias("tv"))
        live = cut_lineage(
            live.join(pu, "cu", "left").join(pv, "cv", "left")
            .select(F.coalesce("tu", "cu").alias("cu"), F.coalesce("tv", "cv").alias("cv"), "at", "w")
            .filter("cu != cv")
        )
        left = live.count()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = DisjointSets()
        node: dict[int, int] = {}
        out = []
        for a, b, at, w in pdf.sort_values("at")[["cu", "cv", "at", "w"]].itertuples(index=False):
            ra, rb = sets.find(a), sets.find(b)
            out += [(node.get(ra, ra), -(at + 1), at, w), (node.get(rb, rb), -(at + 1), at, w)]
            sets.union(ra, rb)
            node[sets.find(ra)] = -(at + 1)
        return pd.DataFrame(out, columns=["node", "parent", "at", "w"])

    last = in_one_task(live, finish, NODE)
    return cut_lineage(last if made is None else made.unionByName(last))


def _climb(start: DataFrame, parents: DataFrame, own: DataFrame, test: str) -> DataFrame:
    """Move ``<id, node, at>`` up to the highest ancestor for which ``test`` holds (and holds for
    all below it), with doubling jumps: log2(depth) joins."""
    jumps = [cut_lineage(parents.select("node", F.col("parent").alias("up")))]
    while True:
        last = jumps[-1]
        over = last.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        longer = cut_lineage(last.join(over, "up").select("node", F.col("up2").alias("up")))
        if not longer.head(1):
            break
        jumps.append(longer)
    held = own.select(F.col("node").alias("up"), F.col("own").alias("up_own"))
    for jump in reversed(jumps):
        reach = jump.join(held, "up")
        start = start.join(reach, "node", "left").withColumn("node", F.when(F.expr(test), F.col("up")).otherwise(F.col("node"))).drop("up", "up_own")
        start = cut_lineage(start)
    return start


def _select_clusters(tree: DataFrame, method: str, limit: int) -> DataFrame:
    """``<node, chosen>``: the selected cluster each node belongs to (null for none).

    ``tree <node, parent, birth, death, fell, fell_mass>`` has one row per condensed cluster. Rows
    are settled from the leaves up and read back from the root down.
    """

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {r.node: r for r in pdf.itertuples(index=False)}
        children: dict[int, list[int]] = {}
        roots = []
        for r in rows.values():
            if np.isnan(r.parent_):
                roots.append(r.node)
            else:
                children.setdefault(int(r.parent_), []).append(r.node)
        order, stack = [], list(roots)
        while stack:
            x = stack.pop()
            order.append(x)
            stack.extend(children.get(x, []))
        size, value, taken = {}, {}, {}
        for x in reversed(order):
            r, kids = rows[x], children.get(x, [])
            below = sum(size[c] for c in kids)
            size[x] = r.fell + below
            stability = r.fell_mass - r.fell * r.birth + below * ((r.death if kids else r.birth) - r.birth)
            held = sum(value[c] for c in kids)
            root = np.isnan(r.parent_)
            take = not root and (not kids if method == "leaf" else stability >= held)
            taken[x] = take
            value[x] = stability if take else held
        chosen: dict[int, int | None] = {}
        for x in order:
            above = None if np.isnan(rows[x].parent_) else chosen[int(rows[x].parent_)]
            chosen[x] = above if above is not None else (x if taken[x] else None)
        return pd.DataFrame({"node": list(chosen), "chosen": pd.array(list(chosen.values()), dtype="Int64")})

    if tree.count() <= limit:
        bare = tree.select("node", F.col("parent").cast("double").alias("parent_"), "birth", "death", "fell", "fell_mass")
        return in_one_task(bare, finish, "node long, chosen long")
    return _select_rounds(tree, method)


def _select_rounds(tree: DataFrame, method: str) -> DataFrame:
    """The same by levels, for trees of any size."""
    waiting = cut_lineage(tree)
    known = None
    while True:
        kids = waiting.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
        ready = waiting.join(kids, "node", "left_anti")
        if known is not None:
            below = known.groupBy(F.col("parent").alias("node")).agg(
                F.sum("size").alias("below"), F.sum("value").alias("held"), F.count(F.lit(1)).alias("kids")
            )
            ready = ready.join(below, "node", "left")
        else:
            ready = ready.withColumns({"below": F.lit(None).cast("double"), "held": F.lit(None).cast("double"), "kids": F.lit(None).cast("long")})
        ready = ready.na.fill(0, ["below", "held", "kids"])
        gain = F.when(F.col("kids") > 0, F.col("below") * (F.col("death") - F.col("birth"))).otherwise(0.0)
        stability = F.col("fell_mass") - F.col("fell") * F.col("birth") + gain
        rule = F.col("kids") == 0 if method == "leaf" else F.col("stability") >= F.col("held")
        fresh = cut_lineage(
            ready.withColumn("stability", stability)
            .withColumn("take", F.col("parent").isNotNull() & rule)
            .select(
                "node", "parent", (F.col("fell") + F.col("below")).alias("size"),
                F.when(F.col("take"), F.col("stability")).otherwise(F.col("held")).alias("value"), "take",
            )
        )
        if not fresh.head(1):
            break
        known = fresh if known is None else known.unionByName(fresh)
        known = cut_lineage(known)
        waiting = cut_lineage(waiting.join(fresh.select("node"), "node", "left_anti"))
    # Highest taken ancestor: top-down by doubling over (ancestor, best so far).
    state = known.select(
        "node", F.col("parent").alias("up"), F.when(F.col("take"), F.struct(F.lit(0).alias("far"), F.col("node").alias("pick"))).alias("best")
    )
    state = cut_lineage(state)
    span = 1
    while state.filter(F.col("up").isNotNull()).head(1):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("best").alias("best2"))
        further = F.when(
            F.col("best2").isNotNull(), F.struct((F.col("best2.far") + F.lit(span)).alias("far"), F.col("best2.pick").alias("pick"))
        )
        state = cut_lineage(
            state.join(above, "up", "left").select("node", F.col("up2").alias("up"), F.coalesce(further, F.col("best")).alias("best"))
        )
        span *= 2
    return state.select("node", F.col("best.pick").alias("chosen"))


def hdbscan(
    points: DataFrame,
    min_cluster_size: int = 10,
    min_samples: int = 5,
    key: str = "doc_id",
    vector: str = "reduced",
    out: str = "topic",
    selection: str = "eom",
    tile_rows: int | None = None,
    max_cells: int | None = None,
    local_limit: int | None = None,
    metric: str = "euclidean",
    cluster_selection_method: str | None = None,
) -> DataFrame:
    """``<key, out>``: HDBSCAN labels, numbered by smallest key; noise is -1.

    Tree edges get a rank by (w, u, v). An edge splits a cluster exactly when both its sides
    reached ``min_cluster_size`` at lower ranks; removing the splitting edges leaves one
    piece per leaf cluster, and merging the pieces by rank gives the condensed tree. A point
    leaves its cluster at the rank where its component first reached ``min_cluster_size``.
    """
    selection = cluster_selection_method or selection  # two names of one setting
    if selection not in ("eom", "leaf"):
        raise ValueError(f"no selection named {selection!r}; there are eom and leaf")
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    limit = graph.LOCAL_EDGES if local_limit is None else local_limit
    raw, nodes, members = spanning_tree(_measured(points, vector, metric), min_samples, key, vector, tile_rows, max_cells)
    if metric == "cosine":
        raw, nodes = raw.withColumn("w", F.col("w") * F.col("w") / 2), nodes.withColumn("core", F.col("core") * F.col("core") / 2)
    tree = cut_lineage(consecutive(raw, ["w", "u", "v"], "at"))
    joins = cut_lineage(_joining_edges(tree, nodes, min_cluster_size, limit))
    ju = joins.select(F.col("id").alias("u"), F.col("at").alias("ju"))
    jv = joins.select(F.col("id").alias("v"), F.col("at").alias("jv"))
    marked = cut_lineage(
        tree.join(ju, "u", "left").join(jv, "v", "left").withColumn(
            "split", F.coalesce((F.col("at") > F.col("ju")) & (F.col("at") > F.col("jv")), F.lit(False))
        ).select("u", "v", "at", "w", "split")
    )
    pieces = nodes.select(F.col("rep").alias("id")).join(
        connected_components(marked.filter("NOT split"), limit), "id", "left"
    ).select("id", F.coalesce("root", "id").alias("piece"))
    pieces = cut_lineage(pieces)
    pu = pieces.select(F.col("id").alias("u"), F.col("piece").alias("pu"))
    pv = pieces.select(F.col("id").alias("v"), F.col("piece").alias("pv"))
    splits = marked.filter("split").join(pu, "u").join(pv, "v").select("pu", "pv", "at", "w")
    merges = _merge_tree(pieces, splits, limit)

    def density(w):
        return F.lit(1.0) / F.greatest(w, F.lit(1e-12))

    split_own = merges.select(F.col("parent").alias("node"), F.col("at").alias("own"), F.col("w").alias("own_w")).distinct()
    fallen = joins.join(pieces, "id").join(nodes.withColumnRenamed("rep", "id"), "id").select(
        "id", F.col("piece").alias("node"), "at", density(F.col("w")).alias("lam"), "copies"
    )
    fallen = _climb(fallen, merges, split_own, "at > up_own")
    sums = fallen.groupBy("node").agg(
        F.sum("copies").cast("double").alias("fell"), F.sum(F.col("copies") * F.col("lam")).alias("fell_mass")
    )
    every = pieces.select(F.col("piece").alias("node")).unionByName(split_own.select("node")).distinct()
    condensed = cut_lineage(
        every.join(merges.select("node", "parent", density(F.col("w")).alias("birth")), "node", "left")
        .join(split_own.select("node", density(F.col("own_w")).alias("death")), "node", "left")
        .join(sums, "node", "left")
        .na.fill(0.0, ["birth", "fell", "fell_mass", "death"])
    )
    picked = _select_clusters(condensed, selection, limit)
    labelled = fallen.join(picked, "node").filter(F.col("chosen").isNotNull()).select(F.col("id").alias("rep"), "chosen")
    labelled = cut_lineage(labelled)
    order = labelled.groupBy("chosen").agg(F.min("rep").alias("_first"))
    numbers = consecutive(order, ["_first"], out).select("chosen", out)
    final = labelled.join(numbers, "chosen").select("rep", out)
    return members.join(final, "rep", "left").select(key, F.coalesce(F.col(out), F.lit(-1)).cast("int").alias(out))
