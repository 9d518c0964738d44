"""Ward's tree by contraction: all pairs of mutually nearest clusters merge at once, round by round.

A merge under Ward's criterion never brings the new cluster nearer to a third one than its nearer part was, so pairs that are
each other's nearest merge in any order, and a cluster whose nearest neighbour did not merge keeps it. Each round
searches only for clusters that are new or have lost their nearest one. When no more than ``LOCAL_CLUSTERS`` are left, one
task goes on to the root. The tree is that of plain Ward; labels follow from its lowest merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from themeloom.operators.graph import connected_components, consecutive, in_one_task
from themeloom.operators.tiles import Block, block_squares, cell_tiles, collapse_copies, gaps_to, meet_strips, pair_distances
from themeloom.session import cut_lineage

#: Clusters that one task merges to the end, at most.
LOCAL_CLUSTERS = 2000
#: Tasks that search inside the tiles, at most.
SEARCH_TASKS = 256

NEAREST = "id long, other long, growth double"
MERGES = "round int, place long, a long, b long, height double"


def ward_merges(ids: np.ndarray, centers: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges ``(kept id, merged id, growth)`` of weighted centres in order, to the root; ties by the smallest ids."""
    order = np.argsort(ids)
    ids, centers, sizes = ids[order], centers[order].astype(float).copy(), sizes[order].astype(float).copy()
    m = len(ids)
    squares = block_squares(centers, centers)[0]
    growth = squares * (sizes[:, None] * sizes[None, :]) / (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(growth, np.inf)
    alive = np.ones(m, bool)
    near = growth.argmin(axis=1)
    least = growth[np.arange(m), near]
    out = []
    for _ in range(m - 1):
        i = int(np.where(alive, least, np.inf).argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        joint = sizes[i] + sizes[j]
        apart = ((centers[i] - centers[j]) ** 2).sum()
        out.append((int(ids[i]), int(ids[j]), float(apart * sizes[i] * sizes[j] / joint)))
        centers[i] = (centers[i] * sizes[i] + centers[j] * sizes[j]) / joint
        sizes[i], alive[j] = joint, False
        growth[j, :] = growth[:, j] = np.inf
        row = ((centers - centers[i]) ** 2).sum(1) * sizes * joint / (sizes + joint)
        row[~alive] = row[i] = np.inf
        growth[i, :] = growth[:, i] = row
        stale = alive & ((near == i) | (near == j))
        stale[i] = True
        near[stale] = growth[stale].argmin(axis=1)
        closer = alive & ((row < least) | ((row == least) & (i < near)))
        near[closer & ~stale] = i
        least = growth[np.arange(m), near]
    return out


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, None] * b[None, :] / (a[:, None] + b[None, :])


def _nearest_rows(ids: np.ndarray, vecs: np.ndarray, size: np.ndarray, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, other, growth``: the nearest cluster of ``b`` for each row that has one, ties by the smallest pair of ids."""
    squares, slack = block_squares(vecs, b.vecs)
    joint = _joint(size, b.extra("size"))
    growth = squares * joint
    growth[ids[:, None] == b.ids[None, :]] = np.inf
    edge = growth.min(axis=1)
    # all that rounding may have put behind the edge stay until the exact distance decides
    rows, cols = np.nonzero((growth <= edge[:, None] + 2 * slack * joint.max()) & np.isfinite(growth))
    if not len(rows):
        return rows, np.empty(0, np.int64), np.empty(0)
    exact = ((vecs[rows] - b.vecs[cols]) ** 2).sum(1) * joint[rows, cols]
    order = np.lexsort((np.maximum(ids[rows], b.ids[cols]), np.minimum(ids[rows], b.ids[cols]), exact, rows))
    first = order[np.r_[True, np.diff(rows[order]) > 0]]
    return rows[first], b.ids[cols[first]], exact[first]


def _bounded(tiles: DataFrame) -> DataFrame:
    """Tiles with ``light``, their least size, ``searching``, how many of their clusters search, and of each cluster that does
    ``near`` and ``other``: the nearest one inside the tile (infinite and -1 if there is none)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"light": [], "searching": [], "near": [], "other": []}
            for row in batch.to_dict("records"):
                a = Block({f"a_{c}": v for c, v in row.items()}, "a")
                at = np.flatnonzero(a.extra("search") > 0)
                near, other = np.full(len(a.ids), np.inf), np.full(len(a.ids), -1, np.int64)
                if len(at):
                    rows, ids, growth = _nearest_rows(a.ids[at], a.vecs[at], a.extra("size")[at], a)
                    near[at[rows]], other[at[rows]] = growth, ids
                for name, value in (("light", float(a.extra("size").min())), ("searching", len(at)), ("near", near.tobytes()), ("other", other.tobytes())):
                    out[name].append(value)
            yield batch.assign(**out)

    added = StructType.fromDDL("light double, searching long, near binary, other binary")
    # small tables of tiles lie in a file or two
    dealt = tiles.repartition(max(1, min(SEARCH_TASKS, tiles.count())), "tile")
    return cut_lineage(dealt.mapInPandas(work, StructType(tiles.schema.fields + added.fields)))


def _nearest_in_strips(left: list[Block], right: list[Block]) -> pd.DataFrame | None:
    """The nearest cluster among the right tiles for each searching one of the left tiles, as far as it is nearer than the one in
    its own tile; with its own tile among the right ones, for all that have one.

    A cluster meets the tiles only that can offer a lesser growth, which is at least the square of its gap to the
    tile times its joint weight with the lightest cluster there.
    """
    out = []
    lights = np.array([b.value("light") for b in right])
    for a in left:
        at = np.flatnonzero(a.extra("search") > 0)
        ids, vecs, size = a.ids[at], a.vecs[at], a.extra("size")[at]
        near, other = a.extra("near")[at].copy(), a.extra("other", np.int64)[at].copy()
        changed = np.full(len(at), any(b.value("tile") == a.value("tile") for b in right))
        gap = gaps_to(a, right)
        for i in np.argsort(gap, kind="stable"):
            b = right[i]
            if b.value("tile") == a.value("tile"):
                continue
            least = _joint(size, lights[i : i + 1])[:, 0]
            rows = np.flatnonzero(max(gap[i], 0.0) ** 2 * least <= near * (1 + 1e-9))
            if not len(rows):
                continue
            apart = pair_distances(vecs[rows], np.asarray(b.value("center"), dtype=np.float64)[None, :])
            own = np.maximum(apart - b.value("radius") - 1e-9 * (1.0 + apart + b.value("radius")), 0.0)
            rows = rows[own**2 * least[rows] <= near[rows] * (1 + 1e-9)]
            if not len(rows):
                continue
            found, there, growth = _nearest_rows(ids[rows], vecs[rows], size[rows], b)
            rows = rows[found]
            low, high = np.minimum(ids[rows], there), np.maximum(ids[rows], there)
            held_low, held_high = np.minimum(ids[rows], other[rows]), np.maximum(ids[rows], other[rows])
            earlier = (low < held_low) | ((low == held_low) & (high < held_high))
            better = (growth < near[rows]) | ((growth == near[rows]) & earlier)
            rows = rows[better]
            near[rows], other[rows], changed[rows] = growth[better], there[better], True
        changed &= np.isfinite(near)
        out.append(pd.DataFrame({"id": ids[changed], "other": other[changed], "growth": near[changed]}))
    return pd.concat(out, ignore_index=True) if out else None


def nearest_clusters(clusters: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """``<id, other, growth>`` for the rows of ``clusters <id, center, size, search>`` with ``search > 0``.

    Clusters are packed into tiles; a search inside each tile bounds what other tiles can still offer each of its clusters. Then
    strips of tiles meet, and a cluster is compared with those tiles only that its bound does not rule out.
    """
    tiles = _bounded(cell_tiles(clusters, "id", "center", ("size", "search"), tile_rows=tile_rows).tiles)
    found = meet_strips(tiles.filter("searching > 0"), tiles, _nearest_in_strips, NEAREST)
    best = F.min(F.struct("growth", F.least("id", "other").alias("low"), F.greatest("id", "other").alias("high")))
    found = found.groupBy("id").agg(best.alias("b"))
    other = F.when(F.col("b.low") == F.col("id"), F.col("b.high")).otherwise(F.col("b.low"))
    return found.select("id", other.alias("other"), F.col("b.growth").alias("growth"))


def _joined(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """``clusters`` after the merges of ``pairs <a, b>``: the new centre is the weighted mean, under the smaller id."""
    home = clusters.join(pairs.select(F.col("b").alias("id"), "a"), "id", "left").withColumn("id", F.coalesce("a", "id"))
    # two rows a group at most
    parts = home.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("size", "center"))).alias("p"), F.sum("size").alias("size"))
    first, second = F.col("p")[0], F.get("p", F.lit(1))
    mean = F.zip_with(first["center"], second["center"], lambda x, y: (x * first["size"] + y * second["size"]) / F.col("size"))
    return parts.select("id", F.when(F.size("p") == 1, first["center"]).otherwise(mean).alias("center"), "size")


def ward_tree(distinct: DataFrame, vector: str = "reduced", local: int | None = None, tile_rows: int | None = None) -> DataFrame:
    """``<round, place, a, b, height>`` for every merge of the points ``<rep, vector, copies>``: ``b`` joins ``a``, the smaller id.

    ``height`` is the growth of the squared error. Ordered by height, round and place, no merge stands before one it builds on.
    """
    local = LOCAL_CLUSTERS if local is None else local
    clusters = cut_lineage(distinct.select(F.col("rep").alias("id"), F.col(vector).alias("center"), F.col("copies").cast("double").alias("size")))
    nearest, merges, round_ = None, [], 0
    left = clusters.count()
    while left > max(1, local):
        searching = clusters.withColumn("search", F.lit(1.0))
        if nearest is not None:
            searching = clusters.join(nearest.select("id", F.lit(0.0).alias("search")), "id", "left").withColumn("search", F.coalesce("search", F.lit(1.0)))
        found = nearest_clusters(cut_lineage(searching), tile_rows)
        nearest = cut_lineage(found if nearest is None else nearest.unionByName(found))
        back = nearest.select(F.col("id").alias("other"), F.col("other").alias("back"))
        pairs = nearest.join(back, "other").filter("back = id AND id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), "growth")
        pairs = cut_lineage(pairs)
        merges.append(pairs.select(F.lit(round_).alias("round"), F.col("a").alias("place"), "a", "b", F.col("growth").alias("height")))
        clusters = cut_lineage(_joined(clusters, pairs))
        gone = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        nearest = cut_lineage(nearest.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other", "growth"))
        left = clusters.count()
        round_ += 1

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        done = ward_merges(pdf["id"].to_numpy(), np.stack(pdf["center"].to_numpy()), pdf["size"].to_numpy())
        return pd.DataFrame([(round_, i, *m) for i, m in enumerate(done)], columns=["round", "place", "a", "b", "height"])

    out = in_one_task(clusters, finish, MERGES)
    for part in merges:
        out = out.unionByName(part.select(F.col("round").cast("int").alias("round"), "place", "a", "b", "height"))
    return cut_lineage(out)


def ward_labels(
    points: DataFrame, n_clusters: int, key: str = "doc_id", vector: str = "reduced", out: str = "topic", local: int | None = None, tile_rows: int | None = None
) -> DataFrame:
    """``<key, out>``: the clusters that Ward's tree leaves at ``n_clusters``, numbered by their smallest key."""
    members, distinct = collapse_copies(points, key, vector)
    members, distinct = cut_lineage(members), cut_lineage(distinct)
    total = distinct.count()
    if n_clusters < 1 or n_clusters > total:
        raise ValueError(f"n_clusters must lie between 1 and the number of distinct vectors, got {n_clusters}")
    tree = ward_tree(distinct, vector, local, tile_rows)
    lowest = consecutive(tree, ["height", "round", "place"], "rank").filter(F.col("rank") < total - n_clusters)
    edges = lowest.select(F.col("a").alias("u"), F.col("b").alias("v"))
    alone = distinct.select(F.col("rep").alias("u"), F.col("rep").alias("v"))
    homes = cut_lineage(connected_components(edges.unionByName(alone)))
    numbers = consecutive(homes.select("root").distinct(), ["root"], out).select("root", F.col(out).cast("int").alias(out))
    labels = homes.join(numbers, "root").select(F.col("id").alias("rep"), out)
    return members.join(labels, "rep").select(key, out)
