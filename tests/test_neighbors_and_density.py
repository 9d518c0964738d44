import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from themeloom.operators import centroid, density, graph, metrics, neighbors, tiles
from themeloom.operators.graph import DisjointSets


def table(spark, vecs, ids=None):
    ids = range(len(vecs)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vecs)], "doc_id long, reduced array<double>")


def blobs(seed, sizes, width=2, spread=0.15, noise=15, gap=2.0):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n, width)) * spread + rng.normal(size=width) * gap for n in sizes]
    parts.append(rng.uniform(-4, 4, size=(noise, width)))
    return np.concatenate(parts)


def pairwise(v):
    return np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(-1))


def cores(d, k):
    return np.sort(d + np.diag(np.full(len(d), -1.0)), axis=1)[:, k]


def spanning(d, core):
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    edges = sorted((w[i, j], i, j) for i in range(len(d)) for j in range(i + 1, len(d)))
    sets = DisjointSets()
    return [(u, v, x) for x, u, v in edges if sets.union(u, v)]


def plain_dbscan(d, eps, least):
    near = d <= eps
    core = near.sum(1) >= least
    labels = np.full(len(d), -1)
    at = 0
    for i in range(len(d)):
        if core[i] and labels[i] < 0:
            stack = [i]
            labels[i] = at
            while stack:
                x = stack.pop()
                if core[x]:
                    for y in np.flatnonzero(near[x]):
                        if labels[y] < 0:
                            labels[y] = at
                            stack.append(y)
            at += 1
    return labels


def plain_hdbscan(v, least, k, leaf=False):
    """Textbook: full dendrogram, condensed tree, excess of mass."""
    d = pairwise(v)
    tree = spanning(d, cores(d, k))
    n = len(v)
    sets, node, size, kids, lam = DisjointSets(), {}, {i: 1 for i in range(n)}, {}, {}
    for at, (a, b, w) in enumerate(tree):
        ra, rb = sets.find(a), sets.find(b)
        na, nb = node.get(ra, ra), node.get(rb, rb)
        new = n + at
        kids[new], lam[new], size[new] = (na, nb), 1 / w, size[na] + size[nb]
        sets.union(ra, rb)
        node[sets.find(ra)] = new

    def leaves(x):
        out, stack = [], [x]
        while stack:
            y = stack.pop()
            stack.extend(kids[y]) if y in kids else out.append(y)
        return out

    clusters, point_home = {}, {}
    work = [(n + len(tree) - 1, None, 0.0)]
    while work:
        top, parent, birth = work.pop()
        name = len(clusters)
        clusters[name] = {"parent": parent, "birth": birth, "stab": 0.0, "kids": []}
        if parent is not None:
            clusters[parent]["kids"].append(name)
        x = top
        while True:
            if x not in kids:
                break
            a, b = kids[x]
            big = [y for y in (a, b) if size[y] >= least]
            if len(big) == 2:
                clusters[name]["stab"] += size[x] * (lam[x] - birth)
                work += [(a, name, lam[x]), (b, name, lam[x])]
                break
            for y in (a, b):
                if y not in big:
                    for p in leaves(y):
                        clusters[name]["stab"] += lam[x] - birth
                        point_home[p] = name
            if not big:
                break
            x = big[0]
    value, taken = {}, set()
    for name in sorted(clusters, reverse=True):
        c = clusters[name]
        below = sum(value[k] for k in c["kids"])
        if c["parent"] is not None and (not c["kids"] if leaf else c["stab"] >= below):
            taken.add(name)
            value[name] = c["stab"]
        else:
            value[name] = below

    def owner(name):
        best = None
        while name is not None:
            if name in taken:
                best = name
            name = clusters[name]["parent"]
        return best

    owners = [owner(point_home[i]) if i in point_home else None for i in range(n)]
    number = {}
    return [-1 if o is None else number.setdefault(o, len(number)) for o in owners]


def labels(df):
    return [r[1] for r in sorted(tuple(r) for r in df.collect())]


@pytest.mark.parametrize("metric,width", [("euclidean", 2), ("cosine", 12)])
def test_knn_graph_matches_brute_force(spark, metric, width):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, width))
    v = np.concatenate([v, np.repeat(v[:1], 40, axis=0)])  # one vector holds a third of all rows
    got = {}
    for r in neighbors.knn_graph(table(spark, v), 6, vector="reduced", metric=metric, tile_rows=16, max_cells=5).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    base = v / np.linalg.norm(v, axis=1)[:, None] if metric == "cosine" else v
    d = pairwise(base)
    for i in range(len(v)):
        dist = np.where(np.all(base == base[i], axis=1), 0.0, d[i])
        order = sorted((x, j) for j, x in enumerate(dist) if j != i)[:6]
        mine = sorted(got[i])
        assert [m[1] for m in mine] == [j for _, j in order]
        want = [x * x / 2 if metric == "cosine" else x for x, _ in order]
        assert np.allclose([m[2] for m in mine], want, atol=1e-9)


def test_dbscan_matches_plain_version(spark):
    v = np.concatenate([blobs(3, [60, 40, 30], spread=0.1), np.zeros((70, 2)) + 0.5])
    want = plain_dbscan(pairwise(v), 0.2, 5).tolist()
    assert labels(density.dbscan(table(spark, v), 0.2, 5, tile_rows=12)) == want
    assert max(want) > 1 and -1 in want


def test_dbscan_in_five_dimensions(spark):
    v = blobs(8, [40, 40], width=5, spread=0.15)
    want = plain_dbscan(pairwise(v), 0.5, 6).tolist()
    assert labels(density.dbscan(table(spark, v), 0.5, 6, tile_rows=16)) == want


def test_spanning_tree_in_tiles(spark):
    v = blobs(1, [50, 50, 40], noise=20)
    d = pairwise(v)
    tree, nodes, _ = density.spanning_tree(table(spark, v), 4, tile_rows=20, max_cells=6)
    want = spanning(d, cores(d, 4))
    got = tree.collect()
    assert len(got) == len(v) - 1
    assert sum(r["w"] for r in got) == pytest.approx(sum(w for _, _, w in want))


@pytest.mark.parametrize("limit,selection", [(None, "eom"), (0, "eom"), (None, "leaf"), (0, "leaf")])
def test_hdbscan_matches_textbook(spark, limit, selection):
    v = blobs(11, [40, 30, 25, 20], spread=0.2, noise=25)
    want = plain_hdbscan(v, 8, 4, selection == "leaf")
    got = labels(density.hdbscan(table(spark, v), 8, 4, selection=selection, local_limit=limit))
    assert got == want and len(set(want)) > 2


def test_hdbscan_with_copies_and_few_points(spark):
    v = np.concatenate([blobs(2, [30, 30], noise=0, gap=5.0), np.full((40, 2), 20.0)])
    got = labels(density.hdbscan(table(spark, v), 10, 4))
    assert len({tuple(got[a:b]) for a, b in ((0, 30), (30, 60), (60, 100))}) == 3
    assert set(got[60:]) == {got[60]} and got[60] >= 0
    assert labels(density.hdbscan(table(spark, v[:5]), 10, 3)) == [-1] * 5


def test_components_and_forest_in_rounds(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 80, 90), rng.integers(0, 80, 90), rng.integers(0, 30, 90))]
    df = spark.createDataFrame(pairs, "u long, v long, w double")
    sets = DisjointSets()
    for a, b, _ in pairs:
        sets.union(a, b)
    want = {x: sets.find(x) for x in list(sets.parent)}
    for limit in (0, 10**6):
        assert dict(tuple(r) for r in graph.connected_components(df, limit).collect()) == want
        tree = graph.minimum_forest(df, limit).collect()
        check, total = DisjointSets(), 0.0
        for a, b, w in sorted(pairs, key=lambda p: p[2]):
            total += w if check.union(a, b) else 0
        assert len(tree) == len(want) - len(set(want.values()))
        assert sum(r["w"] for r in tree) == pytest.approx(total)


def test_consecutive_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "x long")
    assert sorted(tuple(r) for r in graph.consecutive(df, ["x"], "i").collect()) == [(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)]


def test_single_linkage_and_ward(spark):
    v = np.array([[0, 0], [0, 1], [10, 0], [10, 1.5], [30, 0], [30, 2], [30, 2]])
    assert labels(density.single_linkage(table(spark, v), 3)) == [0, 0, 1, 1, 2, 2, 2]
    assert labels(centroid.ward(table(spark, v), 3)) == [0, 0, 1, 1, 2, 2, 2]
    condensed = labels(centroid.ward(table(spark, v), 3, micro=4))
    assert len(set(condensed)) == 3
    with pytest.raises(ValueError):
        centroid.ward(table(spark, v))
    with pytest.raises(ValueError):
        density.single_linkage(table(spark, v), 7)


def plain_ward(v, k):
    groups = [[i] for i in range(len(v))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                x, y = v[groups[a]], v[groups[b]]
                g = len(x) * len(y) / (len(x) + len(y)) * ((x.mean(0) - y.mean(0)) ** 2).sum()
                if best is None or g < best[0]:
                    best = (g, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 6))
def test_ward_merges_like_plain_ward(seed, k):
    v = np.random.default_rng(seed).normal(size=(24, 3))
    home = centroid._ward(v, np.ones(24), k)
    assert {frozenset(np.flatnonzero(home == h).tolist()) for h in set(home)} == plain_ward(v, k)


def test_kmeans_and_dispatch(spark):
    v = np.concatenate([np.random.default_rng(0).normal(size=(20, 2)), np.random.default_rng(1).normal(size=(20, 2)) + 9])
    got, cost = centroid.kmeans(table(spark, v), 2, restarts=3)
    want = sum(((p - p.mean(0)) ** 2).sum() for p in (v[:20], v[20:]))
    assert len(set(labels(got)[:20])) == 1 and cost == pytest.approx(want)
    with pytest.raises(ValueError):
        centroid.cluster_vectors(table(spark, v), "kmeans")
    with pytest.raises(ValueError):
        centroid.cluster_vectors(table(spark, v), "other")


def test_neighbours_and_dbscan_far_from_the_origin(spark):
    """Rounding of large squares must not decide: wide vectors shifted by a million."""
    v = np.random.default_rng(8).normal(size=(300, 16)) + 1e6
    d = pairwise(v)
    want = {(i, int(j)) for i in range(len(v)) for j in np.argsort(np.where(np.arange(len(v)) == i, np.inf, d[i]), kind="stable")[:4]}
    got = neighbors.knn_graph(table(spark, v), 4, vector="reduced", tile_rows=64)
    assert {(r.src, r.dst) for r in got.collect()} == want
    eps = float(np.sort(d, axis=1)[:, 4].mean())
    assert labels(density.dbscan(table(spark, v), eps, 4, tile_rows=64)) == list(plain_dbscan(d, eps, 4))


def test_cosine_metric_and_setting_names(spark):
    v = np.random.default_rng(9).normal(size=(150, 6))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    got = labels(density.dbscan(table(spark, v), 0.2, 4, metric="cosine"))
    assert got == list(plain_dbscan(pairwise(u), np.sqrt(0.4), 4))
    with pytest.raises(ValueError):
        density.dbscan(table(spark, v), 0.2, 4, metric="other")
    with pytest.raises(ValueError):
        density.hdbscan(table(spark, v), cluster_selection_method="other")


def test_core_distance_of_few_points(spark):
    graph_ = neighbors.knn_graph(table(spark, np.array([[0.0], [1.0], [3.0]])), 5, vector="reduced")
    got = {r.id: r.core for r in neighbors.core_distances(graph_, 5).collect()}
    assert got == {0: 3.0, 1: 2.0, 2: 3.0}


def test_ward_is_one_way_at_every_size(spark):
    """More vectors than centres: the groups of well separated points are found all the same."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(60, 2)) * 0.1 + c for c in ([0, 0], [9, 0], [0, 9])])
    got = labels(centroid.ward(table(spark, v), 3, micro=12))
    assert len(got) == len(v)
    assert [len({got[i] for i in range(s, s + 60)}) for s in (0, 60, 120)] == [1, 1, 1]
    assert len(set(got)) == 3
    with pytest.raises(ValueError):
        centroid.ward(table(spark, v), 3, micro=2)


# ---- strips of tiles -------------------------------------------------------------------------


@pytest.fixture
def small_strips(monkeypatch):
    monkeypatch.setattr(tiles, "STRIP_ROWS", 16)
    monkeypatch.setattr(tiles, "STRIPS", 3)


def test_strips_meet_once_and_move_a_fixed_number_of_times(spark, small_strips):
    v = np.random.default_rng(3).normal(size=(150, 6))
    grid = tiles.cell_tiles(table(spark, v), "doc_id", "reduced", tile_rows=5)

    def count(left, right):
        pairs = [(a.value("tile"), b.value("tile")) for a in left for b in right]
        return pd.DataFrame({"pairs": [len(set(pairs))], "moved": [len(left) + len(right)]})

    n = grid.tiles.count()
    whole = tiles.meet_strips(grid.tiles, grid.tiles, count, "pairs long, moved long").groupBy().sum().first()
    assert n > 20 and whole[0] == n * n and whole[1] == 2 * 3 * n
    half = tiles.meet_strips(grid.tiles, grid.tiles, count, "pairs long, moved long", half=True).groupBy().sum().first()
    assert n * n / 2 <= half[0] < n * n


def test_neighbours_over_strips(spark, small_strips):
    v = np.round(10 * blobs(8, (40, 50), 3))  # whole numbers: equal distances, copies
    got = neighbors.knn_graph(table(spark, v), 4, vector="reduced", tile_rows=6).collect()
    d = pairwise(v)
    want = {(i, j) for i in range(len(v)) for j in sorted((x for x in range(len(v)) if x != i), key=lambda x: (round(d[i, x], 9), x))[:4]}
    assert {(r.src, r.dst) for r in got} == want


def test_dbscan_over_strips(spark, small_strips):
    v = blobs(9, (40, 30, 25), 5, spread=0.4)
    found = density.dbscan(table(spark, v), 1.1, 4, tile_rows=6)
    assert [r.topic for r in found.orderBy("doc_id").collect()] == plain_dbscan(pairwise(v), 1.1, 4).tolist()


def test_silhouette_over_strips(spark, small_strips):
    v = blobs(10, (30, 40, 20), 4, noise=0)
    t = np.repeat([0, 1, 2], (30, 40, 20))
    rows = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, t))], "doc_id long, reduced array<double>, topic int")
    d, sizes = pairwise(v), np.bincount(t)
    means = np.stack([d[:, t == c].sum(1) / (sizes[c] - (t == c)) for c in range(3)], axis=1)
    own = means[np.arange(len(v)), t]
    means[np.arange(len(v)), t] = np.inf
    far = means.min(axis=1)
    got = metrics.silhouette(rows, tile_rows=4).first()[0]
    assert got == pytest.approx(np.mean((far - own) / np.maximum(far, own)), abs=1e-9)


def test_spanning_tree_over_strips(spark, small_strips):
    v = blobs(11, (40, 50), 3)
    tree = density.spanning_tree(table(spark, v), 3, tile_rows=6)[0].collect()
    want = spanning(pairwise(v), cores(pairwise(v), 3))
    assert len(tree) == len(v) - 1 and sum(r.w for r in tree) == pytest.approx(sum(w for _, _, w in want))


def test_neighbours_reach_the_ranking_once_a_strip(spark):
    """However many tiles there are, a strip returns at most k neighbours a point, which bounds what a task of the ranking holds."""
    v = blobs(8, [150, 150], noise=0)
    distinct = table(spark, v).withColumnRenamed("doc_id", "rep")
    grid = tiles.cell_tiles(distinct, "rep", "reduced", tile_rows=15)
    assert grid.tiles.count() >= 20
    held = neighbors._bounded(grid.tiles, 5)
    found = tiles.meet_strips(held, grid.tiles, lambda a, b: neighbors._nearest_in_strips(a, b, 5), neighbors.EDGES)
    assert found.count() <= tiles._strips(grid.tiles) * 5 * len(v)
    near = {(r.src, r.dst) for r in neighbors._nearest_distinct(grid, 5).collect()}
    d = pairwise(v) + np.diag(np.full(len(v), np.inf))
    assert near == {(i, int(j)) for i in range(len(v)) for j in np.argsort(d[i])[:5]}


def test_near_pairs_at_any_scale():
    rng = np.random.default_rng(6)
    for width, scale, apart in ((3, 1.0, 0.0), (64, 1.0, 0.0), (3, 1e-6, 1e3), (64, 1e-25, 0.0)):
        a, b = (rng.random((700, width)) * scale + apart for _ in range(2))
        squares = ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)
        edge = np.quantile(squares, 0.01, axis=1)
        rows, cols = tiles.near_pairs(a, b, edge)
        hit = np.zeros(squares.shape, bool)
        hit[rows, cols] = True
        assert hit[squares <= edge[:, None]].all() and hit.mean() < 0.05


@pytest.mark.parametrize("limit", [1 << 20, 15])
def test_tree_from_a_first_one(spark, small_strips, limit):
    """Strips return only edges that are lighter than the first tree's path, also where its lighter edges were contracted, and none
    where it is minimal."""
    v = blobs(12, (50, 40), 5)
    want = spanning(pairwise(v), np.zeros(len(v)))
    nodes = table(spark, v).select(F.col("doc_id").alias("rep"), F.col("reduced").alias("v"), F.lit(0.0).alias("core"))
    tree = density._tree(nodes, spark.createDataFrame([], density.TREE), 8, 3, limit).collect()
    assert len(tree) == len(v) - 1 and sum(r.w for r in tree) == pytest.approx(sum(w for _, _, w in want))
    order, gaps, floor = density._leaf_order(spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in want], density.TREE), limit)
    place = dict(tuple(r) for r in order.collect())
    row = {f"a_{c}": x for c, x in (("ids", np.arange(len(v)).tobytes()), ("vecs", v.astype(float).tobytes()), ("core", np.zeros(len(v)).tobytes()))}
    row |= {"a_tile": 0, "a_center": v.mean(0), "a_radius": 1e9, "a_pos": np.array([place[i] for i in range(len(v))], np.int64).tobytes()}
    found = density._lighter_edges([tiles.Block(row, "a")], [tiles.Block(row, "a")], gaps, floor)
    assert found is None if limit > len(v) else (len(gaps) <= limit and (found["w"] < floor).all())
