"""Topic trees, Ward by contraction, sparse factors, LDA, bounded vocabularies, approximate neighbours, layouts and Feather files."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from themeloom.operators import contraction, factors, forest, hierarchy, lda, metrics, neighbors, reduction, stochastic, vocabulary
from themeloom.operators.joins import join_heavy
from themeloom.sources import documents as sources
from themeloom.sources import feather, sinks


def points(spark, v, name="reduced"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"doc_id long, {name} array<double>")


# ---- trees ------------------------------------------------------------------------------------


def plain_linkage(d, linkage):
    """Merges by comparing all pairs of clusters."""
    groups = [[i] for i in range(len(d))]
    of = {"single": min, "complete": max, "average": lambda x: sum(x) / len(x)}[linkage]
    out = []
    while len(groups) > 1:
        h, a, b = min((of([d[i][j] for i in x for j in y]), x[0], y[0]) for n, x in enumerate(groups) for y in groups[n + 1 :])
        left, right = (next(g for g in groups if g[0] == k) for k in (a, b))
        groups = sorted([g for g in groups if g[0] not in (a, b)] + [left + right])
        out.append((a, b, h))
    return out


@pytest.mark.parametrize("linkage", hierarchy.LINKAGES)
def test_merge_order(linkage):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(15, 3))
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    got, want = hierarchy.merge_order(d, linkage), plain_linkage(d, linkage)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert hierarchy.merge_order(np.zeros((1, 1))) == [] and hierarchy.halving(19) == [19, 9, 4, 2, 1]


def test_topic_tree_and_its_words(spark):
    words = {0: "a a b", 1: "a b b c", 4: "x y", 7: "x x y z", 9: "q"}
    rows = [(t, w, n) for t, text in words.items() for w, n in Counter(text.split()).items()] + [(12, None, 0)]
    counts = spark.createDataFrame(rows, "topic int, term string, n long")
    tree = hierarchy.merge_topics(counts, linkage="average")
    got = [tuple(r) for r in tree.orderBy("level").collect()]
    assert [r[1:3] for r in got[:2]] == [(4, 7), (0, 1)] or [r[1:3] for r in got[:2]] == [(0, 1), (4, 7)]
    assert got[-1][4:] == (1, 5) and [r[4] for r in got] == [4, 3, 2, 1] and got == sorted(got, key=lambda r: r[3])
    levels = hierarchy.cut_tree(tree, counts.filter("term IS NOT NULL"), cuts=[3, 1])
    home = {(r.n_clusters, r.topic): r.cluster for r in levels.collect()}
    assert [home[3, t] for t in (0, 1, 4, 7, 9)] == [0, 0, 4, 4, 9] and {home[1, t] for t in words} == {0}
    best = {(r.n_clusters, r.cluster, r.rank): (r.word, r.score) for r in hierarchy.level_words(counts, levels, 2).collect()}
    # at three clusters: sizes 7, 6, 1, so the mean is 14 / 3; every word occurs in one cluster
    assert best[3, 0, 1] == ("a", pytest.approx(3 / 7 * math.log(1 + 14 / 3)))
    assert best[3, 4, 1] == ("x", pytest.approx(3 / 6 * math.log(1 + 14 / 3))) and best[3, 9, 1][0] == "q"
    assert best[1, 0, 1] == ("a", pytest.approx(3 / 14 * math.log(1 + 14)))
    labels = spark.createDataFrame([(1, 7), (2, -1), (3, 1), (4, 12)], "doc_id long, topic int")
    assert {tuple(r) for r in hierarchy.relabel(labels, levels, 3).collect()} == {(1, 4), (2, -1), (3, 0), (4, 12)}
    with pytest.raises(ValueError):
        hierarchy.merge_topics(counts, linkage="nearest")


def plain_ward_heights(v, sizes):
    groups = {i: (v[i].astype(float), float(sizes[i])) for i in range(len(v))}
    out = []
    while len(groups) > 1:
        best = min((((groups[a][0] - groups[b][0]) ** 2).sum() * groups[a][1] * groups[b][1] / (groups[a][1] + groups[b][1]), a, b) for a in groups for b in groups if a < b)
        h, a, b = best
        (x, m), (y, n) = groups[a], groups.pop(b)
        groups[a] = ((x * m + y * n) / (m + n), m + n)
        out.append((a, b, h))
    return out


@pytest.mark.parametrize("local", [4, 12])
def test_ward_by_contraction_equals_plain_ward(spark, local):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(24, 3)) * [5, 2, 1] + rng.integers(0, 4, 24)[:, None] * 4
    sizes = rng.integers(1, 5, 24)
    df = points(spark, v).select(F.col("doc_id").alias("rep"), "reduced").withColumn("copies", F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), (F.col("rep") + 1).cast("int")))
    tree = contraction.ward_tree(df, local=local, tile_rows=9).orderBy("height", "round", "place").collect()
    want = plain_ward_heights(v, sizes)
    assert np.allclose([r.height for r in tree], [h for *_, h in want])
    assert {(r.a, r.b) for r in tree} == {(a, b) for a, b, _ in want}


def test_ward_search_compares_with_few_tiles(monkeypatch):
    """One heavy cluster a tile is far from all others; only it may look beyond its own tile, not its light neighbours."""
    rng = np.random.default_rng(11)
    many, rows = 12, 40
    vecs = rng.normal(size=(many, rows, 2)) + np.arange(many)[:, None, None] * [100.0, 0.0]
    vecs[:, 0] += [0.0, 40.0]
    size = np.ones((many, rows))
    size[:, 0] = 50.0
    ids = np.arange(many * rows).reshape(many, rows)
    blocks = []
    for i in range(many):
        center = vecs[i].mean(axis=0)
        row = {"tile": int(ids[i, 0]), "ids": ids[i].tobytes(), "vecs": vecs[i].tobytes(), "size": size[i].tobytes(), "search": np.ones(rows).tobytes()}
        row |= {"center": center, "radius": float(np.sqrt(((vecs[i] - center) ** 2).sum(1)).max()), "light": 1.0}
        here = contraction.Block({f"b_{k}": v for k, v in row.items()}, "b")
        _, other, near = contraction._nearest_rows(ids[i], vecs[i], size[i], here)
        blocks.append(row | {"near": near.tobytes(), "other": other.tobytes()})
    met, plain = [], contraction.block_squares
    monkeypatch.setattr(contraction, "block_squares", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    sides = [[contraction.Block({f"{side}_{k}": v for k, v in row.items()}, side) for row in blocks] for side in "ab"]
    parts = [contraction._nearest_in_strips(sides[0], sides[1][low : low + 4]) for low in (0, 4, 8)]
    got = {}
    for part in parts:
        for r in part.itertuples():
            got[r.id] = min(got.get(r.id, (np.inf, -1)), (r.growth, r.other))
    v, n = vecs.reshape(-1, 2), size.reshape(-1)
    growth = ((v[:, None] - v[None]) ** 2).sum(2) * n[:, None] * n[None] / (n[:, None] + n[None])
    np.fill_diagonal(growth, np.inf)
    assert [got[i][1] for i in range(len(v))] == growth.argmin(axis=1).tolist()
    # all pairs of different tiles would be (many - 1) * many * rows ** 2
    assert sum(met) < 0.1 * many * (many - 1) * rows**2


def test_ward_of_many_points_equals_one_task(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(2600, 2)) + rng.integers(0, 9, (2600, 1)) * 6
    df = points(spark, np.vstack([v, v[:50]]))
    got = {r.doc_id: r.topic for r in contraction.ward_labels(df, 30, local=1500).collect()}
    home = {i: i for i in range(2600)}
    sizes = np.ones(2600)
    sizes[:50] = 2
    for a, b, _ in contraction.ward_merges(np.arange(2600), v, sizes)[: 2600 - 30]:
        home[b] = a

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    number = {r: i for i, r in enumerate(sorted({root(i) for i in range(2600)}))}
    assert got == {i: number[root(i % 2600)] for i in range(2650)}


# ---- factors ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(1)
    # three strong directions and noise
    dense = rng.poisson(0.2 + 4 * rng.random((40, 3)) ** 6 @ rng.random((3, 300)) ** 4)
    dense[:, 7] = 3  # a column with a cell in every row
    rows = [(f"r{i}", f"c{j}", int(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    return dense, factors.SparseTable(spark.createDataFrame(rows, "r string, c string, x long").repartition(6), "r", "c", "x")


def arrays(df, key):
    return {r[key]: np.array(r.f) for r in df.collect()}


def test_sparse_svd_equals_numpy(spark, sparse):
    dense, matrix = sparse
    want = np.linalg.svd(dense, compute_uv=False)
    found = factors.sparse_svd(matrix, 4, tolerance=1e-6)
    assert np.allclose(found.values, want[:4], rtol=1e-4)
    left, right = arrays(found.left, "r"), arrays(found.right, "c")
    u = np.array([left[f"r{i}"] for i in range(40)])
    v = np.array([right.get(f"c{j}", np.zeros(4)) for j in range(300)])
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-9) and np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    assert np.abs(dense @ v - u * found.values).max() < 1e-2 * want[0]
    whole = factors.sparse_svd(matrix, 40)
    assert np.allclose(whole.values, want, rtol=1e-8)
    one = factors.SparseTable(spark.createDataFrame([("r", "c", 2.0), ("r", "d", -1.0), (None, "d", 1.0), ("q", "d", 0.0)], "r string, c string, x double"), "r", "c", "x")
    assert np.allclose(factors.sparse_svd(one, 3).values, [math.sqrt(5)])
    with pytest.raises(ValueError):
        factors.sparse_svd(factors.SparseTable(spark.createDataFrame([], "r string, c string, x double"), "r", "c", "x"), 2)


def test_heavy_columns_are_found(sparse):
    dense, matrix = sparse
    assert len(matrix.heavy["c"]) < factors.HEAVY and "c7" in matrix.heavy["c"]
    assert matrix.square == (dense.astype(float) ** 2).sum()


def test_nonnegative_factors(sparse):
    dense, matrix = sparse
    parts = factors.nonnegative_factors(matrix, 3, tolerance=2e-3)
    assert all(b <= a + 1e-12 for a, b in zip(parts.residuals, parts.residuals[1:]))
    rows, columns = arrays(parts.rows, "r"), arrays(parts.columns, "c")
    w = np.array([rows[f"r{i}"] for i in range(40)])
    h = np.array([columns.get(f"c{j}", np.zeros(3)) for j in range(300)])
    assert w.min() >= 0 and h.min() >= 0
    real = np.linalg.norm(dense - w @ h.T) / np.linalg.norm(dense)
    assert real == pytest.approx(parts.residuals[-1], abs=1e-6) and real == pytest.approx(factors.residual_of(matrix, parts), abs=1e-6)
    assert real < 1.15 * np.sqrt((np.linalg.svd(dense, compute_uv=False)[3:] ** 2).sum()) / np.linalg.norm(dense)


def test_factors_of_planted_topics(spark):
    rows = [(d, f"{'abc'[d % 3]}{j}", 5 + (d * j) % 3) for d in range(30) for j in range(8)]
    matrix = factors.SparseTable(spark.createDataFrame(rows, "d long, w string, n long"), "d", "w", "n")
    parts = factors.nonnegative_factors(matrix, 3)
    topic = {r.doc_id: r.topic for r in factors.strongest(parts).collect()}
    assert len({topic[d] for d in range(3)}) == 3 and all(topic[d] == topic[d % 3] for d in range(30))
    words = factors.factor_words(parts, 8).groupBy("topic").agg(F.collect_set(F.substring("word", 1, 1)).alias("s")).collect()
    assert sorted(r.s[0] for r in words) == ["a", "b", "c"] and all(len(r.s) == 1 for r in words)


def test_gamma_functions():
    x = np.array([0.001, 0.2, 0.5, 1.0, 2.0, 3.7, 11.0, 1e4])
    assert np.allclose(lda.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    step = 1e-6
    assert np.allclose(lda.digamma(x[1:]), [(math.lgamma(v + step * v) - math.lgamma(v - step * v)) / (2 * step * v) for v in x[1:]], rtol=1e-5, atol=1e-5)


def test_lda_shares_do_not_depend_on_the_batch():
    """A document at rest leaves, so its shares are those that it has when fitted alone."""
    rng = np.random.default_rng(5)
    logs = np.log(rng.dirichlet(np.full(40, 0.3), 4)).T
    lists = [np.sort(rng.choice(40, size, replace=False)) for size in (2, 30, 0, 5, 40)]
    counts = [rng.integers(1, 20, len(x)).astype(float) for x in lists]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    gamma, parts, bound = lda.fit_shares(np.concatenate(lists).astype(int), np.concatenate(counts), doc, np.ones((5, 4)), logs, 0.25)
    alone = [lda.fit_shares(x.astype(int), c, np.zeros(len(x), int), np.ones((1, 4)), logs, 0.25) for x, c in zip(lists, counts)]
    assert np.allclose(gamma, np.concatenate([a[0] for a in alone]), rtol=1e-12)
    assert np.allclose(parts, np.concatenate([a[1] for a in alone]), rtol=1e-12) and bound == pytest.approx(sum(a[2] for a in alone))


def test_lda_finds_planted_topics(spark):
    rng = np.random.default_rng(3)
    vocab = [[f"{a}{a}{b}" for b in "abcdefghijkl"] for a in "xyz"]
    rows = []
    for d in range(90):
        main = d % 3
        text = [str(rng.choice(vocab[main if rng.random() < 0.95 else rng.integers(3)])) for _ in range(40)]
        rows.append((d, " ".join(text)))
    rows += [(900, None), (901, "!"), (902, "unseen")]
    model = lda.lda(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, n_terms=36, tolerance=1e-5)
    assert len(model.vocabulary) == 36 and len(model.bounds) > 2
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    shares = {r.doc_id: r.shares for r in model.shares.collect()}
    assert len(shares) == 93 and all(abs(sum(s) - 1) < 1e-9 for s in shares.values())
    assert np.allclose(shares[900], 1 / 3) and np.allclose(shares[902], 1 / 3)
    topic = {r.doc_id: r.topic for r in model.document_topics().collect()}
    assert len({topic[d] for d in range(3)}) == 3 and all(topic[d] == topic[d % 3] for d in range(90))
    words = model.words(12).groupBy("topic").agg(F.collect_set(F.substring("word", 1, 1)).alias("s")).collect()
    assert sorted(r.s[0] for r in words) == ["x", "y", "z"] and all(len(r.s) == 1 for r in words)


# ---- vocabulary -------------------------------------------------------------------------------


def test_frequent_terms_are_exact(spark):
    rng = np.random.default_rng(2)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 20_000) % 5000] + ["tie1", "tie2"] * 30
    df = spark.createDataFrame([(w,) for w in words] + [(None,)] * 5, "term string").repartition(9)
    want = sorted(Counter(words).items(), key=lambda kv: (-kv[1], kv[0]))
    for count, capacity in ((5, 1), (40, 90), (300, 1000), (9000, 10)):
        got = [tuple(r) for r in vocabulary.frequent_terms(df, count, capacity=capacity).orderBy(F.desc("n"), "term").collect()]
        assert got == want[:count]
    assert vocabulary.frequent_terms(df.limit(0), 3).count() == 0


def test_summaries_miss_nothing_above_their_bound():
    rng = np.random.default_rng(7)
    parts, whole = [], Counter()
    taken = 0
    for _ in range(20):
        words = [f"w{int(x)}" for x in rng.zipf(1.5, 500) % 200]
        whole.update(words)
        found = Counter(words)
        t, c, cut = vocabulary.shrink(np.array(list(found), object), np.array(list(found.values())), 15)
        taken += cut
        parts.append((t, c))
    terms, counts, cut = vocabulary.merged(parts, 15)
    taken += cut
    low = dict(zip(terms, counts))
    assert len(low) <= 15 and all(whole[w] - taken <= n <= whole[w] for w, n in low.items())
    assert all(w in low for w, n in whole.items() if n > taken) and taken <= sum(whole.values()) / 16


# ---- neighbours and layouts -------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 12)) + rng.normal(size=(9, 12)).repeat(100, 0) * 4
    v[890:] = v[0]
    return v, points(spark, v, "embedding")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_approximate_neighbours(blobs, metric):
    _, df = blobs
    exact = neighbors.knn_graph(df, 10, metric=metric)
    found = forest.approximate_knn(df, 10, metric=metric, leaf=128, trees=6)
    row = forest.neighbor_recall(found, exact).first()
    assert row.n_points == 900 and row.n_edges == 9000 and row.recall >= 0.9
    shape = found.groupBy("src").agg(F.count("*").alias("n"), F.max("rank").alias("r"), F.count_distinct("dst").alias("d")).collect()
    assert len(shape) == 900 and all(r.n == r.d == r.r <= 10 for r in shape)
    # distances are those of the exact graph
    both = found.alias("f").join(exact.alias("e"), ["src", "dst"]).select(F.max(F.abs(F.col("f.dist") - F.col("e.dist")))).first()[0]
    assert both < 1e-9


def test_refinement_finds_more(blobs):
    _, df = blobs
    exact = neighbors.knn_graph(df, 10)
    recalls = [forest.neighbor_recall(forest.approximate_knn(df, 10, leaf=60, trees=2, rounds=r), exact).first().recall for r in (0, 1)]
    assert recalls[1] > recalls[0]


def test_leaves_are_about_equal(blobs):
    _, df = blobs
    sizes = [r["count"] for r in forest.leaves(df, "doc_id", "embedding", 3, 120).groupBy("tree", "leaf").count().collect()]
    assert len(sizes) == 24 and sum(sizes) == 2700 and max(sizes) <= 130


def test_closeness_curve():
    a, b = stochastic.closeness_curve(0.1)
    # the values that this common choice is known for
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)
    assert stochastic.closeness_curve(0.8)[0] < a
    with pytest.raises(ValueError):
        stochastic.closeness_curve(-1)


def test_stochastic_layout_keeps_neighbours_and_distance(spark, blobs):
    v, df = blobs
    held = df.filter("doc_id < 890")
    graph = neighbors.knn_graph(held, 10)
    edges = neighbors.fuzzy_edges(graph)
    start = reduction.spectral_layout(edges, 2, restarts=2, tolerance=0.1)
    near = {}
    for min_dist in (0.0, 0.9):
        laid = stochastic.stochastic_layout(edges, start, min_dist, rounds=10).withColumnRenamed("id", "doc_id")
        assert laid.count() == 890
        after = neighbors.knn_graph(laid, 10, vector="reduced")
        assert stochastic.preservation(graph, after).first().preserved > 8 * 10 / 890
        near[min_dist] = after.filter("rank = 1").agg(F.percentile_approx("dist", 0.5)).first()[0]
    # points keep apart where they are told to
    assert near[0.9] > near[0.0]
    none = stochastic.stochastic_layout(edges.limit(0), start)
    assert none.count() == 890
    again = stochastic.stochastic_layout(edges, start, 0.1, rounds=2).orderBy("id").collect()
    assert again == stochastic.stochastic_layout(edges, start, 0.1, rounds=2).orderBy("id").collect()


def test_graph_layout_takes_min_dist_and_search(blobs):
    _, df = blobs
    out = reduction.graph_layout(df.filter("doc_id < 300"), 2, 8, min_dist=0.2, neighbors="approximate")
    assert out.count() == 300 and out.filter(F.size("reduced") == 2).count() == 300
    with pytest.raises(ValueError):
        reduction.graph_layout(df, 2, neighbors="some")


# ---- estimated silhouette ---------------------------------------------------------------------


def test_estimated_silhouette(spark, blobs):
    v, df = blobs
    labelled = df.select("doc_id", F.col("embedding").alias("reduced"), F.when(F.col("doc_id") > 880, -1).otherwise(F.floor(F.col("doc_id") / 100)).cast("int").alias("topic"))
    exact = metrics.silhouette(labelled).first()[0]
    whole = metrics.silhouette_estimate(labelled, sample=2000).first()
    assert whole.silhouette == pytest.approx(exact, abs=1e-9) and whole.silhouette_error == 0 and whole.silhouette_points == 881
    for seed in range(4):
        part = metrics.silhouette_estimate(labelled, sample=100, seed=seed).first()
        assert part.silhouette_error > 0 and abs(part.silhouette - exact) <= part.silhouette_error
    one = metrics.silhouette_estimate(labelled.filter("topic = 1")).first()
    assert tuple(one) == (None, None, 0)
    assert tuple(metrics.silhouette_estimate(labelled.limit(0)).first()) == (None, None, 0)


# ---- joins and files --------------------------------------------------------------------------


def test_heavy_keys_join_like_others(spark):
    rows = [(1 if i < 3000 else i, i) for i in range(5000)] + [(None, 7)]
    left = spark.createDataFrame(rows, "k long, x long")
    right = left.filter("k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = Counter(tuple(r) for r in join_heavy(left, right, ["k"], how).select("k", "x", "n").collect())
        assert got == Counter(tuple(r) for r in left.join(right, "k", how).select("k", "x", "n").collect())


def test_feather_source(spark, tmp_path):
    path = f"{tmp_path}/t.feather"
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("text"), F.array("id").alias("ids"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("x"))
    sinks.write_feather(df.repartition(3), path)
    assert len([f for f in os.listdir(path) if f.endswith(".feather")]) == 3 and not os.path.exists(f"{path}/{feather.PENDING}")
    back = sources.load_documents(spark, path)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    sinks.write_feather(df.limit(10).coalesce(1), path, overwrite=False, compression="zstd")
    assert sources.load_documents(spark, path).count() == 1010
    sinks.write_feather(df.limit(4).coalesce(1), path)
    assert sources.load_documents(spark, path).count() == 4 and len(os.listdir(path)) <= 2
    # some of the columns, by a schema
    assert sources.read_feather(spark, path, "x double, id bigint").columns == ["x", "id"]


def test_a_large_feather_file_is_read_in_parts(spark, tmp_path):
    file = f"{tmp_path}/one.arrow"
    schema = pa.schema([("id", pa.int64())])
    with pa.OSFile(file, "wb") as sink, ipc.new_file(sink, schema) as writer:
        for i in range(40):
            writer.write_batch(pa.record_batch([pa.array(range(i * 100, i * 100 + 100))], schema))
    parts = feather.FeatherReader(file, None, os.path.getsize(file) // 8).partitions()
    assert len(parts) == 10 and sorted(i for p in parts for i in range(p.first, p.end)) == list(range(40))
    df = sources.read_feather(spark, file, partition_bytes=os.path.getsize(file) // 8)
    assert df.rdd.getNumPartitions() == 10 and df.agg(F.sum("id")).first()[0] == sum(range(4000))


def test_a_failed_feather_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/t.feather"
    sinks.write_feather(spark.range(5).coalesce(1), path)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_feather(bad, path)
    assert sources.load_documents(spark, path).count() == 5 and not os.path.exists(f"{path}/{feather.PENDING}")
    with pytest.raises(FileNotFoundError):
        sources.load_documents(spark, f"{tmp_path}/none.feather")


def test_shares_in_pieces_and_documents_with_one_key(spark, monkeypatch):
    """The fit works on some cells at a time; rows of one key are one document, and one without a key has no terms."""
    rng = np.random.default_rng(5)
    doc = np.repeat(np.arange(30), rng.integers(1, 9, 30))
    terms, counts, logs = rng.integers(0, 40, len(doc)), rng.integers(1, 5, len(doc)).astype(float), np.log(rng.random((40, 3)))
    found = []
    for cells in (4, 10**6):
        monkeypatch.setattr(lda, "FIT_CELLS", cells)
        found.append(lda.fit_shares(terms, counts, doc, np.ones((32, 3)), logs, 0.3))
    for small, whole in zip(*found):
        assert np.allclose(small, whole, rtol=1e-12)
    assert np.allclose(found[0][0].sum(1) - 0.9, np.bincount(doc, counts, 32))
    rows = [(1, "beta gamma beta"), (2, "delta"), (1, "alpha beta other"), (None, "beta"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in lda.document_terms(docs, ["alpha", "beta", "gamma"], stop=()).collect()}
    assert got == {1: ([0, 1, 2], [1.0, 3.0, 1.0]), 2: ([], []), None: ([], []), 3: ([], [])}
    lists = docs.selectExpr("split(coalesce(text, ''), ' ') AS term")
    assert {r.term: r.low for r in vocabulary.sketch(lists, 50).collect() if r.term} == {"beta": 4, "gamma": 1, "delta": 1, "alpha": 1, "other": 1}
