import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import metrics, neighbors, reduction


def table(spark, vecs, topics):
    rows = [(i, [float(x) for x in v], int(t)) for i, (v, t) in enumerate(zip(vecs, topics))]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>, topic int")
    return df.withColumn("reduced", F.col("embedding"))


def plain_silhouette(v, t, square=False):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    d = d**2 if square else d
    out = []
    for i in range(len(v)):
        own = (t == t[i]).sum() - 1
        b = min(d[i][t == k].mean() for k in set(t) if k != t[i])
        a = d[i][t == t[i]].sum() / own if own else None
        out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4)) + np.repeat(np.arange(3), 20)[:, None]
    t = np.repeat([0, 1, 2], 20)
    v[45:] = v[44]  # copies
    t[0] = 7  # a topic of one
    return np.concatenate([v, rng.normal(size=(5, 4))]), np.concatenate([t, [-1] * 5])


def test_measures_against_plain_versions(spark, sample):
    v, t = sample
    df = table(spark, v, t)
    held, ht = v[t >= 0], t[t >= 0]
    small = metrics.silhouette(df, tile_rows=7).first()[0]
    assert small == pytest.approx(plain_silhouette(held, ht), abs=1e-9)
    assert metrics.silhouette_squared(df, tile_rows=9).first()[0] == pytest.approx(plain_silhouette(held, ht, True), abs=1e-9)
    cents = {k: held[ht == k].mean(0) for k in set(ht)}
    spread = {k: np.linalg.norm(held[ht == k] - cents[k], axis=1).mean() for k in cents}
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(cents[i] - cents[j]) for j in cents if j != i) for i in cents])
    assert metrics.davies_bouldin(df, tile_rows=2).first()[0] == pytest.approx(db)
    unit = held / np.linalg.norm(held, axis=1)[:, None]
    coh = []
    for k in cents:
        u = unit[ht == k]
        if len(u) > 1:
            coh.append((u @ u.T)[np.triu_indices(len(u), 1)].mean())
    assert metrics.coherence(df).first()[0] == pytest.approx(np.mean(coh))
    c = np.array([x / np.linalg.norm(x) for x in cents.values()])
    assert metrics.diversity(df).first()[0] == pytest.approx(1 - (c @ c.T)[np.triu_indices(len(c), 1)].mean())
    sizes = np.array([(ht == k).sum() for k in cents])
    assert metrics.balance(df).first()[0] == pytest.approx(np.exp(-sizes.std() / sizes.mean()))


def test_labels_may_be_renamed(spark, sample):
    v, t = sample
    df, other = table(spark, v, t), table(spark, v, np.where(t >= 0, 50 - t, -1))
    for fn in (metrics.silhouette, metrics.davies_bouldin, metrics.coherence, metrics.diversity, metrics.balance):
        assert fn(df).first()[0] == pytest.approx(fn(other).first()[0])


def test_one_topic_and_no_topic(spark):
    one = table(spark, np.eye(3), [0, 0, -1])
    report = {r["metric"]: r["value"] for r in metrics.as_report(metrics.evaluate(one)).collect()}
    assert "silhouette" not in report and "davies_bouldin" not in report
    assert report["diversity"] == 0 and report["balance"] == 1 and report["n_topics"] == 1
    none = table(spark, np.eye(3), [-1, -1, -1])
    report = {r["metric"]: r["value"] for r in metrics.as_report(metrics.evaluate(none)).collect()}
    assert report["n_assigned"] == 0 and report["coherence"] == 0 and report["balance"] == 1


def column(df):
    return np.array([r["reduced"] for r in df.orderBy("doc_id").collect()])


def test_pca_and_svd_match_numpy(spark):
    v = np.random.default_rng(0).normal(size=(80, 6)) @ np.diag([5, 4, 3, 1, 1, 0.5]) + 2
    df = table(spark, v, [0] * 80).select("doc_id", "embedding")
    reduced, ratio = reduction.pca(df, 3)
    u, s, w = np.linalg.svd(v - v.mean(0), full_matrices=False)
    assert np.allclose(np.abs(column(reduced)), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    assert ratio.sum() == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())
    reduced, ratio = reduction.truncated_svd(df, 3)
    u, s, w = np.linalg.svd(v, full_matrices=False)
    assert np.allclose(np.abs(column(reduced)), np.abs(u[:, :3] * s[:3]), atol=1e-7)
    assert ratio == pytest.approx((u[:, :3] * s[:3]).var(axis=0) / v.var(axis=0).sum())
    with pytest.raises(ValueError):
        reduction.reduce_vectors(df, "tsne")
    with pytest.raises(ValueError):
        reduction.pca(df, 9)


def test_spectral_layout_finds_leading_eigenvectors(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(40, 3)) + c for c in (0, 4, 9)])
    edges = neighbors.fuzzy_edges(neighbors.knn_graph(table(spark, v, [0] * 120), 10)).collect()
    w = np.zeros((120, 120))
    for r in edges:
        w[r["u"], r["v"]] = w[r["v"], r["u"]] = r["w"]
    df = spark.createDataFrame([tuple(r) for r in edges], "u long, v long, w double")
    got = np.array([r["reduced"] for r in reduction.spectral_layout(df, 2, restarts=3).orderBy("id").collect()])
    deg = w.sum(1)
    s = w / np.sqrt(np.outer(deg, deg))
    values, vectors = np.linalg.eigh(s)
    top = vectors[:, np.argsort(values)[::-1][:3]]
    inside = top @ (top.T @ got)
    assert np.linalg.norm(inside - got) < 0.05 * np.linalg.norm(got)


def test_spectral_layout_in_many_strips_writes_once_a_restart(spark, monkeypatch):
    """Strips of a few points, named by texts: the leading eigenvectors, without a table for every step."""
    rng = np.random.default_rng(2)
    place = np.concatenate([rng.normal(size=(20, 2)) + c for c in (0, 3, 9)])
    apart = ((place[:, None] - place[None]) ** 2).sum(2)
    w = np.where((apart < 4) | (np.abs(np.subtract.outer(range(60), range(60))) == 1), np.exp(-apart / 2) + 0.05, 0.0) * (1 - np.eye(60))
    rows = [(f"p{i:02d}", f"p{j:02d}", float(w[i, j])) for i in range(60) for j in range(i) if w[i, j]]
    written = []
    monkeypatch.setattr(reduction, "cut_lineage", lambda df, cut=reduction.cut_lineage: written.append(1) or cut(df))
    monkeypatch.setattr(reduction, "POINTS_LOW", 16)
    laid = reduction.spectral_layout(spark.createDataFrame(rows, "u string, v string, w double"), 2, restarts=2, tolerance=1.0)
    got = {r["id"]: r["reduced"] for r in laid.collect()}
    assert len(written) < 9 and sorted(got) == [f"p{i:02d}" for i in range(60)]
    s = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    top = np.linalg.eigh(s)[1][:, -3:]
    found = np.array([got[i] for i in sorted(got)])
    assert np.linalg.norm(top @ (top.T @ found) - found) < 0.05 * np.linalg.norm(found)


def test_report_query_works_over_all_points(spark, tmp_path):
    """More points than a sample would hold: the silhouette of the report is that over all of them."""
    from themeloom.plans import catalog

    rng = np.random.default_rng(4)
    v = rng.normal(size=(2300, 3)) + rng.integers(0, 2, 2300)[:, None]
    rows = [(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "a text", "src0")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.metric: r.value for r in catalog.QUERIES["evaluation_report"](spark, str(tmp_path)).collect()}
    v, t = v.astype(np.float32).astype(float), np.arange(2300) % 3
    assert got["silhouette"] == pytest.approx(plain_silhouette(v, t), abs=1e-6) and "silhouette_error" not in got
