"""Named queries over streams, topic trees, factors and approximate searches, with their DuckDB twins.

Where SQL cannot make the same numbers, a query returns what must hold of them, worked out from its own result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.vectors import as_doubles, mean_vectors
from themeloom.operators import factors, forest, hierarchy, lda, neighbors, reduction, stochastic, vocabulary, weighting
from themeloom.operators.selection import assigned
from themeloom.plans.catalog import QUERIES, labelled_vectors, query, source_docs, table
from themeloom.session import cut_lineage, spread
from themeloom.streaming import topics as streams

#: Names of the queries of this module, in order.
BEFORE = set(QUERIES)

EVENTS = streams.Clock("ts", "1 day", "6 hours", "2 days")
READINGS = streams.Clock("ts", "12 hours", None, "1 hour")
FACTORS, TOPICS, TERMS = 5, 6, 1500
NEIGHBORS = 15


@query
def streamed_event_topics(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream: days that start every six hours, each event once, shares of every window."""
    stream = streams.read_files(spark, f"{path}/events.parquet")
    found = streams.topics_of_stream(stream, EVENTS, "event_type", "event_id")
    return found.select("window_start", "event_type", "n", F.round("share", 9).alias("share"))


@query
def streamed_vector_topics(spark: SparkSession, path: str) -> DataFrame:
    """Vectors as a stream, one every 37 minutes: the nearest topic centroid of each, counted by half days."""
    stream = streams.read_files(spark, f"{path}/embeddings.parquet")
    timed = stream.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 2220))
    centroids = mean_vectors(assigned(labelled_vectors(spark, path), "topic"), "topic", "embedding")
    placed = streams.assign_nearest(timed.select("ts", as_doubles(F.col("embedding")).alias("embedding")), centroids)
    found = streams.topics_of_stream(placed, READINGS)
    return found.select("window_start", "topic", "n", F.round("share", 9).alias("share"))


@query
def topic_tree(spark: SparkSession, path: str) -> DataFrame:
    counts = weighting.counted_terms(source_docs(spark, path))
    tree = hierarchy.merge_topics(counts, linkage="single")
    return tree.select("level", "kept", "merged", F.round("height", 9).alias("height"), "n_clusters", "n_topics")


@query
def topic_tree_words(spark: SparkSession, path: str) -> DataFrame:
    """The ten best words of every cluster where all, half, a quarter ... of the topics are left."""
    counts = weighting.counted_terms(source_docs(spark, path))
    levels = hierarchy.cut_tree(hierarchy.merge_topics(counts, linkage="single"), counts)
    words = hierarchy.level_words(counts, levels)
    return words.select("n_clusters", "cluster", "rank", "word", F.round("score", 9).alias("score"))


@query
def frequent_terms(spark: SparkSession, path: str) -> DataFrame:
    """The 500 most frequent terms of all texts from summaries of 1,000 terms."""
    docs = spread(table(spark, path, "documents").select("text"))
    return vocabulary.bounded_vocabulary(docs, 500, capacity=1000)


def _term_matrix(spark: SparkSession, path: str) -> factors.SparseTable:
    return factors.SparseTable(weighting.counted_terms(source_docs(spark, path)), "topic", "term", "n")


@query
def wide_svd_powers(spark: SparkSession, path: str) -> DataFrame:
    """All singular values of the topics' term counts by their power sums, which are traces of powers of the small Gram matrix."""
    matrix = _term_matrix(spark, path)
    rows = matrix.keys["r"].count()
    values = factors.sparse_svd(matrix, rows).values
    logs = [(k, float(sum((v / values[0]) ** (2 * k) for v in values)), float(values[0])) for k in (1, 2, 3)]
    found = spark.createDataFrame(logs, "power int, share double, first double")
    return found.select("power", F.round(F.log(F.col("share")) + 2 * F.col("power") * F.log("first"), 6).alias("log_sum"))


@query
def nmf_factors(spark: SparkSession, path: str) -> DataFrame:
    """Five non-negative factors of the topics' term counts: what must hold of them."""
    matrix = _term_matrix(spark, path)
    parts = factors.nonnegative_factors(matrix, FACTORS)
    low = parts.rows.select("f").union(parts.columns.select("f")).agg(F.min(F.array_min("f"))).first()[0]
    falls = all(b <= a + 1e-9 for a, b in zip(parts.residuals, parts.residuals[1:]))
    again = factors.residual_of(matrix, parts)
    shown = [(matrix.square, low >= 0, falls, abs(again - parts.residuals[-1]) < 1e-6, 0 < again < 1)]
    words = factors.factor_words(parts, 10).groupBy().agg(F.count(F.lit(1)).alias("n_words"))
    checks = spark.createDataFrame(shown, "square double, nonnegative boolean, falling boolean, recomputed boolean, explains boolean")
    return checks.withColumn("n_words", words.scalar())


@query
def lda_topics(spark: SparkSession, path: str) -> DataFrame:
    """Six topics of all documents over the 1,500 most frequent terms: what must hold of them."""
    docs = spread(table(spark, path, "documents").select("doc_id", "text"))
    model = lda.lda(docs, TOPICS, TERMS)
    total = F.aggregate("shares", F.lit(0.0), lambda acc, x: acc + x)
    rises = all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    words = float(model.topics.sum() - model.eta * model.topics.size)
    return model.shares.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.max(F.abs(total - 1) < 1e-9).alias("shares_sum_to_one"),
        # every word of the vocabulary is dealt out in full, to its document's shares and to the topics
        F.round(F.sum(F.col("weight") - 1.0)).cast("long").alias("n_words"),
        F.lit(round(words)).cast("long").alias("n_words_of_topics"),
        F.lit(rises).alias("rising"),
    )


@query
def approximate_neighbors(spark: SparkSession, path: str) -> DataFrame:
    """How much of the exact neighbour graph the forest finds."""
    vectors = labelled_vectors(spark, path)
    exact = cut_lineage(neighbors.knn_graph(vectors, NEIGHBORS, metric="cosine"))
    found = cut_lineage(forest.approximate_knn(vectors, NEIGHBORS, metric="cosine", leaf=256, trees=12))
    recall = forest.neighbor_recall(found, exact)
    return recall.select("n_points", "n_edges", (F.col("recall") >= 0.9).alias("recall_of_nine_tenths"))


@query
def stochastic_layout(spark: SparkSession, path: str) -> DataFrame:
    """A layout in the plane with ``min_dist``: every point has a place, and neighbours stay neighbours far more often than by chance."""
    vectors = labelled_vectors(spark, path)
    exact = cut_lineage(neighbors.knn_graph(vectors, NEIGHBORS, metric="cosine"))
    edges = cut_lineage(neighbors.fuzzy_edges(exact))
    start = reduction.spectral_layout(edges, 2, restarts=2, tolerance=0.05)
    laid = cut_lineage(stochastic.stochastic_layout(edges, start, min_dist=0.1, rounds=30))
    after = neighbors.knn_graph(laid.withColumnRenamed("id", "doc_id"), NEIGHBORS, vector="reduced")
    n = laid.count()
    kept = stochastic.preservation(exact, after)
    finite = laid.agg(F.min(F.forall("reduced", lambda x: F.abs(x) < 1e9))).first()[0]
    return kept.select(F.lit(n).cast("long").alias("n_points"), F.lit(finite).alias("finite"), (F.col("preserved") > 4 * NEIGHBORS / n).alias("preserved"))


NAMES = [name for name in QUERIES if name not in BEFORE]


def oracles() -> dict[str, str]:
    from themeloom.plans.oracles import SRC, VEC, WORD, stops, weights

    s = f"WITH RECURSIVE {SRC}, {weights('src')}"
    tree = f"""len2 AS (SELECT topic, sqrt(sum(score * score)) AS size FROM tfidf GROUP BY topic),
        pair AS (SELECT a.topic AS x, b.topic AS y, sum(a.score * b.score) AS p FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.topic < b.topic GROUP BY ALL),
        tp AS (SELECT DISTINCT topic FROM src WHERE topic >= 0),
        far AS (SELECT i.topic AS x, j.topic AS y, 1 - coalesce(p / nullif(a.size * b.size, 0), 0) AS d FROM tp i JOIN tp j ON i.topic < j.topic
          LEFT JOIN pair ON x = i.topic AND y = j.topic LEFT JOIN len2 a ON a.topic = i.topic LEFT JOIN len2 b ON b.topic = j.topic),
        sym AS (SELECT x, y, d FROM far UNION ALL SELECT y, x, d FROM far),
        cut AS (SELECT DISTINCT d AS t FROM far UNION ALL SELECT -1),
        reach(t, root, id) AS (SELECT t, topic, topic FROM cut, tp UNION SELECT r.t, r.root, s.y FROM reach r JOIN sym s ON s.x = r.id AND s.d <= r.t),
        home AS (SELECT t, id, min(root) AS root FROM reach GROUP BY ALL),
        cnt_of AS (SELECT t, count(DISTINCT root) AS n FROM home GROUP BY t),
        lev AS (SELECT n, min(t) AS t FROM cnt_of GROUP BY n),
        lh AS (SELECT lev.n, lev.t, id, root FROM lev JOIN home USING (t))"""
    event_days = """w AS (SELECT event_id, event_type, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS window_start
        FROM (SELECT DISTINCT event_id, event_type, ts FROM events WHERE ts IS NOT NULL), range(4) r(k)),
        c AS (SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL)"""
    vector_days = f"""{VEC}, cell AS (SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec WHERE topic >= 0),
        cen AS (SELECT topic, list(m ORDER BY pos) AS c FROM (SELECT topic, pos, avg(x) AS m FROM cell GROUP BY ALL) GROUP BY topic),
        near AS (SELECT doc_id, arg_min(cen.topic, struct_pack(d := list_distance(v, c), t := cen.topic)) AS topic FROM vec, cen GROUP BY doc_id),
        c AS (SELECT time_bucket(INTERVAL '12 hours', to_timestamp(1704067200 + doc_id * 2220)::TIMESTAMP) AS window_start, topic, count(*) AS n FROM near GROUP BY ALL)"""
    shares = "round(n / sum(n) OVER (PARTITION BY window_start), 9) AS share"
    gram = """g AS (SELECT a.topic AS x, b.topic AS y, sum(a.n::DOUBLE * b.n) AS p FROM cnt a JOIN cnt b USING (term) GROUP BY ALL),
        g2 AS (SELECT a.x, b.y, sum(a.p * b.p) AS p FROM g a JOIN g b ON a.y = b.x GROUP BY ALL)"""
    all_terms = f"""word AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents),
        kept AS (SELECT * FROM word WHERE term NOT IN ({stops()})),
        top AS (SELECT term, count(*) AS n FROM kept GROUP BY term ORDER BY n DESC, term LIMIT """
    lists = lambda m: f"WITH {all_terms}{m})"
    return {
        "streamed_event_topics": f"WITH {event_days} SELECT window_start, event_type, n, {shares} FROM c",
        "streamed_vector_topics": f"WITH {vector_days} SELECT window_start, topic::INTEGER AS topic, n, {shares} FROM c",
        "topic_tree": f"""{s}, {tree} SELECT ((SELECT count(*) FROM tp) - b.n)::INTEGER AS level, b.root::INTEGER AS kept, a.root::INTEGER AS merged,
            round(b.t, 9) AS height, b.n::INTEGER AS n_clusters, (SELECT count(*) FROM lh z WHERE z.n = b.n AND z.root = b.root)::INTEGER AS n_topics
            FROM lh b JOIN lh a ON a.n = b.n + 1 AND a.id = b.id AND a.root = a.id AND b.root <> a.root""",
        "topic_tree_words": f"""{s}, {tree},
            kept_n AS (SELECT DISTINCT (SELECT count(*) FROM tp) // (2 ** k)::BIGINT AS n FROM range(20) r(k) WHERE (SELECT count(*) FROM tp) // (2 ** k)::BIGINT > 0),
            lc AS (SELECT lh.n AS cl, root AS cluster, term, sum(cnt.n) AS n FROM lh JOIN kept_n USING (n) JOIN cnt ON cnt.topic = lh.id GROUP BY ALL),
            lt AS (SELECT cl, cluster, greatest(sum(n), 1) AS words FROM lc GROUP BY ALL),
            lm AS (SELECT cl, avg(words) AS mean FROM lt GROUP BY cl),
            lw AS (SELECT cl, cluster, term, n / words * ln(1 + mean / count(*) OVER (PARTITION BY cl, term)) AS score FROM lc JOIN lt USING (cl, cluster) JOIN lm USING (cl)),
            lr AS (SELECT *, row_number() OVER (PARTITION BY cl, cluster ORDER BY score DESC, term) AS rank FROM lw WHERE score > 0)
            SELECT cl::INTEGER AS n_clusters, cluster::INTEGER AS cluster, rank::INTEGER AS rank, term AS word, round(score, 9) AS score FROM lr WHERE rank <= 10""",
        "frequent_terms": lists(500) + " SELECT term, n FROM top",
        "wide_svd_powers": f"""{s}, {gram} SELECT 1 AS power, round(ln(sum(p)), 6) AS log_sum FROM g WHERE x = y UNION ALL SELECT 2, round(ln(sum(p * p)), 6) FROM g
            UNION ALL SELECT 3, round(ln(sum(a.p * b.p)), 6) FROM g2 a JOIN g b ON a.x = b.y AND a.y = b.x""",
        "nmf_factors": f"""{s} SELECT sum(n::DOUBLE * n) AS square, true AS nonnegative, true AS falling, true AS recomputed, true AS explains,
            {10 * FACTORS}::BIGINT AS n_words FROM cnt""",
        "lda_topics": lists(TERMS) + """ SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, true AS shares_sum_to_one,
            sum(n)::BIGINT AS n_words, sum(n)::BIGINT AS n_words_of_topics, true AS rising FROM top""",
        "approximate_neighbors": f"SELECT count(*) AS n_points, count(*) * {NEIGHBORS} AS n_edges, true AS recall_of_nine_tenths FROM embeddings",
        "stochastic_layout": "SELECT count(*) AS n_points, true AS finite, true AS preserved FROM embeddings",
    }
