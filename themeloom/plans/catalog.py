"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.text import stop_words, tokens
from themeloom.functions.vectors import as_doubles, normalize
from themeloom.operators import (
    centroid,
    charts,
    density,
    embedding,
    keywords,
    metrics,
    naming,
    neighbors,
    reduction,
    reports,
    selection,
    weighting,
)
from themeloom.plans.model import ThemeModel
from themeloom.session import cut_lineage, scratch_path, spread
from themeloom.sources import documents as sources
from themeloom.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOMAINS = ("customer_reviews", "customer_complaints", "social_media", "other")
DBSCAN_EPS, DBSCAN_MIN, COSINE_EPS = 0.015, 5, 0.7


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def source_docs(spark: SparkSession, path: str) -> DataFrame:
    """All documents; the source number is the topic, the last source is noise."""
    number = F.when(F.col("source") == "src19", -1).otherwise(F.expr("cast(substr(source, 4) as int)"))
    return spread(table(spark, path, "documents").select("doc_id", "text", number.alias("topic")))


def labelled_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All vectors; label 9 is noise."""
    topic = F.when(F.col("label") == 9, -1).otherwise(F.col("label"))
    return table(spark, path, "embeddings").select(
        F.col("vec_id").alias("doc_id"), as_doubles(F.col("embedding")).alias("embedding"), topic.alias("topic")
    )


def vector_docs(spark: SparkSession, path: str) -> DataFrame:
    docs = spread(table(spark, path, "documents").select("doc_id", "text"))
    return sources.attach_vectors(docs, labelled_vectors(spark, path))


def plane(spark: SparkSession, path: str) -> DataFrame:
    """All vectors in their first two coordinates."""
    return labelled_vectors(spark, path).select("doc_id", F.slice("embedding", 1, 2).alias("reduced"))


def r6(column):
    return F.round(column, 6)


def shown_words(words):
    return F.array_join(F.transform(words, lambda w: F.format_string("%s=%.6f", w["word"], w["score"])), " ")


# ---- term weighting -------------------------------------------------------------------------


@query
def document_tokens(spark, path):
    words = tokens("text")
    return table(spark, path, "documents").select(
        "doc_id", F.size(words).alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("tokens_md5")
    )


@query
def stopword_antijoin(spark, path):
    terms = weighting.explode_terms(source_docs(spark, path), keep=("doc_id",), stop=())
    listed = spark.createDataFrame([(w,) for w in stop_words()], "term string")
    kept = weighting.remove_listed_terms(terms, listed)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), F.count_distinct("term").alias("n_distinct"))


@query
def ngram_counts(spark, path):
    counts = weighting.count_terms(source_docs(spark, path), ngram_range=(1, 2))
    return counts.filter(F.col("term").isNotNull()).select("topic", "term", "n")


@query
def topic_texts(spark, path):
    return weighting.gather_topic_text(source_docs(spark, path))


@query
def topic_word_totals(spark, path):
    counts = weighting.counted_terms(source_docs(spark, path))
    return weighting.topic_totals(counts).withColumn("mean_words", r6(weighting.mean_topic_words(counts).scalar()))


@query
def term_frequencies(spark, path):
    counts = weighting.counted_terms(source_docs(spark, path))
    return weighting.term_frequency(counts).select("topic", "term", "n", F.round("tf", 9).alias("tf"))


@query
def term_topic_frequencies(spark, path):
    return weighting.topic_document_frequency(weighting.count_terms(source_docs(spark, path)))


@query
def ctfidf_scores(spark, path):
    scores = weighting.ctfidf(weighting.counted_terms(source_docs(spark, path)))
    return scores.select("topic", "term", "n", F.round("tf", 9).alias("tf"), "df", F.round("score", 9).alias("score"))


@query
def bm25_scores(spark, path):
    counts = weighting.counted_terms(source_docs(spark, path))
    weighed = weighting.bm25(weighting.ctfidf(counts), topics=counts.select("topic").distinct())
    return weighed.select("topic", "term", r6("bm25").alias("bm25"))


@query
def bm25_counts(spark, path):
    """BM25 over raw counts with other parameters."""
    counts = weighting.counted_terms(source_docs(spark, path))
    weighed = weighting.bm25(counts.filter(F.col("term").isNotNull()), 1.2, 0.5, value="n", topics=counts.select("topic").distinct())
    return weighed.select("topic", "term", r6("bm25").alias("bm25"))


@query
def vocabulary(spark, path):
    return weighting.vocabulary(weighting.count_terms(source_docs(spark, path)))


def _ranked(docs: DataFrame, count: int = 10) -> DataFrame:
    return weighting.top_words(weighting.ctfidf(weighting.counted_terms(docs)), count)


@query
def topic_top_words(spark, path):
    return _ranked(source_docs(spark, path)).withColumn("score", F.round("score", 9))


@query
def topic_words_only(spark, path):
    nested = weighting.words_only(weighting.nest_words(_ranked(source_docs(spark, path))))
    return nested.select("topic", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


# ---- result tables --------------------------------------------------------------------------


@query
def topics(spark, path):
    nested = weighting.nest_words(_ranked(source_docs(spark, path)))
    return nested.select("topic", shown_words("words").alias("words"))


@query
def topic_info(spark, path):
    docs = source_docs(spark, path)
    info = reports.topic_info(docs.select("topic"), _ranked(docs))
    return info.withColumn("Top_words", shown_words("Top_words"))


@query
def topic_info_by_vectors(spark, path):
    docs = vector_docs(spark, path)
    info = reports.topic_info(docs.select("topic"), _ranked(docs))
    return info.withColumn("Top_words", shown_words("Top_words"))


@query
def document_info(spark, path):
    return reports.document_info(source_docs(spark, path))


@query
def topic_lines(spark, path):
    return reports.topic_lines(_ranked(source_docs(spark, path)))


@query
def topics_over_time(spark, path):
    events = table(spark, path, "events").select("ts", F.col("event_type").alias("topic"))
    binned = reports.topics_over_time(events, "ts", 10)
    return binned.select("bin", F.unix_micros("bin_start").alias("bin_start_us"), "topic", "n", r6("share").alias("share"))


@query
def topics_over_time_fine(spark, path):
    events = table(spark, path, "events").select("ts", F.col("event_type").alias("topic"))
    binned = reports.topics_over_time(events, "ts", 720, fill=False)
    return binned.select("bin", "topic", "n", r6("share").alias("share"))


# ---- selection ------------------------------------------------------------------------------


@query
def picked_text(spark, path):
    return selection.pick_text(table(spark, path, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn")))


@query
def text_limit(spark, path):
    return selection.limit_documents(table(spark, path, "documents").select("doc_id", "text"), 100)


@query
def assigned_rows(spark, path):
    return selection.assigned(labelled_vectors(spark, path)).select("doc_id", "topic")


@query
def word_counts(spark, path):
    return selection.with_word_count(table(spark, path, "documents")).select("doc_id", "n_words")


@query
def snippets(spark, path):
    return selection.with_snippet(table(spark, path, "documents")).select("doc_id", "snippet")


@query
def excerpts(spark, path):
    return selection.with_excerpt(table(spark, path, "documents")).select("doc_id", "excerpt")


@query
def seeded_sample(spark, path):
    return selection.seeded_sample(table(spark, path, "documents").select("doc_id", "lang"), 250)


@query
def plane_points(spark, path):
    return selection.plane_points(labelled_vectors(spark, path), "embedding").select("doc_id", r6("x").alias("x"), r6("y").alias("y"))


@query
def topic_labels(spark, path):
    return source_docs(spark, path).select("doc_id", selection.topic_label(F.col("topic")).alias("label"))


@query
def sample_per_topic(spark, path):
    return selection.sample_per_topic(source_docs(spark, path), 5).select("topic", "doc_id", "pick")


# ---- vectors --------------------------------------------------------------------------------


@query
def hash_embedding(spark, path):
    vectors = embedding.embed(spread(table(spark, path, "documents").select("doc_id", "text")))
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select("doc_id", "pos", r6("x").alias("x"))


def _letter_profile():
    """A tiny stand-in for an outside model: counts of five letters."""

    def run(batch: np.ndarray) -> np.ndarray:
        return np.array([[t.count(c) for c in "aeiou"] for t in batch.tolist()], dtype=np.float32)

    return run


@query
def encoder_hook(spark, path):
    vectors = embedding.embed(table(spark, path, "documents"), _letter_profile)
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select("doc_id", "pos", r6("x").alias("x"))


@query
def l2_normalize(spark, path):
    vectors = labelled_vectors(spark, path).select("doc_id", normalize(F.transform("embedding", lambda x: x * 3 + 1)).alias("u"))
    return vectors.select("doc_id", F.posexplode("u").alias("pos", "x")).select("doc_id", "pos", r6("x").alias("x"))


@query
def candidate_vectors(spark, path):
    words = keywords.candidate_words(weighting.ctfidf(weighting.counted_terms(source_docs(spark, path))))
    vectors = embedding.embed_terms(words, term="word")
    return vectors.select("term", F.posexplode("vector").alias("pos", "x")).select("term", "pos", r6("x").alias("x"))


@query
def attached_vectors(spark, path):
    docs = vector_docs(spark, path)
    return docs.select("doc_id", "topic", F.length("text").alias("n"), r6(F.element_at("embedding", 1)).alias("first"))


# ---- keywords -------------------------------------------------------------------------------


def _relevance(spark, path):
    docs = vector_docs(spark, path)
    candidates = keywords.candidate_words(weighting.ctfidf(weighting.counted_terms(docs)))
    return keywords.word_relevance(candidates, keywords.topic_centroids(docs))


@query
def keyword_candidates(spark, path):
    scores = weighting.ctfidf(weighting.counted_terms(source_docs(spark, path)))
    return keywords.candidate_words(scores, 50).withColumn("score", F.round("score", 9))


@query
def topic_centroids(spark, path):
    centers = keywords.topic_centroids(labelled_vectors(spark, path))
    return centers.select("topic", "n", F.posexplode("centroid").alias("pos", "x")).select("topic", "n", "pos", r6("x").alias("x"))


@query
def keyword_cosine(spark, path):
    return _relevance(spark, path).select("topic", "rank", "word", r6("relevance").alias("relevance"))


@query
def refined_keywords(spark, path):
    return keywords.refine_by_similarity(_relevance(spark, path)).withColumn("score", r6("score"))


def _described(spark, path) -> ThemeModel:
    docs = table(spark, path, "documents").select("doc_id", "text")
    return ThemeModel().describe(docs, labelled_vectors(spark, path).withColumn("reduced", F.col("embedding")))


@query
def model_refined(spark, path):
    """The model's own refinement after describing given labels."""
    return _described(spark, path).refine().ranked.withColumn("score", r6("score"))


@query
def mmr_words(spark, path):
    return keywords.refine_by_diversity(_relevance(spark, path)).withColumn("score", r6("score"))


# ---- naming ---------------------------------------------------------------------------------


def _domain():
    domain = F.lit(DOMAINS[3])
    for i, name in enumerate(DOMAINS[:3]):
        domain = F.when(F.col("topic") % 4 == i, F.lit(name)).otherwise(domain)
    return domain


def _named(spark, path):
    return weighting.words_only(weighting.nest_words(_ranked(source_docs(spark, path), 15)))


@query
def naming_instructions(spark, path):
    topics_ = source_docs(spark, path).filter("topic >= 0").select("topic").distinct()
    return topics_.select(
        "topic",
        naming.instruction(_domain()).alias("for_keywords"),
        naming.instruction(_domain(), documents=True).alias("for_documents"),
    )


@query
def prompt_keywords(spark, path):
    return naming.keyword_prompts(_named(spark, path), _domain()).select("topic", "keywords", "prompt")


@query
def representative_docs(spark, path):
    return naming.representative_documents(vector_docs(spark, path))


@query
def representative_docs_random(spark, path):
    return naming.representative_documents(source_docs(spark, path), vector=None)


@query
def prompt_documents(spark, path):
    docs = vector_docs(spark, path)
    words = weighting.words_only(weighting.nest_words(_ranked(docs)))
    prompts = naming.document_prompts(naming.representative_documents(docs), words, _domain())
    return prompts.select("topic", "prompt")


@query
def document_names(spark, path):
    """Names from representative documents where no generator answers."""
    return _described(spark, path).name(by="documents", domain=_domain()).select("topic", "name")


def _replies(docs: DataFrame) -> DataFrame:
    """Replies of four kinds, by document: whole JSON, JSON cut short, loose text, an object without
    the name."""
    head = F.regexp_replace(F.substring("text", 1, 40), r'["\\\n\r\t]', " ")
    good = F.concat(F.lit('{"topic_name": " '), head, F.lit(' ", "reasoning": "from '), F.col("doc_id").cast("string"), F.lit('"}'))
    kind = F.col("doc_id") % 4
    reply = (
        F.when(kind == 0, good)
        .when(kind == 1, F.substr(good, F.lit(1), F.length(good) - 1))
        .when(kind == 2, head)
        .otherwise(F.concat(F.lit('{"reasoning": "only '), F.col("doc_id").cast("string"), F.lit('"}')))
    )
    return docs.select("doc_id", reply.alias("reply"))


@query
def parsed_replies(spark, path):
    parsed = _replies(table(spark, path, "documents")).withColumn("p", naming.parse_reply(F.col("reply")))
    return parsed.select("doc_id", "p.name", "p.reasoning")


def _echo_generator():
    """A stand-in for a text generator: echoes the prompt and names the topic by its last keyword;
    refuses, answers without JSON or answers well by the length of the first keyword."""

    def run(prompts, max_new_tokens, temperature):
        out = []
        for prompt in prompts:
            words = prompt.split("Keywords: ")[-1].split("\nJSON:")[0].split(", ")
            if len(words[0]) % 3 == 0:
                raise ValueError("no answer")
            if len(words[0]) % 3 == 1:
                out.append(prompt + " I cannot say")
            else:
                out.append(prompt + ' {"topic_name": "About ' + words[-1] + '", "reasoning": "It fits"}')
        return out

    return run


@query
def generated_names(spark, path):
    prompts = cut_lineage(naming.keyword_prompts(_named(spark, path), _domain()))
    return naming.names_from_keywords(prompts, naming.generate(prompts, _echo_generator))


@query
def keyword_names(spark, path):
    return naming.names_from_keywords(naming.keyword_prompts(_named(spark, path)))


@query
def fallback_names(spark, path):
    return naming.fallback_names(source_docs(spark, path), _named(spark, path))


@query
def frequent_word_names(spark, path):
    return naming.fallback_names(source_docs(spark, path))


# ---- quality --------------------------------------------------------------------------------


def _both(spark, path):
    return labelled_vectors(spark, path).withColumn("reduced", F.col("embedding"))


@query
def coverage(spark, path):
    return metrics.coverage(source_docs(spark, path)).withColumn("coverage_pct", r6("coverage_pct"))


@query
def silhouette(spark, path):
    return metrics.silhouette(_both(spark, path)).select(r6("silhouette").alias("silhouette"))


@query
def silhouette_squared(spark, path):
    return metrics.silhouette_squared(_both(spark, path)).select(r6("silhouette_sq").alias("silhouette_sq"))


@query
def silhouette_estimated(spark, path):
    """From 200 points that meet all others, with the error of their mean."""
    found = metrics.silhouette_estimate(_both(spark, path), sample=200)
    return found.select(r6("silhouette").alias("silhouette"), r6("silhouette_error").alias("silhouette_error"), "silhouette_points")


@query
def davies_bouldin(spark, path):
    return metrics.davies_bouldin(_both(spark, path)).select(r6("davies_bouldin").alias("davies_bouldin"))


@query
def coherence(spark, path):
    return metrics.coherence(_both(spark, path)).select(r6("coherence").alias("coherence"))


@query
def diversity(spark, path):
    return metrics.diversity(_both(spark, path)).select(r6("diversity").alias("diversity"))


@query
def balance(spark, path):
    return metrics.balance(source_docs(spark, path)).select(r6("balance").alias("balance"))


@query
def evaluation_report(spark, path):
    return metrics.as_report(metrics.evaluate(_both(spark, path), exact=True)).withColumn("value", r6("value"))


@query
def cluster_summary(spark, path):
    return centroid.cluster_summary(source_docs(spark, path)).withColumn("outlier_pct", r6("outlier_pct"))


# ---- charts ---------------------------------------------------------------------------------


@query
def points_2d(spark, path):
    docs = vector_docs(spark, path).withColumn("reduced", F.col("embedding"))
    return charts.points_2d(docs, max_points=150).select(
        "doc_id", r6("x").alias("x"), r6("y").alias("y"), "snippet", "topic", "label", F.col("colour").cast("int").alias("colour")
    )


@query
def topic_distribution(spark, path):
    return charts.topic_distribution(source_docs(spark, path), 10)


@query
def topic_words_bar(spark, path):
    return charts.topic_words_bar(_ranked(source_docs(spark, path), 12), 3).withColumn("score", F.round("score", 9))


@query
def topic_words_grid(spark, path):
    return charts.topic_words_grid(_ranked(source_docs(spark, path))).withColumn("score", F.round("score", 9))


@query
def chart_tables(spark, path):
    docs = cut_lineage(vector_docs(spark, path).withColumn("reduced", F.col("embedding")))
    out = scratch_path(spark, "charts")
    names = charts.chart_tables(docs, cut_lineage(_ranked(docs)), path=out)
    counts = [
        spark.read.parquet(f"{out}/charts/{n}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("chart"), "n_rows")
        for n in sorted(names)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def chart_table_content(spark, path):
    """Every row of the written charts, as text."""
    docs = cut_lineage(vector_docs(spark, path).withColumn("reduced", F.col("embedding")))
    out = scratch_path(spark, "charts")
    charts.chart_tables(docs, cut_lineage(_ranked(docs)), path=out)

    def back(name: str, item, shown) -> DataFrame:
        return spark.read.parquet(f"{out}/charts/{name}").select(F.lit(name).alias("chart"), item.alias("item"), shown.alias("shown"))

    number = F.col("topic").cast("string")
    points = back("points_2d", F.col("doc_id").cast("string"), F.format_string("%.6f %.6f %d", "x", "y", "topic"))
    sizes = back("topic_distribution", number, F.format_string("%d", "n"))
    place = F.format_string("%d %d %s %.6f", "grid_row", "grid_col", "word", "score")
    words = back("topic_words_grid", F.concat_ws("-", "topic", "rank"), place)
    return points.unionByName(sizes).unionByName(words)


# ---- files ----------------------------------------------------------------------------------

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _csv(df: DataFrame, path: str, sep: str) -> None:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("sep", sep).csv(path)


@query
def roundtrip_csv(spark, path):
    out = scratch_path(spark, "docs") + ".csv"
    _csv(table(spark, path, "documents"), out, ",")
    return sources.load_documents(spark, out, schema=DOC_SCHEMA)


@query
def roundtrip_tsv(spark, path):
    out = scratch_path(spark, "docs") + ".tsv"
    _csv(table(spark, path, "documents"), out, "\t")
    return sources.load_documents(spark, out, schema=DOC_SCHEMA)


@query
def roundtrip_json(spark, path):
    out = scratch_path(spark, "docs") + ".json"
    sinks.write_json_array(table(spark, path, "documents"), out)
    return sources.load_documents(spark, out, schema=DOC_SCHEMA)


@query
def roundtrip_json_lines(spark, path):
    """One record per line under the .json suffix."""
    out = scratch_path(spark, "docs") + ".json"
    table(spark, path, "documents").write.json(out)
    return sources.load_documents(spark, out, schema=DOC_SCHEMA)


@query
def roundtrip_jsonl(spark, path):
    out = scratch_path(spark, "docs") + ".JSONL"
    table(spark, path, "documents").write.json(out)
    return sources.load_documents(spark, out).select("doc_id", "text", "lang", "source", "n_chars")


@query
def roundtrip_parquet(spark, path):
    out = scratch_path(spark, "docs") + ".parquet"
    table(spark, path, "documents").write.parquet(out)
    return sources.load_documents(spark, out)


@query
def roundtrip_feather(spark, path):
    out = scratch_path(spark, "docs") + ".feather"
    sinks.write_feather(table(spark, path, "documents"), out)
    return sources.load_documents(spark, out)


@query
def roundtrip_embeddings(spark, path):
    out = sinks.write_vectors(labelled_vectors(spark, path), scratch_path(spark, "vectors"), ["doc_id", "embedding"])
    back = sources.load_vectors(spark, out)
    return back.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select("doc_id", "pos", r6("x").alias("x"))


@query
def saved_topic_info(spark, path):
    docs = source_docs(spark, path)
    out = scratch_path(spark, "topic_info")
    sinks.write_topic_info(reports.topic_info(docs.select("topic"), _ranked(docs)), out)
    back = sources.read_csv(spark, out, "Topic int, Count bigint, Name string, Representation string, Top_words string")
    words = F.from_json("Top_words", "array<struct<word:string,score:double>>")
    return back.select("Topic", "Count", "Name", "Representation", shown_words(words).alias("Top_words"))


@query
def saved_document_info(spark, path):
    out = scratch_path(spark, "document_info")
    sinks.write_document_info(reports.document_info(source_docs(spark, path)), out)
    return sources.read_csv(spark, out, "doc_id bigint, Document string, Topic int, Document_Length int")


@query
def saved_metrics(spark, path):
    out = scratch_path(spark, "metrics")
    sinks.write_metrics(metrics.coverage(source_docs(spark, path)), out)
    back = spark.read.json(out)
    return back.select("n_topics", "n_documents", "n_assigned", "n_outliers", r6("coverage_pct").alias("coverage_pct"))


@query
def run_history(spark, path):
    out = scratch_path(spark, "runs")
    sizes = reports.topic_sizes(source_docs(spark, path))
    for stamp in ("20240101_000000", "20240102_000000"):
        sinks.append_run(sizes, out, stamp)
    return spark.read.parquet(out).select(F.col("run_id").cast("string").alias("run_id"), "topic", "n")


# ---- reduction ------------------------------------------------------------------------------


def _coordinates(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("doc_id", F.posexplode("reduced").alias("pos", "x")).select("doc_id", "pos", F.round("x", digits).alias("x"))


@query
def pca_reduce(spark, path):
    return _coordinates(reduction.pca(labelled_vectors(spark, path), 5)[0])


@query
def svd_reduce(spark, path):
    return _coordinates(reduction.truncated_svd(labelled_vectors(spark, path), 5)[0])


@query
def reduction_variance(spark, path):
    """Variance kept: all principal components together explain everything."""
    vectors = labelled_vectors(spark, path)
    width = vectors.select(F.size("embedding")).first()[0]
    reduced, _ = reduction.pca(vectors, width)
    spread = reduced.select("doc_id", F.posexplode("reduced").alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("v"))
    return spread.agg(r6(F.sum("v")).alias("total_variance"))


@query
def reduction_spectrum(spark, path):
    """Power sums of the variances that the returned ratios stand for; they equal traces of powers of the
    covariance matrix, so a wrong ratio shows."""
    vectors = labelled_vectors(spark, path)
    width = vectors.select(F.size("embedding")).first()[0]
    _, ratios = reduction.pca(vectors, width)
    cells = vectors.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("v"))
    total = cells.agg(F.sum("v").alias("total"))
    held = total.select("total", F.explode(F.array(*[F.lit(float(x)) for x in ratios])).alias("ratio"))
    variance = F.col("ratio") * F.col("total")
    powers = F.explode(F.array(*[F.struct(F.lit(k).alias("power"), F.pow(variance, F.lit(k)).alias("v")) for k in (1, 2, 3)]))
    return held.select(powers.alias("p")).groupBy("p.power").agg(r6(F.sum("p.v")).alias("value"))


@query
def knn_graph(spark, path):
    graph = neighbors.knn_graph(labelled_vectors(spark, path), 15, metric="cosine")
    return graph.select("src", "dst", "rank", r6("dist").alias("dist"))


@query
def fuzzy_edges(spark, path):
    graph = cut_lineage(neighbors.knn_graph(labelled_vectors(spark, path), 15, metric="cosine"))
    return neighbors.fuzzy_edges(graph).select("u", "v", r6("w").alias("w"))


@query
def spectral_layout(spark, path):
    return _coordinates(reduction.reduce_vectors(labelled_vectors(spark, path), "graph", 5))


# ---- clustering -----------------------------------------------------------------------------


@query
def kmeans_topics(spark, path):
    return centroid.kmeans(labelled_vectors(spark, path), 8, vector="embedding")[0]


@query
def kmeans_inertia(spark, path):
    labels, cost = centroid.kmeans(plane(spark, path), 8)
    sizes = labels.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("inertia", F.round(F.lit(cost), 6))


@query
def dbscan_labels(spark, path):
    return density.dbscan(plane(spark, path), DBSCAN_EPS, DBSCAN_MIN)


@query
def dbscan_cosine(spark, path):
    """All coordinates, cosine distance, many tiles."""
    return density.dbscan(labelled_vectors(spark, path), COSINE_EPS, DBSCAN_MIN, vector="embedding", tile_rows=64, metric="cosine")


@query
def knn_graph_tiles(spark, path):
    """The neighbour graph again with tiles small enough that pruning and pair joins take part."""
    graph = neighbors.knn_graph(labelled_vectors(spark, path), 15, metric="cosine", tile_rows=64)
    return graph.select("src", "dst", "rank", r6("dist").alias("dist"))


@query
def core_distance(spark, path):
    graph = neighbors.knn_graph(labelled_vectors(spark, path), 5)
    return neighbors.core_distances(graph, 5).select("id", r6("core").alias("core"))


@query
def mutual_reachability(spark, path):
    graph = cut_lineage(neighbors.knn_graph(labelled_vectors(spark, path), 5))
    edges = neighbors.mutual_reachability(graph, neighbors.core_distances(graph, 5))
    return edges.select("u", "v", r6("w").alias("w"))


@query
def mst_weight(spark, path):
    weight = density.tree_weight(labelled_vectors(spark, path), 5, vector="embedding")
    return weight.select("n_edges", r6("total_weight").alias("total_weight"))


@query
def single_linkage(spark, path):
    return density.single_linkage(plane(spark, path), 12)


@query
def ward_topics(spark, path):
    return centroid.cluster_vectors(plane(spark, path), "agglomerative", 8)


@query
def hdbscan_labels(spark, path):
    return density.hdbscan(plane(spark, path), 10, 5)


# ---- the whole path -------------------------------------------------------------------------


def _whole(spark, path, **settings) -> ThemeModel:
    docs = spread(table(spark, path, "documents").select("doc_id", "text"))
    return ThemeModel(**settings).fit(docs)


@query
def themes_graph_density(spark, path):
    """Built-in encoder, graph layout, HDBSCAN over all documents."""
    model = _whole(spark, path)
    return model.topic_info().withColumn("Top_words", shown_words("Top_words"))


@query
def themes_pca_kmeans(spark, path):
    """Built-in encoder, principal components, k-means, BM25 bigrams over all documents."""
    model = _whole(
        spark, path, reduction={"method": "pca"}, clustering={"method": "kmeans", "n_clusters": 8},
        weighting={"ngram_range": (1, 2), "use_bm25": True},
    )
    return model.topic_info().withColumn("Top_words", shown_words("Top_words"))


@query
def saved_model(spark, path):
    """A saved run read back: rows per saved table, with the parameters."""
    vectors = labelled_vectors(spark, path).withColumn("reduced", F.slice("embedding", 1, 5))
    docs = table(spark, path, "documents").select("doc_id", "text")
    model = ThemeModel(reduction={"method": "pca"}, clustering={"method": "kmeans", "n_clusters": 9})
    model.describe(docs, vectors)
    out = scratch_path(spark, "model")
    model.save(out)
    parts = [
        sources.read_csv(spark, f"{out}/topic_info"),
        sources.read_csv(spark, f"{out}/document_info"),
        spark.read.parquet(f"{out}/embeddings.parquet"),
        spark.read.parquet(f"{out}/reduced.parquet"),
        spark.read.json(f"{out}/parameters").filter("seed = 42"),
    ]
    names = ["topic_info", "document_info", "embeddings", "reduced", "parameters"]
    counts = [p.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("part"), "n_rows") for n, p in zip(names, parts)]
    out_df = counts[0]
    for other in counts[1:]:
        out_df = out_df.unionByName(other)
    return out_df


@query
def saved_model_content(spark, path):
    """Every row of a saved run read back, as text."""
    model = _described(spark, path)
    out = scratch_path(spark, "model")
    model.save(out)

    def rows(df: DataFrame, part: str, item, shown) -> DataFrame:
        return df.select(F.lit(part).alias("part"), item.cast("string").alias("item"), shown.alias("shown"))

    def vectors(name: str) -> DataFrame:
        first = F.format_string("%d %.6f %.6f", F.size(name), F.element_at(name, 1), F.element_at(name, -1))
        return rows(spark.read.parquet(f"{out}/{'embeddings' if name == 'embedding' else name}.parquet"), name, F.col("doc_id"), first)

    info = sources.read_csv(spark, f"{out}/topic_info", "Topic int, Count bigint, Name string, Representation string, Top_words string")
    docs = sources.read_csv(spark, f"{out}/document_info", "doc_id bigint, Document string, Topic int, Document_Length int")
    return (
        rows(info, "topic_info", F.col("Topic"), F.concat_ws(" ", "Count", "Name", "Representation"))
        .unionByName(rows(docs, "document_info", F.col("doc_id"), F.concat_ws(" ", "Topic", "Document_Length", F.md5("Document"))))
        .unionByName(vectors("embedding"))
        .unionByName(vectors("reduced"))
        .unionByName(rows(spark.read.json(f"{out}/parameters"), "parameters", F.lit("seed"), F.col("seed").cast("string")))
    )
