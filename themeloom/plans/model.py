"""The whole path from documents to topics, as one chainable object."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators import charts, keywords, metrics, naming, reports
from themeloom.operators.centroid import cluster_vectors
from themeloom.operators.embedding import embed
from themeloom.operators.reduction import reduce_vectors
from themeloom.operators.selection import limit_documents, pick_text
from themeloom.operators.weighting import nest_words, top_words, weigh_terms, words_only
from themeloom.session import cut_lineage, shared_dir, spread
from themeloom.sources import sinks
from themeloom.sources.documents import load_documents


class ThemeModel:
    """Encode, reduce, cluster, weigh terms; every result is a DataFrame.

    ``reduction``: method (graph, pca, svd), components and the method's options.
    ``clustering``: method (hdbscan, kmeans, dbscan, agglomerative), n_clusters and options.
    ``weighting``: ngram_range, use_bm25, bm25_k1, bm25_b, stop, top_n_words.
    ``embedding``: encoder ("hash" or a model factory), batch_size, width, max_words.
    """

    def __init__(
        self,
        embedding: dict | None = None,
        reduction: dict | None = None,
        clustering: dict | None = None,
        weighting: dict | None = None,
        seed: int = 42,
    ):
        self.embedding = dict(embedding or {})
        self.reduction = {"method": "graph", "components": 5, **(reduction or {})}
        self.clustering = {"method": "hdbscan", **(clustering or {})}
        self.weighting = dict(weighting or {})
        self.seed = seed
        self.points: DataFrame | None = None
        self.scores: DataFrame | None = None
        self.ranked: DataFrame | None = None

    def fit(self, docs: DataFrame, vectors: DataFrame | None = None) -> "ThemeModel":
        """``docs <doc_id, text>``; ``vectors <doc_id, embedding>`` replaces encoding."""
        held = pick_text(docs)
        embedded = vectors.select("doc_id", "embedding") if vectors is not None else embed(held, **self.embedding)
        embedded = cut_lineage(embedded.join(held.select("doc_id"), "doc_id", "left_semi"))
        reduced = cut_lineage(reduce_vectors(embedded, seed=self.seed, **self.reduction))
        labels = cut_lineage(cluster_vectors(reduced.select("doc_id", "reduced"), seed=self.seed, **self.clustering))
        return self.describe(held, reduced.join(labels, "doc_id"))

    def describe(self, docs: DataFrame, labelled: DataFrame) -> "ThemeModel":
        """Topic words for labels that exist already: ``labelled <doc_id, embedding, reduced, topic>``."""
        self.points = docs.join(labelled, "doc_id")
        options = {k: v for k, v in self.weighting.items() if k != "top_n_words"}
        self.scores = weigh_terms(self.points, **options)
        self.ranked = cut_lineage(top_words(self.scores, self.weighting.get("top_n_words", 10)))
        return self

    def _need(self) -> None:
        if self.ranked is None:
            raise ValueError("call fit() first")

    def topics(self) -> DataFrame:
        """``<topic, words array<struct<word, score>>>``."""
        self._need()
        return nest_words(self.ranked)

    def refine(
        self, count: int = 10, candidates: int = 50, diversity: float | None = None, encoder: Callable | str | None = None
    ) -> "ThemeModel":
        """Re-rank each topic's words by similarity to its centroid, or with ``diversity`` (0 to 1) by
        maximal marginal relevance. ``encoder`` must be the one the documents' vectors came from."""
        self._need()
        kind = encoder or self.embedding.get("encoder", "hash")
        options = {"width": self.embedding["width"]} if "width" in self.embedding else {}
        words = keywords.candidate_words(self.scores, candidates)
        relevance = keywords.word_relevance(words, keywords.topic_centroids(self.points), kind, **options)
        if diversity is None:
            refined = keywords.refine_by_similarity(relevance, count)
        else:
            refined = keywords.refine_by_diversity(relevance, count, diversity)
        self.ranked = cut_lineage(refined)
        return self

    def name(self, make_generator: Callable | None = None, domain: str = "other", by: str = "keywords", **options) -> DataFrame:
        """``<topic, name, reasoning>`` from ``keywords`` or ``documents``; without a generator, names made of words."""
        self._need()
        words = words_only(nest_words(self.ranked))
        if by == "keywords":
            prompts = naming.keyword_prompts(words, domain)
            replies = naming.generate(prompts, make_generator, **options) if make_generator else None
            return naming.names_from_keywords(prompts, replies)
        if by != "documents":
            raise ValueError(f"names come from keywords or documents, not {by!r}")
        chosen = cut_lineage(naming.representative_documents(self.points))
        prompts = naming.document_prompts(chosen, words, domain)
        if make_generator:
            replies = naming.generate(prompts, make_generator, **options)
        else:
            replies = prompts.select("topic", F.lit("").alias("reply"), F.lit(True).alias("failed"))
        return naming.names_from_documents(prompts, chosen, replies)

    def topic_info(self) -> DataFrame:
        self._need()
        return reports.topic_info(self.points, self.ranked)

    def document_info(self) -> DataFrame:
        self._need()
        return reports.document_info(self.points)

    def topic_lines(self, count: int = 10) -> DataFrame:
        """Printable topic lines with the methods that made them."""
        self._need()
        lines = reports.topic_lines(self.ranked, count)
        return lines.withColumn("method", F.lit(f"{self.reduction['method']} + {self.clustering['method']}".upper()))

    def topics_over_time(self, times: DataFrame, timestamp: str = "ts", nr_bins: int = 10) -> DataFrame:
        """``times <doc_id, timestamp>``."""
        self._need()
        stamped = self.points.select("doc_id", "topic").join(times.select("doc_id", timestamp), "doc_id")
        return reports.topics_over_time(stamped, timestamp, nr_bins)

    def evaluate(self, exact: bool | None = None) -> DataFrame:
        """Every measure; see ``metrics.evaluate`` for the three silhouettes."""
        self._need()
        return metrics.evaluate(self.points, exact=exact)

    def charts(self, path: str | None = None) -> dict[str, DataFrame]:
        self._need()
        return charts.chart_tables(self.points, self.ranked, path=path)

    def parameters(self) -> dict:
        plain = {k: v if isinstance(v, (str, int, float, bool, type(None))) else repr(v) for k, v in self.embedding.items()}
        return {
            "embedding": plain,
            "reduction": self.reduction,
            "clustering": self.clustering,
            "weighting": {k: list(v) if isinstance(v, tuple) else v for k, v in self.weighting.items()},
            "seed": self.seed,
        }

    def save(self, path: str) -> None:
        """Topic info, document info, both vector tables and the parameters below ``path``."""
        self._need()
        base = path.rstrip("/")
        sinks.write_topic_info(self.topic_info(), f"{base}/topic_info")
        sinks.write_document_info(self.document_info(), f"{base}/document_info")
        sinks.write_vectors(self.points, f"{base}/embeddings", ["doc_id", "embedding"])
        sinks.write_vectors(self.points, f"{base}/reduced", ["doc_id", "reduced"])
        sinks.write_parameters(self.points.sparkSession, self.parameters(), f"{base}/parameters")


def run(
    spark: SparkSession,
    path: str,
    text_column: str = "text",
    key: str = "doc_id",
    max_documents: int | None = None,
    output: str | None = None,
    fmt: str | None = None,
    encoder: Callable | str = "hash",
    **settings,
) -> ThemeModel:
    """Load, fit and save one run; the output folder is stamped with the start time."""
    started = datetime.now(timezone.utc)
    table = load_documents(spark, path, fmt).withColumnRenamed(key, "doc_id")
    docs = limit_documents(spread(pick_text(table, text_column)), max_documents)
    settings["embedding"] = {"encoder": encoder, **settings.get("embedding", {})}
    model = ThemeModel(**settings).fit(docs)
    model.save(output or f"{shared_dir(spark)}/runs/run_{sinks.run_stamp(started)}")
    return model
