"""Latent topics by variational inference (LDA), in batches over the whole table.

Documents are counts over a bounded vocabulary, stored once. In a round each task fits its documents' topic shares against the
current topics and sends one sum a term and topic; the sums are the next topics. The bound on the likelihood is worked out
in the same pass and rises from round to round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import drop_stop_words, stop_words, tokens
from themeloom.operators.vocabulary import bounded_vocabulary
from themeloom.session import cut_lineage

#: Terms times topics, at most: every task holds one number for each (16 MB).
MOST_NUMBERS = 2_000_000
#: A document's shares rest when they change by less than this on average; steps at most.
REST, STEPS = 1e-4, 200


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the logarithm of the gamma function, for positive numbers."""
    x = np.asarray(x, np.float64)
    # moved up by six, where the series holds
    out = -(1 / x + 1 / (x + 1) + 1 / (x + 2) + 1 / (x + 3) + 1 / (x + 4) + 1 / (x + 5))
    x = x + 6
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, for positive numbers."""
    x = np.asarray(x, np.float64)
    # moved up by eight, where the series holds
    out = -np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    x = x + 8
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def document_terms(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text", stop: tuple[str, ...] | None = None) -> DataFrame:
    """``<key, terms array<int>, counts array<double>>`` over places in the vocabulary; documents without any of them have empty arrays.

    Rows that repeat a key are one document.
    """
    words = drop_stop_words(tokens(text), stop_words() if stop is None else stop)
    kind, listed, width = docs.schema[key].dataType.simpleString(), pa.array(vocabulary, pa.string()), len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.index_in(lists.flatten(), value_set=listed)
            known = pc.is_valid(found).to_numpy(zero_copy_only=False)
            place = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cells, n = np.unique((np.repeat(np.arange(len(size)), size) * width + place)[known], return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(cells // width, minlength=len(size)))], pa.int32())
            arrays = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cells % width).astype(np.int32), n.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "terms", "counts"])

    rows = cut_lineage(docs.select(key, words.alias("words")).mapInArrow(count, f"`{key}` {kind}, terms array<int>, counts array<double>"))
    more = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).select(key))
    if not more.head(1):
        return rows
    # a document holds each term of the vocabulary once at most
    cells = rows.join(more, key).select(key, F.explode(F.arrays_zip("terms", "counts")).alias("c"))
    cells = cells.groupBy(key, F.col("c.terms").alias("place")).agg(F.sum("c.counts").alias("n"))
    lists = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("cells"))
    place, n = F.transform("cells", lambda c: c["place"]), F.transform("cells", lambda c: c["n"])
    joined = more.join(lists, key, "left").select(
        key, F.coalesce(place, F.array().cast("array<int>")).alias("terms"), F.coalesce(n, F.array().cast("array<double>")).alias("counts")
    )
    return cut_lineage(rows.filter(F.col(key).isNotNull()).join(more, key, "left_anti").unionByName(joined))


#: Cells that are fitted together, about: what a step touches stays in a core's cache.
FIT_CELLS = 1 << 14


def _fit_some(weights: np.ndarray, counts: np.ndarray, sizes: np.ndarray, gamma: np.ndarray, alpha: float) -> np.ndarray:
    """The shares of documents that all have cells; ``weights`` and ``gamma`` have a row for each topic."""
    out, at = gamma.copy(), np.arange(len(sizes))
    shares = np.exp(digamma(gamma) - digamma(gamma.sum(0)))
    live = np.ones(len(sizes), bool)
    for _ in range(STEPS):
        norm = np.full(len(counts), 1e-300)
        for w, s in zip(weights, shares):
            norm += w * np.repeat(s, sizes)
        ratio, starts = counts / norm, np.r_[0, np.cumsum(sizes)[:-1]]
        new = alpha + shares * np.array([np.add.reduceat(w * ratio, starts) for w in weights])
        # documents at rest leave; the others go on
        change = np.abs(new - gamma).mean(0)
        out[:, at[live]] = new[:, live]
        live &= change >= REST * np.maximum(1.0, new.mean(0))
        if not live.any():
            break
        gamma, shares = new, np.exp(digamma(new) - digamma(new.sum(0)))
        if live.mean() < 0.75:
            kept = np.repeat(live, sizes)
            weights, counts = weights[:, kept], counts[kept]
            sizes, at, gamma, shares, live = sizes[live], at[live], gamma[:, live], shares[:, live], np.ones(int(live.sum()), bool)
    return out


def fit_shares(terms: np.ndarray, counts: np.ndarray, doc: np.ndarray, gamma: np.ndarray, topic_logs: np.ndarray, alpha: float):
    """Fits the shares ``gamma`` (a row a document) of many documents at once; cells are sorted by ``doc``.

    Returns the shares, the topics' part of every cell, and the documents' part of the bound.
    """
    weights = np.ascontiguousarray(np.exp(topic_logs).T)[:, terms]
    has, sizes = np.unique(doc, return_counts=True)
    without = np.ones(len(gamma), bool)
    without[has] = False
    gamma[without] = alpha
    ends = np.cumsum(sizes)
    logs, norm, parts = np.empty(gamma.shape), np.empty(len(counts)), np.empty(weights.shape)
    logs[without] = digamma(gamma[without]) - digamma(gamma[without].sum(1))[:, None]
    first = 0
    while first < len(has):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + FIT_CELLS, "right")))
        cells, docs, n = slice(done, ends[last - 1]), has[first:last], sizes[first:last]
        gamma[docs] = _fit_some(weights[:, cells], counts[cells], n, gamma[docs].T, alpha).T
        logs[docs] = digamma(gamma[docs]) - digamma(gamma[docs].sum(1))[:, None]
        held = weights[:, cells] * np.repeat(np.exp(logs[docs]).T, n, axis=1)
        norm[cells] = held.sum(0) + 1e-300
        parts[:, cells] = held * (counts[cells] / norm[cells])
        first = last
    parts = parts.T
    k = gamma.shape[1]
    bound = float((counts * np.log(norm)).sum())
    bound += float(((alpha - gamma) * logs).sum() + log_gamma(gamma).sum() - log_gamma(gamma.sum(1)).sum())
    bound += len(gamma) * float(log_gamma(np.array([k * alpha]))[0] - k * log_gamma(np.array([alpha]))[0])
    return gamma, parts, bound


@dataclass
class TopicModel:
    """``topics``: a row for each topic, a column for each term of ``vocabulary``; ``bounds`` after each round."""

    vocabulary: list[str]
    topics: np.ndarray
    alpha: float
    eta: float
    bounds: list[float]
    shares: DataFrame

    def words(self, count: int = 10) -> DataFrame:
        """``<topic, rank, word, score>``: each topic's terms of largest share, ties by the term."""
        share = self.topics / self.topics.sum(1, keepdims=True)
        rows = []
        for t, row in enumerate(share):
            best = sorted(range(len(row)), key=lambda i: (-row[i], self.vocabulary[i]))[:count]
            rows += [(t, r, self.vocabulary[i], float(row[i])) for r, i in enumerate(best, 1)]
        return self.shares.sparkSession.createDataFrame(rows, "topic int, rank int, word string, score double")

    def document_topics(self, key: str = "doc_id") -> DataFrame:
        """``<key, topic, share>``: the topic of the largest share, ties by the smallest."""
        best = F.array_max("shares")
        return self.shares.select(key, (F.array_position("shares", best) - 1).cast("int").alias("topic"), best.alias("share"))


def _round(docs: DataFrame, key: str, topics: np.ndarray, alpha: float, first: bool) -> DataFrame:
    """``<key, gamma>`` of all documents, ``<place, sums>`` of all terms and the bound, in one pass: rows of one table."""
    k, width = topics.shape
    logs = (digamma(topics) - digamma(topics.sum(1))[:, None]).T

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "terms", "counts", "gamma", "place", "sums", "bound"]
        sums, total, seen = np.zeros((width, k)), 0.0, False
        for batch in batches:
            if not len(batch):
                continue
            seen = True
            terms = batch.column("terms").flatten().to_numpy().astype(np.int64)
            counts = batch.column("counts").flatten().to_numpy()
            doc = np.repeat(np.arange(len(batch)), np.diff(batch.column("terms").offsets.to_numpy()))
            start = np.ones((len(batch), k)) if first else batch.column("gamma").flatten().to_numpy().reshape(-1, k).copy()
            gamma, parts, bound = fit_shares(terms, counts, doc, start, logs, alpha)
            for j in range(k):
                sums[:, j] += np.bincount(terms, parts[:, j], width)
            total += bound
            n = len(batch)
            made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(gamma.ravel()))
            empty = pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("terms"), batch.column("counts"), made, *empty], names=names)
        if seen:
            used = np.flatnonzero(sums.any(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * k), pa.array(sums[used].ravel()))
            n = len(used)
            kind = docs_types
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind[0]), pa.nulls(n, kind[1]), pa.nulls(n, kind[2]), pa.nulls(n, pa.list_(pa.float64())), pa.array(used.astype(np.int32)), lists, pa.nulls(n, pa.float64())],
                names=names,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind[0]), pa.nulls(1, kind[1]), pa.nulls(1, kind[2]), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64())), pa.array([total])],
                names=names,
            )

    from pyspark.sql.pandas.types import to_arrow_schema

    kind_of = docs.schema[key].dataType.simpleString()
    docs_types = list(to_arrow_schema(docs.select(key, "terms", "counts").schema).types)
    columns = [F.col(key), "terms", "counts"] + ([] if first else ["gamma"])
    schema = f"key {kind_of}, terms array<int>, counts array<double>, gamma array<double>, place int, sums array<double>, bound double"
    return cut_lineage(docs.select(*columns).mapInArrow(work, schema))


def lda(
    docs: DataFrame,
    n_topics: int,
    n_terms: int = 2000,
    key: str = "doc_id",
    text: str = "text",
    alpha: float | None = None,
    eta: float | None = None,
    tolerance: float = 1e-3,
    most_rounds: int = 100,
    seed: int = 42,
    stop: tuple[str, ...] | None = None,
) -> TopicModel:
    """Topics over the ``n_terms`` most frequent terms of all texts.

    It ends when a round raises the bound by less than ``tolerance`` of itself. ``shares <key, shares>`` sum to one; a document
    without any of the terms has equal shares.
    """
    if n_topics < 1:
        raise ValueError("LDA needs at least one topic")
    if n_topics * n_terms > MOST_NUMBERS:
        raise ValueError(f"n_topics times n_terms may be at most {MOST_NUMBERS}")
    vocabulary = sorted(r.term for r in bounded_vocabulary(docs, n_terms, text, stop).collect())
    if not vocabulary:
        raise ValueError("the texts have no words")
    alpha, eta = alpha or 1.0 / n_topics, eta or 1.0 / n_topics
    held = document_terms(docs, vocabulary, key, text, stop)
    width = len(vocabulary)
    topics = np.random.default_rng(seed).gamma(100.0, 0.01, (n_topics, width))
    bounds: list[float] = []
    first = True
    while len(bounds) < most_rounds:
        found = _round(held, key, topics, alpha, first)
        documents = found.filter("gamma IS NOT NULL").select(F.col("key").alias(key), "terms", "counts", "gamma")
        sums = found.filter("place IS NOT NULL").groupBy("place").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(n_topics)]).collect()
        bound = found.agg(F.sum("bound")).first()[0] or 0.0
        # what the topics themselves add, under the topics that the documents were fitted to
        logs = digamma(topics) - digamma(topics.sum(1))[:, None]
        bound += float(((eta - topics) * logs).sum() + (log_gamma(topics) - log_gamma(np.array([eta]))).sum())
        bound += float((log_gamma(np.array([eta * width])) - log_gamma(topics.sum(1))).sum())
        bounds.append(bound)
        held, first = documents, False
        rested = len(bounds) > 1 and bounds[-1] - bounds[-2] < tolerance * abs(bounds[-1])
        if rested:
            break
        topics = np.full((n_topics, width), eta)
        for row in sums:
            topics[:, row.place] += row[1:]
    total = F.aggregate("gamma", F.lit(0.0), lambda acc, x: acc + x)
    shares = held.select(key, F.transform("gamma", lambda g: g / total).alias("shares"), total.alias("weight"))
    return TopicModel(vocabulary, topics, alpha, eta, bounds, shares)
