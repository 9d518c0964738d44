"""Counting terms and weighting them per topic.

The topic x term matrix is a long table ``<topic, term, ...>``; it is never pivoted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from themeloom.functions.text import drop_stop_words, ngrams, stop_words, tokens
from themeloom.operators.selection import assigned
from themeloom.session import cut_lineage

#: Words whose n-grams are counted together before the shuffle, about; one document at least.
CHUNK_WORDS = 1 << 20


def explode_terms(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id", "topic"),
    stop: tuple[str, ...] | None = None,
    ngram_range: tuple[int, int] = (1, 1),
    outer: bool = False,
) -> DataFrame:
    """One row per term occurrence, with the ``keep`` columns beside it.

    ``outer`` keeps a row with a null term for documents that have none.
    """
    words = drop_stop_words(tokens(text), stop_words() if stop is None else stop)
    held = docs.select(*keep, words.alias("_words"))
    terms = ngrams(F.col("_words"), *ngram_range)
    return held.select(*keep, (F.explode_outer if outer else F.explode)(terms).alias("term"))


def remove_listed_terms(terms: DataFrame, listed: DataFrame, column: str = "term") -> DataFrame:
    """Stop-word removal against a table of any size."""
    return terms.join(listed.select(column).distinct(), column, "left_anti")


def gather_topic_text(docs: DataFrame, topic: str = "topic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts of each topic's documents: one row each (a topic may hold a third of the table), in no order."""
    return assigned(docs, topic).select(topic, key, text)


def count_terms(
    docs: DataFrame,
    text: str = "text",
    topic: str = "topic",
    stop: tuple[str, ...] | None = None,
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """``<topic, term, n>``. A topic without words keeps one row with a null term and n = 0."""
    if ngram_range[1] > 1:
        return _count_ngrams(docs, text, topic, stop, ngram_range)
    terms = explode_terms(assigned(docs, topic), text, (topic,), stop, ngram_range, outer=True)
    return terms.groupBy(topic, "term").agg(F.count("term").alias("n"))


def ngram_table(topics: pa.DictionaryArray, words: pa.ListArray, low: int, high: int) -> pa.RecordBatch:
    """``topic, term, n`` of some documents, given the topic and the words of each; a null term with n = 0 for those without one.

    Words and topics are numbers here, and only distinct n-grams are spelt out.
    """
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    word, spelt = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    home = topics.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # words from each place to the end of its document
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))
    none = np.unique(home[size < low])
    found = [(none, pa.nulls(len(none), spelt.type), np.zeros(len(none), np.int64))]
    topic_of = np.repeat(home, size)
    code = topic_of.copy()
    for length in range(1, high + 1):
        at = np.flatnonzero(left >= length)
        # a topic's n-gram is the one that is shorter by a word, and the next word
        _, first, code[at], n = np.unique(code[at] * max(1, len(spelt)) + word[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
        if length >= low:
            start = at[first]
            parts = [spelt.take(pa.array(word[start + k])) for k in range(length)]
            found.append((topic_of[start], pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0], n))
    topic, term, n = zip(*found)
    columns = [topics.dictionary.take(pa.array(np.concatenate(topic))), pa.concat_arrays(term), pa.array(np.concatenate(n), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["topic", "term", "n"])


def _count_ngrams(docs: DataFrame, text: str, topic: str, stop: tuple[str, ...] | None, ngram_range: tuple[int, int]) -> DataFrame:
    """``count_terms`` where most terms are n-grams that occur once: counting them before the shuffle in a table of all terms
    that a task has seen costs more than it saves, so they are counted over about CHUNK_WORDS words at a time, which is
    enough for a frequent one to come as one row for each of these."""
    low, high = ngram_range
    if low < 1 or high < low:
        raise ValueError(f"bad n-gram range: ({low}, {high})")
    words = drop_stop_words(tokens(text), stop_words() if stop is None else stop)
    held = assigned(docs, topic).select(topic, words.alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, lists = pc.dictionary_encode(batch.column(0), null_encoding="encode"), batch.column(1)
            upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                done = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, done + CHUNK_WORDS, "right")))
                table = ngram_table(topics.slice(first, last - first), lists.slice(first, last - first), low, high)
                yield table.rename_columns([topic, "term", "n"])
                first = last

    schema = StructType([held.schema[topic], StructField("term", StringType()), StructField("n", LongType())])
    counts = held.mapInArrow(count, schema)
    # dealt out before they are added up, so no task adds up twice
    return counts.repartition(topic, "term").groupBy(topic, "term").agg(F.sum("n").alias("n"))


def counted_terms(
    docs: DataFrame,
    text: str = "text",
    topic: str = "topic",
    stop: tuple[str, ...] | None = None,
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """``count_terms`` as a stored table: every weight derives from counts, so texts are read and
    split once, whatever follows."""
    return cut_lineage(count_terms(docs, text, topic, stop, ngram_range))


def topic_totals(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """``<topic, words>``; a topic without words counts as one word."""
    return counts.groupBy(topic).agg(F.greatest(F.sum("n"), F.lit(1)).alias("words"))


def mean_topic_words(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """One row: the average of words per topic."""
    return topic_totals(counts, topic).agg(F.avg("words").alias("mean_words"))


def term_frequency(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds ``tf``, the share of the topic's words."""
    totals = topic_totals(counts, topic)
    return (
        counts.filter(F.col("term").isNotNull())
        .join(totals, topic)
        .select(topic, "term", "n", (F.col("n") / F.col("words")).alias("tf"))
    )


def topic_document_frequency(counts: DataFrame) -> DataFrame:
    """``<term, df>``: the number of topics a term occurs in."""
    return counts.filter(F.col("n") > 0).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def ctfidf(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """``<topic, term, n, tf, df, score>`` with ``score = tf * ln(1 + A / df)``.

    ``df`` is a window over the counted table: its groups hold at most one row per topic.
    """
    mean = mean_topic_words(counts, topic).scalar()
    return (
        term_frequency(counts, topic)
        .withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
        .withColumn("score", F.col("tf") * F.log(F.lit(1.0) + mean / F.col("df")))
    )


def bm25(
    weights: DataFrame,
    k1: float = 1.5,
    b: float = 0.75,
    topic: str = "topic",
    value: str = "score",
    topics: DataFrame | None = None,
) -> DataFrame:
    """BM25 over a topic x term weight table: ``<topic, term, bm25>``.

    ``topics`` lists all topics when some may have no term; they count in N and in the mean
    length.
    """
    cells = weights.select(topic, "term", F.col(value).cast("double").alias("x")).filter(F.col("x") != 0)
    lengths = cells.groupBy(topic).agg(F.sum("x").alias("dl"))
    if topics is None:
        topics = weights.select(topic).distinct()
    shape = (
        topics.select(topic).distinct().join(lengths, topic, "left")
        .agg(F.count(F.lit(1)).alias("n_topics"), F.avg(F.coalesce("dl", F.lit(0.0))).alias("avgdl"))
    )
    n_topics = shape.select("n_topics").scalar()
    avgdl = shape.select("avgdl").scalar()
    length_part = F.when(F.col("avgdl") != 0, F.col("dl") / F.col("avgdl"))
    bottom = F.col("x") + k1 * (1.0 - b + b * length_part)
    safe = F.when(bottom == 0, F.lit(1e-12)).otherwise(bottom)
    rarity = F.log((F.col("n_topics") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return (
        cells.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
        .join(lengths, topic)
        .withColumns({"n_topics": n_topics, "avgdl": avgdl})
        .select(topic, "term", F.coalesce(rarity * F.col("x") * (k1 + 1.0) / safe, F.lit(0.0)).alias("bm25"))
    )


def vocabulary(counts: DataFrame) -> DataFrame:
    """Sorted distinct terms."""
    return counts.filter(F.col("term").isNotNull()).select("term").distinct().orderBy("term")


def top_words(scores: DataFrame, count: int = 10, topic: str = "topic", value: str = "score") -> DataFrame:
    """``<topic, rank, word, score>``: best terms per topic, ties by term; zero scores never rank."""
    order = Window.partitionBy(topic).orderBy(F.desc("score"), F.asc("word"))
    return (
        scores.select(topic, F.col("term").alias("word"), F.col(value).alias("score"))
        .filter(F.col("score") > 0)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= count)
        .select(topic, "rank", "word", "score")
    )


def nest_words(ranked: DataFrame, topic: str = "topic") -> DataFrame:
    """``<topic, words array<struct<word, score>>>``, best first (lists are as short as the ranking)."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "word", "score")))
    return ranked.groupBy(topic).agg(
        F.transform(listed, lambda w: F.struct(w["word"].alias("word"), w["score"].alias("score"))).alias("words")
    )


def words_only(nested: DataFrame, topic: str = "topic") -> DataFrame:
    """``<topic, words array<string>>``."""
    return nested.select(topic, F.transform("words", lambda w: w["word"]).alias("words"))


def weigh_terms(
    docs: DataFrame,
    text: str = "text",
    topic: str = "topic",
    ngram_range: tuple[int, int] = (1, 1),
    use_bm25: bool = False,
    bm25_k1: float = 1.5,
    bm25_b: float = 0.75,
    stop: tuple[str, ...] | None = None,
) -> DataFrame:
    """``<topic, term, score>`` under the chosen weighting."""
    counts = counted_terms(docs, text, topic, stop, ngram_range)
    scores = ctfidf(counts, topic)
    if not use_bm25:
        return scores.select(topic, "term", "score")
    topics = counts.select(topic).distinct()
    return bm25(scores, bm25_k1, bm25_b, topic, "score", topics).withColumnRenamed("bm25", "score")
