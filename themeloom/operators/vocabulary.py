"""A bounded vocabulary: the most frequent terms of any table, exactly, in memory that does not grow with it.

Each task keeps a summary of at most ``capacity`` terms (Misra and Gries): a term that does not fit lowers all counts. Summaries
merge in any order; the joined one misses no term that occurs more often than ``rows / (capacity + 1)``. A second pass counts its
terms exactly. If the last term asked for is not above that bound, the capacity doubles and both passes run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from themeloom.functions.text import drop_stop_words, ngrams, stop_words, tokens
from themeloom.operators.weighting import explode_terms
from themeloom.session import cut_lineage

#: Terms in a summary at first; a task holds at most twice as many of them, and READ_AHEAD values.
CAPACITY = 20_000
#: Values that a task reads before it merges them into its summary.
READ_AHEAD = 500_000
#: Summaries of tasks meet in so many groups first.
GROUPS = 64


def shrink(terms: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``capacity`` terms: the count of the largest one left out is taken from all. Also that count."""
    if len(terms) <= capacity:
        return terms, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    keep = counts > cut
    return terms[keep], counts[keep] - cut, cut


def merged(parts: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Summaries added term by term, then shrunk."""
    terms = np.concatenate([t for t, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    found, at = np.unique(terms, return_inverse=True)
    return shrink(found, np.bincount(at, counts).astype(np.int64), capacity)


def sketch(terms: DataFrame, capacity: int, column: str = "term") -> DataFrame:
    """``<term, low, taken>``: one summary of the whole column: counts that are too low by at most the sum of ``taken``.

    The column holds terms, or lists of terms, which cost less to hand over.
    """

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, taken = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
        waiting, size = [], 0

        def take() -> None:
            nonlocal held, taken
            found = pc.value_counts(pa.chunked_array(waiting, pa.string()))
            part = pa.table({"term": found.field("values"), "n": found.field("counts")})
            both = pa.concat_tables([held, part]).group_by("term").aggregate([("n", "sum")])
            # places instead of the terms themselves, which stay where they are
            at, counts, cut = shrink(np.arange(len(both)), both.column("n_sum").to_numpy(), capacity)
            held = pa.table({"term": both.column("term").take(pa.array(at)), "n": pa.array(counts, pa.int64())})
            taken += cut

        for batch in batches:
            column = (batch.column(0).flatten() if listed else batch.column(0)).drop_null()
            if len(column):
                waiting.append(column)
                size += len(column)
            if size >= READ_AHEAD:
                take()
                waiting, size = [], 0
        if waiting:
            take()
        # an empty term carries what was taken from all
        names = pa.concat_arrays([*held.column("term").chunks, pa.nulls(1, pa.string())])
        low = pa.concat_arrays([*held.column("n").chunks, pa.array([taken], pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), TaskContext.get().partitionId() % GROUPS, np.int32)), names, low], names=["g", "term", "low"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = int(pdf.loc[pdf["term"].isna(), "low"].sum())
        real = pdf[pdf["term"].notna()]
        terms, counts, cut = merged([(real["term"].to_numpy(object), real["low"].to_numpy())], capacity)
        return pd.DataFrame({"g": 0, "term": [*terms, None], "low": [*counts, taken + cut]})

    listed = isinstance(terms.schema[column].dataType, ArrayType)
    parts = terms.select(F.col(column).cast("array<string>" if listed else "string").alias("term")).mapInArrow(summarize, "g int, term string, low long")
    joined = parts.groupBy("g").applyInPandas(join, "g int, term string, low long")
    return cut_lineage(joined.groupBy("g").applyInPandas(join, "g int, term string, low long").select("term", "low"))


def frequent_terms(terms: DataFrame, count: int, column: str = "term", capacity: int = CAPACITY, lists: DataFrame | None = None) -> DataFrame:
    """``<term, n>``: the ``count`` most frequent values of a column with their exact counts, ties by the value; nulls do not count.

    ``terms`` is read once to summarize and once to count, and again with twice the capacity while the summary cannot prove
    that it holds them all. ``lists`` holds the same values as lists, for the summary.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    capacity = max(capacity, 2 * count)
    while True:
        found = sketch(terms if lists is None else lists, capacity, column)
        taken = found.filter("term IS NULL").agg(F.sum("low")).first()[0] or 0
        # at most `capacity` terms
        listed = F.broadcast(found.filter("term IS NOT NULL").select(F.col("term").alias(column)))
        exact = cut_lineage(terms.filter(F.col(column).isNotNull()).join(listed, column, "left_semi").groupBy(column).agg(F.count(F.lit(1)).alias("n")))
        top = exact.orderBy(F.desc("n"), column).limit(count)
        last = top.agg(F.min("n"), F.count(F.lit(1))).first()
        # a value that is missing occurs no more often than what was taken
        if taken == 0 or (last[1] == count and last[0] > taken):
            return top.select(F.col(column).alias("term"), "n")
        capacity *= 2


def bounded_vocabulary(
    docs: DataFrame, count: int, text: str = "text", stop: tuple[str, ...] | None = None, ngram_range: tuple[int, int] = (1, 1), capacity: int = CAPACITY
) -> DataFrame:
    """``<term, n>``: the ``count`` most frequent terms of all texts."""
    words = docs.select(drop_stop_words(tokens(text), stop_words() if stop is None else stop).alias("_words"))
    lists = words.select(ngrams(F.col("_words"), *ngram_range).alias("term"))
    return frequent_terms(explode_terms(docs, text, (), stop, ngram_range), count, "term", capacity, lists)
