"""Quality classifier: nearest-neighbour voting over latent-semantic vectors of labelled documents.

A document becomes two blocks of terms: its words, hashed to BINS numbers, and its form, which is pairs of neighbouring
character classes and a few counts over the words. Each block is weighed by TF-IDF and brought to a fixed length. A singular value
decomposition of a bounded labelled sample gives latent vectors. The sample's vectors go to every task; each document is
compared with all of them by exact cosine in blocks, and its nearest neighbours vote with the weight of their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import hold_out, python_ready, read

#: Labelled documents of each label that the model is fitted on at most: those of the lowest hash of their id.
SAMPLE = 2000
#: Latent dimensions, neighbours that vote, and the power of a similarity that weighs a vote.
LATENT, NEIGHBOURS, POWER = 48, 15, 4

#: Character classes: 0 other ASCII, 1 small, 2 capital, 3 digit, 4 blank, 5 line end, 6 byte of another alphabet; each
#: of the marks below is a class of its own.
MARKS = b"#*$%&|<>!?.,;:-'\"()/@_=+"
CLASSES = 7 + len(MARKS)
#: Counts over words: words, word equal to the one before, word equal to the one before that, capital words,
#: words with a mark at their end, and one term for each power of two of the number of words.
WORD_TERMS, SIZES, WORD_WEIGHT = 4, 24, 6
FORM = CLASSES * CLASSES + WORD_TERMS + SIZES
#: Hashed words, and how many bins a worker remembers.
BINS, REMEMBERED = 1024, 200_000
#: How much the words count beside the form.
WORDS_SHARE = 0.3
TERMS = FORM + BINS
#: Rows of counts that are weighed at a time.
ROWS = 256
#: Partitions of the labelled rows, which come to the driver one at a time.
PARTS = 8


def class_table() -> np.ndarray:
    out = np.zeros(256, np.intp)
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[32, 9]] = 4
    out[[10, 11, 12, 13]] = 5
    out[128:] = 6
    out[list(MARKS)] = 7 + np.arange(len(MARKS))
    return out


def terms(text: bytes) -> np.ndarray:
    """Counts of all terms of a whole text."""
    out = np.zeros(TERMS)
    pairs = CLASSES * CLASSES
    if len(text) > 1:
        kinds = class_table_held()[np.frombuffer(text, np.uint8)]
        out[:pairs] = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=pairs)
    words = text.split()
    out[pairs] = sum(map(bytes.__eq__, words, words[1:]))
    out[pairs + 1] = sum(map(bytes.__eq__, words, words[2:]))
    out[pairs + 2] = sum(map(bytes.isupper, words))
    out[pairs + 3] = len(words) - len(set(words))
    # a document's size is one term as heavy as a tenth of its words
    out[pairs + WORD_TERMS + min(SIZES - 1, len(words).bit_length())] = 1 + len(words) / 10
    if len(_BINS) > REMEMBERED:
        _BINS.clear()
    cut = text.lower().translate(_LETTERS).split()
    out[FORM:] = np.bincount(np.fromiter(map(_BINS.__getitem__, cut), np.int64, len(cut)), minlength=BINS)
    return out


class _Bins(dict):
    """The bin of each word met."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = zlib.crc32(word) % BINS
        return at


#: All but letters, digits and bytes of other alphabets part words.
_LETTERS = bytes(b if b > 0x7F or chr(b).isalnum() else 32 for b in range(256))
_BINS = _Bins()
_TABLE: list[np.ndarray] = []


def class_table_held() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(class_table())
    return _TABLE[0]


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF, the form of length one and the words of WORDS_SHARE; a block without terms stays zero."""
    return weigh(np.array(counts, np.float64), idf)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """``weighed`` in place, some rows at a time, so that no second table of this size is made."""
    for low in range(0, len(x), ROWS):
        part = x[low : low + ROWS]
        np.log1p(part, out=part)
        part *= idf
        for block in (slice(0, FORM), slice(FORM, TERMS)):
            part[:, block] /= np.maximum(np.linalg.norm(part[:, block], axis=1), 1e-12)[:, None]
        part[:, FORM:] *= WORDS_SHARE
    return x


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return self.placed(weighed(counts, self.idf))

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Latent vectors of weighed rows."""
        z = x @ self.axes
        return (z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours' votes, 0 to 1; the prior where nothing is similar."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** POWER
        total = weight.sum(1)
        votes = (weight * self.labels[at]).sum(1)
        return np.where(total > 0, votes / np.maximum(total, 1e-300), self.prior).clip(0, 1)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Latent vectors of labelled documents; without any, a model that answers one half. ``counts`` (doubles) are weighed in place."""
    if not len(labels):
        return Model(np.ones(TERMS), np.zeros((TERMS, 0)), np.zeros((0, 0), np.float32), labels, 0.5)
    met = sum((counts[low : low + ROWS] > 0).sum(0) for low in range(0, len(counts), ROWS))
    idf = np.log((1 + len(labels)) / (1 + met)) + 1
    # one repeated word tells as much as many pairs of letters
    idf[CLASSES * CLASSES : CLASSES * CLASSES + 2] *= WORD_WEIGHT
    x = weigh(counts, idf)
    # a copy of the axes alone, not a view that keeps all vectors
    axes = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(LATENT, len(labels))])
    model = Model(idf, axes, np.zeros((0, 0)), labels, float(labels.mean()))
    model.vectors = model.placed(x)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> Model:
    """Fit on at most SAMPLE documents of each label, never on those whose crc32(id) mod 3 is 1.

    Rows of ``labels`` with nulls or values other than 0 and 1 are left out; repeated ones count once. A
    document with both labels votes for both. The driver holds 2 * SAMPLE rows of counts at most.
    """
    python_ready(docs)
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (hold_out("doc_id", 3) != 1)).distinct()
    # only ids that have a document
    there = docs.select(F.col(key).cast("long").alias("doc_id")).distinct()
    known = known.join(there, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(SAMPLE).union(known.filter("label = 1").orderBy(*order).limit(SAMPLE))
    label_of: dict[int, list[int]] = {}
    for r in chosen.collect():
        label_of.setdefault(r.doc_id, []).append(r.label)
    picked = docs.sparkSession.createDataFrame([(d,) for d in label_of], "doc_id long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.quality_classifier import terms

        for batch in batches:
            found = [terms(t or b"").astype("<f4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "counts"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    # at most 2 * SAMPLE ids
    rows = rows.join(F.broadcast(picked), "doc_id").mapInArrow(count, "doc_id long, counts binary")
    # repeated rows of an id count once
    rows = rows.groupBy("doc_id").agg(F.min("counts").alias("counts"))
    # a row for each label of an id, by id; rows come a partition at a time and are kept nowhere else
    place, kept = {}, []
    for d in sorted(label_of):
        place[d] = len(kept)
        kept += [(d, y) for y in sorted(label_of[d])]
    counts, seen = np.zeros((len(kept), TERMS)), np.zeros(len(kept), bool)
    for r in rows.coalesce(PARTS).toLocalIterator():
        at = slice(place[r.doc_id], place[r.doc_id] + len(label_of[r.doc_id]))
        counts[at], seen[at] = np.frombuffer(r.counts, "<f4"), True
    labels_of_rows = np.array([y for _, y in kept], float)
    return fit(counts, labels_of_rows) if seen.all() else fit(counts[seen], labels_of_rows[seen])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, and ``score``: the share of label 1 in the votes.

    Null texts count as empty; an empty text is scored like any other. Repeated rows are rows of their own; an
    empty table gives no rows.
    """
    python_ready(docs)
    parts = (model.idf, model.axes, model.vectors, model.labels, model.prior)

    @F.pandas_udf("double")
    def vote(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from themeloom.llm.quality_classifier import Model, terms

        held = Model(*parts)
        for batch in texts:
            out = []
            for low in range(0, len(batch), 512):
                counts = np.array([terms(t or b"") for t in batch.iloc[low : low + 512]])
                out.append(held.score(counts))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.select(F.struct("*").alias("row"), vote(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("score"))


def op7_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = score(docs.select("doc_id", "text"), train(docs, labels)).select(F.col("row.doc_id").alias("doc_id"), "score")
    return rows.select(
        "doc_id",
        F.coalesce(hold_out("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
