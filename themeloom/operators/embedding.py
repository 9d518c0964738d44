"""From text to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from themeloom.functions.text import first_words, tokens
from themeloom.functions.vectors import as_doubles, normalize

WIDTH = 64
#: Words that are turned into vectors at once.
SLICE = 262_144


class _WordVectors:
    """Signed sums of the character 3-grams of words. Grams are few beside words: each is hashed once per task."""

    def __init__(self, width: int, limit: int = 200_000):
        self.width, self.gram = width, lru_cache(limit)(lambda gram: _placed(gram, width))

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        if not words:
            return np.zeros((0, self.width))
        size = np.fromiter(map(len, words), np.int64, len(words))
        # a word between its angle brackets has as many grams as letters
        letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(word)) + 2 * word
        grams, which = np.unique((letters[at] << 42) | (letters[at + 1] << 21) | letters[at + 2], return_inverse=True)
        low = (1 << 21) - 1
        held = np.array([self.gram(chr(g >> 42) + chr((g >> 21) & low) + chr(g & low)) for g in grams.tolist()], np.int64).reshape(-1, 2)[which]
        return np.bincount(word * self.width + held[:, 0], held[:, 1], len(words) * self.width).reshape(-1, self.width)


def _placed(gram: str, width: int) -> tuple[int, int]:
    bits = int(md5(gram.encode()).hexdigest()[:8], 16)
    return bits % width, 1 if (bits >> 16) % 2 == 0 else -1


def hash_vectors(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, out: str = "embedding"
) -> DataFrame:
    """``<key, out>``: unit vectors by signed feature hashing of character 3-grams.

    A document is the sum of its words' grams between angle brackets, so its vector depends on its own row
    only: one pass without a shuffle. Words are cut in the JVM.
    """
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordVectors(width)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            sums = np.zeros((len(batch), width))
            # a slice of words at a time: what is held does not follow the length of the texts
            for low in range(0, len(flat), SLICE):
                parts = flat.slice(low, SLICE).dictionary_encode()
                matrix, at = words.of(parts.dictionary.to_pylist()), parts.indices.to_numpy()
                first, last = np.searchsorted(ends, [low, low + len(at) - 1], side="right")
                for row in range(first, last + 1):
                    start = max(ends[row - 1] if row else 0, low) - low
                    end = min(ends[row] - low, len(at))
                    for i in range(start, end, 10_000):
                        sums[row] += matrix[at[i : min(end, i + 10_000)]].sum(0)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * width, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, out])

    summed = df.select(key, tokens(text).alias("_w")).mapInArrow(work, f"`{key}` {kind}, `{out}` array<double>")
    return summed.select(key, normalize(F.col(out)).alias(out))


def encode(
    df: DataFrame,
    make_encoder: Callable[[], Callable],
    key: str = "doc_id",
    text: str = "text",
    out: str = "embedding",
    batch_size: int = 8,
    unit: bool = True,
) -> DataFrame:
    """``<key, out>`` by an outside model.

    ``make_encoder`` runs once per worker (load the model there) and returns a function from a
    batch of strings to a matrix of floats.
    """
    run = predict_batch_udf(make_encoder, return_type=ArrayType(FloatType()), batch_size=batch_size)
    vectors = df.select(key, run(F.col(text)).alias(out))
    return vectors.withColumn(out, normalize(as_doubles(F.col(out)))) if unit else vectors


def embed(
    df: DataFrame,
    encoder: Callable[[], Callable] | str = "hash",
    key: str = "doc_id",
    text: str = "text",
    out: str = "embedding",
    batch_size: int = 8,
    width: int = WIDTH,
    max_words: int | None = None,
) -> DataFrame:
    """``<key, out>`` by the built-in ``"hash"`` encoder or a model factory.

    ``max_words`` is an encoder's own length limit; texts are whole unless it is given.
    """
    if not encoder:
        raise ValueError("an encoder is required")
    held = df.withColumn(text, first_words(F.col(text), max_words)) if max_words else df
    if encoder == "hash":
        return hash_vectors(held, key, text, width, out)
    if isinstance(encoder, str):
        raise ValueError(f"Unknown encoder: {encoder}. Use 'hash' or pass a model factory")
    return encode(held, encoder, key, text, out, batch_size)


def embed_terms(
    terms: DataFrame, encoder: Callable[[], Callable] | str = "hash", term: str = "term", out: str = "vector", **options
) -> DataFrame:
    """``<term, out>``: every distinct term encoded once."""
    distinct = terms.select(F.col(term).alias("term")).distinct().withColumn("_text", F.col("term"))
    return embed(distinct, encoder, "term", "_text", out, **options)
