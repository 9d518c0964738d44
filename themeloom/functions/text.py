"""Column expressions over text. All stay in the JVM."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of two or more letters, digits or underscores.
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"
# White space as Unicode defines it (Java's \s alone is ASCII).
SPACE_CLASS = r"\s\p{Z}\x1c-\x1f\x85"
CHUNK_PATTERN = "([^" + SPACE_CLASS + "]+)"


@lru_cache(maxsize=None)
def stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark's stop-word list for a language.

    The English one lies beside this file (fixed values), so that it needs neither a session nor Spark's jars.
    """
    if language == "english":
        return tuple((Path(__file__).parent / "english_stop_words.txt").read_text().split())
    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def tokens(text: Column | str) -> Column:
    """Lower-cased words of at least two characters, in order."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_PATTERN), F.lit(1))


def drop_stop_words(words: Column, stop: tuple[str, ...] | list[str] | None) -> Column:
    """Array without stop words; repeats are kept (``isin`` compiles to one hash lookup)."""
    if not stop:
        return words
    listed = list(stop)
    return F.filter(words, lambda w: ~w.isin(listed))


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """Word n-grams for every length in ``low..high``, never crossing a document."""
    if low < 1 or high < low:
        raise ValueError(f"bad n-gram range: ({low}, {high})")

    def of_length(n: int) -> Column:
        if n == 1:
            return words
        room = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.slice(words, 1, room)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(words, k + 1, room), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    sizes = [of_length(n) for n in range(low, high + 1)]
    return sizes[0] if len(sizes) == 1 else F.concat(*sizes)


def word_count(text: Column) -> Column:
    """Number of white-space separated chunks."""
    return F.size(F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(1)))


def clip(text: Column, width: int) -> Column:
    """Cut to ``width`` characters, marking a cut with an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def snippet(text: Column, width: int = 120) -> Column:
    """One-line preview: white space collapsed, null as empty, cut to ``width``."""
    flat = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[" + SPACE_CLASS + "]+", " "))
    return clip(flat, width)


def first_words(text: Column, count: int) -> Column:
    """The first ``count`` white-space separated chunks (an encoder's length limit)."""
    chunks = F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(1))
    return F.when(F.size(chunks) > count, F.array_join(F.slice(chunks, 1, count), " ")).otherwise(text)
