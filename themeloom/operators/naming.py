"""Readable names for topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import clip
from themeloom.functions.vectors import as_doubles, distance
from themeloom.operators.keywords import topic_centroids
from themeloom.operators.selection import assigned, sample_per_topic

# What a namer is told: what it sees, what the answer is for, its form, and what to do without enough evidence.
KEYWORD_TASK = (
    "Input: terms that set one group of texts apart, the most telling one first.\n"
    "Output: a heading under which a reader would look for this group, in the language of the terms.\n"
    "If the terms point in several directions, head the list with what the first ones share.\n"
)
DOCUMENT_TASK = (
    "Input: a few texts from the middle of one group.\n"
    "Output: a heading under which a reader would look for all of them, in their language.\n"
    "Details that only one text mentions do not belong in the heading.\n"
)
# The names of the domains.
DOMAIN_HINTS = {
    "customer_reviews": "The texts are reviews: the heading says which side of the product or service they judge.\n",
    "customer_complaints": "The texts are complaints: the heading says what went wrong.\n",
    "social_media": "The texts are posts: the heading says what is being talked about.\n",
}
GENERAL_HINT = "The texts may be of any kind.\n"
# The two keys of a reply.
REPLY_FORMAT = (
    "Write one line of JSON with the heading and the evidence for it:\n"
    '{"topic_name": "...", "reasoning": "..."}\n'
)


def instruction(domain: Column | str, documents: bool = False) -> Column:
    """Instruction text for a domain; unknown domains get the general one."""
    name = F.lower(F.trim(F.coalesce(F.lit(domain) if isinstance(domain, str) else domain, F.lit(""))))
    hint = F.lit(GENERAL_HINT)
    for known, text in DOMAIN_HINTS.items():
        hint = F.when(name == known, F.lit(text)).otherwise(hint)
    return F.concat(F.lit(DOCUMENT_TASK if documents else KEYWORD_TASK), hint)


def keyword_prompts(
    topics: DataFrame, domain: Column | str = "customer_reviews", count: int = 15, topic: str = "topic"
) -> DataFrame:
    """``<topic, words, keywords, prompt>`` from ``<topic, words array<string>>``."""
    keywords = F.array_join(F.slice("words", 1, count), ", ")
    prompt = F.concat(
        instruction(domain), F.lit("\n" + REPLY_FORMAT + "\nKeywords: "), keywords, F.lit("\nJSON:")
    )
    return topics.select(topic, "words", keywords.alias("keywords"), prompt.alias("prompt"))


def representative_documents(
    docs: DataFrame,
    count: int = 5,
    width: int = 200,
    vector: str | None = "embedding",
    topic: str = "topic",
    key: str = "doc_id",
    text: str = "text",
    seed: int = 23,
) -> DataFrame:
    """``<topic, rank, key, text>``: documents nearest to the topic centroid, or a repeatable
    random pick when there are no vectors; texts clipped to ``width``.

    Only keys and distances are ranked; texts join back for the few winners.
    """
    if vector:
        held = assigned(docs, topic).select(topic, key, as_doubles(F.col(vector)).alias("_v"))
        ranked = held.join(topic_centroids(docs, topic, vector), topic).select(
            topic, key, distance(F.col("_v"), F.col("centroid")).alias("_d")
        )
        order = Window.partitionBy(topic).orderBy("_d", key)
        best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).select(topic, "rank", key)
    else:
        best = sample_per_topic(docs.select(topic, key), count, topic, key, seed).select(
            topic, F.col("pick").alias("rank"), key
        )
    return best.join(docs.select(key, text), key).select(topic, "rank", key, clip(F.col(text), width).alias("text"))


def document_prompts(
    representatives: DataFrame,
    topics: DataFrame | None = None,
    domain: Column | str = "customer_reviews",
    hints: int = 10,
    topic: str = "topic",
) -> DataFrame:
    """``<topic, docs, words, prompt>`` from representative documents and optional keywords."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    grouped = representatives.groupBy(topic).agg(F.transform(listed, lambda d: d["text"]).alias("docs"))
    if topics is None:
        grouped = grouped.withColumn("words", F.lit(None).cast("array<string>"))
    else:
        grouped = grouped.join(topics.select(topic, "words"), topic, "left")
    numbered = F.array_join(
        F.transform("docs", lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d)), "\n"
    )
    hint = F.when(
        F.col("words").isNotNull(), F.concat(F.lit("\nKey terms: "), F.array_join(F.slice("words", 1, hints), ", "))
    ).otherwise("")
    prompt = F.concat(
        instruction(domain, documents=True), F.lit("\n" + REPLY_FORMAT + "\nDocuments:\n"), numbered, hint, F.lit("\n\nJSON:")
    )
    return grouped.select(topic, "docs", "words", prompt.alias("prompt"))


def generate(
    prompts: DataFrame,
    make_generator: Callable[[], Callable[..., list[str]]],
    max_new_tokens: int = 20,
    temperature: float = 0.3,
    topic: str = "topic",
) -> DataFrame:
    """``<topic, reply, failed>`` by an outside model.

    ``make_generator`` runs once per task and returns a function from a list of prompts (with
    ``max_new_tokens`` and ``temperature``) to texts. A prompt whose call fails is marked.
    """
    kind = prompts.schema[topic].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        try:
            model = make_generator()
        except Exception:  # a model that cannot load means fallback names, not a failed job
            pass
        for pdf in batches:
            replies, failed = [], []
            for prompt in pdf["prompt"]:
                try:
                    text = model([prompt], max_new_tokens=max_new_tokens, temperature=temperature)[0]
                    replies.append(text)
                    failed.append(False)
                except Exception:
                    replies.append("")
                    failed.append(True)
            yield pd.DataFrame({topic: pdf[topic], "reply": replies, "failed": failed})

    return prompts.select(topic, "prompt").mapInPandas(work, f"{topic} {kind}, reply string, failed boolean")


def strip_prompt(reply: Column, prompt: Column) -> Column:
    """The part of a reply after an echoed prompt."""
    return F.trim(F.when(F.startswith(reply, prompt), F.substr(reply, F.length(prompt) + 1)).otherwise(reply))


def parse_reply(reply: Column) -> Column:
    """``struct<name, reasoning>`` from a reply: JSON, else the quoted fields, else empty."""
    parsed = F.from_json(reply, "topic_name string, reasoning string")
    # Broken JSON parses to nulls; a whole object that lacks a field does not fall through.
    whole = F.json_object_keys(reply).isNotNull() & F.endswith(F.trim(reply), F.lit("}"))

    def field(name: str) -> Column:
        # a backslash takes the next character along, so an escaped quote does not end the value
        loose = F.regexp_extract(reply, '"' + name + r'"\s*:\s*"((?:\\.|[^"\\])*)', 1)
        loose = F.regexp_replace(loose, r'\\(["\\/])', "$1")
        return F.trim(F.when(whole, F.coalesce(parsed[name], F.lit(""))).otherwise(loose))

    return F.struct(field("topic_name").alias("name"), field("reasoning").alias("reasoning"))


def keyword_name(words: Column, separator: str = " & ", count: int = 3) -> Column:
    return F.array_join(F.slice(words, 1, count), separator)


def names_from_keywords(prompts: DataFrame, replies: DataFrame | None = None, topic: str = "topic") -> DataFrame:
    """``<topic, name, reasoning>`` from keyword prompts and the model's replies, if any."""
    if replies is None:
        return prompts.select(topic, keyword_name(F.col("words")).alias("name"), F.lit("").alias("reasoning"))
    held = prompts.join(replies, topic, "left").withColumn("failed", F.coalesce("failed", F.lit(True)))
    parsed = held.withColumn("p", parse_reply(strip_prompt(F.coalesce("reply", F.lit("")), F.col("prompt"))))
    name = F.when(F.col("failed"), keyword_name(F.col("words"), "_")).when(
        F.col("p.name") == "", keyword_name(F.col("words"), ", ")
    ).otherwise(F.col("p.name"))
    reason = F.when(F.col("failed"), "").when(
        F.col("p.reasoning") == "", F.concat(F.lit("Keywords: "), F.substring("keywords", 1, 50))
    ).otherwise(F.col("p.reasoning"))
    return parsed.select(topic, name.alias("name"), reason.alias("reasoning"))


def frequent_words(docs: DataFrame, count: int = 3, first: int = 3, topic: str = "topic", rank: str = "rank", text: str = "text") -> DataFrame:
    """``<topic, name>``: the most frequent words of four or more ASCII letters in each topic's
    first documents, ties by first occurrence; "Topic" when there are none."""
    held = docs.filter(F.col(rank) <= first)
    words = held.select(
        topic, F.col(rank).alias("_r"), F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([a-z]{4,})(?![\p{L}\p{N}_])"), F.lit(1))).alias("_p", "_w")
    )
    counted = words.groupBy(topic, "_w").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_r", "_p")).alias("_at"))
    order = Window.partitionBy(topic).orderBy(F.desc("_n"), "_at")
    best = counted.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= count)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_w"))), lambda w: w["_w"])
    names = best.groupBy(topic).agg(F.array_join(listed, " & ").alias("name"))
    return held.select(topic).distinct().join(names, topic, "left").select(topic, F.coalesce("name", F.lit("Topic")).alias("name"))


def names_from_documents(
    prompts: DataFrame,
    representatives: DataFrame,
    replies: DataFrame,
    topic: str = "topic",
) -> DataFrame:
    """``<topic, name, reasoning>`` from document prompts and the model's replies."""
    spare = frequent_words(representatives, topic=topic).withColumnRenamed("name", "spare")
    held = prompts.join(replies, topic, "left").join(spare, topic, "left")
    held = held.withColumn("failed", F.coalesce("failed", F.lit(True)))
    parsed = held.withColumn("p", parse_reply(strip_prompt(F.coalesce("reply", F.lit("")), F.col("prompt"))))
    fallback = F.coalesce(F.when(F.size("words") > 0, keyword_name(F.col("words"))), F.col("spare"), F.lit("Topic"))
    name = F.when(F.col("failed") | (F.col("p.name") == ""), fallback).otherwise(F.col("p.name"))
    based = F.format_string("Based on %d representative documents", F.size("docs"))
    reason = F.when(F.col("failed"), "").when(F.col("p.reasoning") == "", based).otherwise(F.col("p.reasoning"))
    return parsed.select(topic, name.alias("name"), reason.alias("reasoning"))


def fallback_names(
    docs: DataFrame, topics: DataFrame | None = None, topic: str = "topic", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``<topic, name, reasoning>`` without any model: keywords where known, else frequent words
    of the topic's first three documents."""
    held = assigned(docs, topic)
    sizes = held.groupBy(topic).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(topic).orderBy(key)
    first = held.select(topic, key).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 3)
    spare = frequent_words(first.join(docs.select(key, text), key), topic=topic, text=text)
    named = sizes.join(spare, topic, "left")
    if topics is None:
        named = named.withColumn("words", F.lit(None).cast("array<string>"))
    else:
        named = named.join(topics.select(topic, "words"), topic, "left")
    name = F.coalesce(F.when(F.size("words") > 0, keyword_name(F.col("words"))), F.col("name"), F.lit("Topic"))
    return named.select(
        topic, name.alias("name"), F.format_string("Fallback name from %d documents", F.col("_n")).alias("reasoning")
    )
