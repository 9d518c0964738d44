"""Corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Every stage reads all documents that its predecessor kept and returns the columns of ``documents``; the last
one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import packing, quality_classifier, quality_rules, simhash
from themeloom.llm.common import read, stored

TOKENIZER, END = "word_bpe_49k.json", 2


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines; ``n_chars`` follows the text."""
    kept = quality_rules.keep(docs)
    new = {"text": F.col("rules.clean_text"), "n_chars": F.length("rules.clean_text").cast("long")}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more; the model learns from the labelled rows of the whole corpus."""
    model = quality_classifier.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).filter("score >= 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose fingerprints link: the one of the smallest id, by the first row among equal ids.

    Rows are told apart by a number of their own, so different texts under one id, and texts without an id, are judged like all others.
    """
    row = "_" * (1 + max(map(len, docs.columns)))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = stored(simhash.near_duplicates(rows, key=row), "groups")
    names = rows.select(F.col(row).alias("doc_id"), F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row")).alias("name"))
    first = found.join(names, "doc_id").groupBy("component_id").agg(F.min("name").alias("name"))
    # a merge join at every size: what is kept grows with the corpus and is not for broadcasting
    chosen = first.select(F.col("name.row").alias(row)).hint("merge")
    return rows.join(chosen, row, "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of windows of 4,096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("simhash near-dedup", near_dedup), ("packing", packed)]

#: The classifier and the tokenizer have no SQL form; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
