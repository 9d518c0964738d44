"""Connected components of a table of links, by repeated star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import stored
from themeloom.operators.joins import join_heavy


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """``node``, ``root``: the smallest node that each linked node reaches.

    Alternates large-star and small-star steps: every node's larger, then its smaller neighbours are
    linked to the smallest one. Minima combine before the shuffle, so a centre with many links costs one
    row a task there, and the links of such a centre are not shuffled by it. Each round is written to the shared folder. Links of a node to itself and nulls give nothing.
    """
    a, b = F.col(first).cast("long"), F.col(second).cast("long")
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a.isNotNull() & b.isNotNull() & (a != b))
    links = stored(links.distinct(), "links")
    before = _state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        least = stored(least.select("c", F.least("c", "m").alias("m"), "n"), "least")
        larger = links.select(F.col("b").alias("c"), F.col("a").alias("v"))
        links = join_heavy(larger, least, ["c"]).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        links = stored(links, "links")
        least = stored(links.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        moved = join_heavy(links.withColumnRenamed("a", "c"), least, ["c"])
        smaller = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(smaller.union(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
