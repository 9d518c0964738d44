"""Joins that hold where one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one in so many rows is heavy.
HEAVY = 500


def join_heavy(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a written ``table`` that names each key once, with its number ``n`` of rows.

    Heavy keys, fewer than HEAVY by their definition, go to every task; the rows of all others meet them by a shuffle.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    heavy = table.filter(F.col("n") * HEAVY > total)
    if not heavy.limit(1).count():
        return rows.join(table, on, how)
    split = rows.join(F.broadcast(heavy.select(*on, F.lit(True).alias("_heavy"))), on, "left")
    light = split.filter("_heavy IS NULL").drop("_heavy").join(table, on, how)
    return rows.join(F.broadcast(heavy), on).unionByName(light)
