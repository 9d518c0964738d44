"""Iterative programs over edge tables: components, spanning forests, numbering.

Rounds run on the cluster and contract the graph; every round is cut with a checkpoint. Once
the contracted graph is counted and found small (``LOCAL_EDGES``), one task finishes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.session import cut_lineage

LOCAL_EDGES = 200_000


class DisjointSets:
    """Union by smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def in_one_task(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn`` to a table whose size the caller has checked."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(1).mapInPandas(work, schema)


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping on ``<c, p>`` until every pointer reaches a root."""
    parent = cut_lineage(parent)
    while True:
        above = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        jumped = cut_lineage(parent.join(above, "p").select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
        if not jumped.filter("moved").head(1):
            return jumped.drop("moved")
        parent = jumped.drop("moved")


def connected_components(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``<id, root>`` for every id in ``edges <u, v>``; the root is the smallest id."""
    limit = LOCAL_EDGES if limit is None else limit
    edges = cut_lineage(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    ids = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    edges = edges.filter("u != v")
    labels = None
    left = edges.count()
    while left > limit:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = _flatten(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("p")).withColumn("p", F.least("c", "p")))
        labels = _follow(labels, parent)
        edges = _contract(edges, parent)
        left = edges.count()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = DisjointSets()
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            sets.union(u, v)
        return pd.DataFrame([(x, sets.find(x)) for x in list(sets.parent)], columns=["c", "p"])

    if left:
        labels = _follow(labels, cut_lineage(in_one_task(edges.select("u", "v"), finish, "c long, p long")))
    if labels is None:
        return ids.select("id", F.col("id").alias("root"))
    return ids.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _follow(labels: DataFrame | None, parent: DataFrame) -> DataFrame:
    """Extend ``<id, root>`` by one contraction ``<c, p>``."""
    if labels is None:
        return parent.select(F.col("c").alias("id"), F.col("p").alias("root"))
    moved = labels.join(parent, labels["root"] == parent["c"], "left").select("id", F.coalesce("p", "root").alias("root"))
    return cut_lineage(moved)


def _contract(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges between contracted nodes, each once."""
    pu = parent.select(F.col("c").alias("u"), F.col("p").alias("pu"))
    pv = parent.select(F.col("c").alias("v"), F.col("p").alias("pv"))
    moved = edges.join(pu, "u").join(pv, "v").filter("pu != pv")
    return cut_lineage(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())


def minimum_forest(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``<u, v, w>``: a minimum spanning forest of ``edges <u, v, w>`` (Boruvka rounds).

    Edges are totally ordered by (w, u, v), so rounds cannot close a cycle.
    """
    limit = LOCAL_EDGES if limit is None else limit
    tidy = edges.filter("u != v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    live = cut_lineage(tidy.select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.struct("w", "u", "v").alias("e")))
    kept = None
    left = live.count()
    while left > limit:
        both = live.unionByName(live.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "e"))
        best = cut_lineage(both.groupBy(F.col("cu").alias("c")).agg(F.min(F.struct("e", "cv")).alias("b")).select("c", "b.e", F.col("b.cv").alias("p")))
        chosen = best.select("e").distinct()
        kept = chosen if kept is None else kept.unionByName(chosen)
        back = best.select(F.col("c").alias("p"), F.col("p").alias("back"))
        rooted = best.join(back, "p").select(
            "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")
        )
        parent = _flatten(rooted)
        pu = parent.select(F.col("c").alias("cu"), F.col("p").alias("pu"))
        pv = parent.select(F.col("c").alias("cv"), F.col("p").alias("pv"))
        moved = live.join(pu, "cu").join(pv, "cv").filter("pu != pv")
        live = cut_lineage(
            moved.groupBy(F.least("pu", "pv").alias("cu"), F.greatest("pu", "pv").alias("cv")).agg(F.min("e").alias("e"))
        )
        left = live.count()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = DisjointSets()
        pdf = pdf.sort_values(["w", "u", "v"])
        taken = [sets.union(a, b) for a, b in zip(pdf["cu"].tolist(), pdf["cv"].tolist())]
        return pdf.loc[taken, ["u", "v", "w"]]

    last = in_one_task(live.select("cu", "cv", "e.u", "e.v", "e.w"), finish, "u long, v long, w double")
    return last if kept is None else kept.select("e.u", "e.v", "e.w").unionByName(last)


def consecutive(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """Number rows 0, 1, ... in ``order`` with a range-partitioned sort; only one count per
    partition is brought together."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_rows.withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    return (
        placed.join(before, "_p")
        .withColumn(out, (F.col("_before") + F.col("_r") + start).cast("long"))
        .drop("_m", "_p", "_r", "_before")
    )
