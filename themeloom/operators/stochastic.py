"""A layout of a neighbour graph by sampled attraction and repulsion.

In a round, each edge pulls its ends together with a chance that grows with its weight, and each end is pushed away from a few
points drawn at random. A point moves by the sum of its pulls and pushes, all worked out at the places of the round before, so
a round is one join and one grouped sum. Steps shrink to nothing over the rounds, and the places of the last rounds are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.selection import shuffle_key
from themeloom.session import cut_lineage

#: Points from which pushes are drawn in a round, at most: they go to every task.
SHOWN = 4000
#: The longest single pull or push along one axis.
REACH = 4.0


def closeness_curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """``a, b`` of ``1 / (1 + a d^(2b))``, nearest to a curve that is 1 up to ``min_dist`` and falls by ``exp(-(d - min_dist) / spread)`` beyond."""
    if min_dist < 0 or spread <= 0 or min_dist > 3 * spread:
        raise ValueError(f"min_dist must lie between 0 and three times the spread, got {min_dist}")
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    log_a, b = 0.0, 1.0
    damping, best = 1e-3, np.inf
    # damped least squares in (log a, b)
    for _ in range(200):
        power = np.exp(log_a) * d ** (2 * b)
        fit = 1 / (1 + power)
        miss = want - fit
        slope = np.stack([-fit * fit * power, -fit * fit * power * 2 * np.log(d)], axis=1)
        square = slope.T @ slope
        step = np.linalg.solve(square + damping * np.diag(np.diag(square)), slope.T @ miss)
        trial = np.exp(log_a + step[0]) * d ** (2 * (b + step[1]))
        error = float(((want - 1 / (1 + trial)) ** 2).sum())
        if error <= best:
            log_a, b, best, damping = log_a + step[0], b + step[1], error, damping / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            damping *= 4
    return float(np.exp(log_a)), float(b)


def _pull(apart: np.ndarray, a: float, b: float) -> np.ndarray:
    square = (apart**2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        force = np.where(square > 0, -2 * a * b * square ** (b - 1) / (1 + a * square**b), 0.0)
    return np.clip(force[:, None] * apart, -REACH, REACH)


def _push(apart: np.ndarray, a: float, b: float) -> np.ndarray:
    square = (apart**2).sum(1)
    force = np.where(square > 0, 2 * b / ((0.001 + square) * (1 + a * square**b)), 0.0)
    return np.clip(force[:, None] * apart, -REACH, REACH)


def stochastic_layout(
    edges: DataFrame, start: DataFrame, min_dist: float = 0.1, spread: float = 1.0, rounds: int = 60, averaged: int = 5, pushes: int = 5, step: float = 1.0, seed: int = 42
) -> DataFrame:
    """``<id, reduced>``: the points of ``start <id, reduced>`` moved by the edges ``<u, v, w>``.

    Points without edges stay where they start. ``min_dist`` says how close neighbours may come: with 0 they clump, with more
    they keep apart.
    """
    a, b = closeness_curve(min_dist, spread)
    both = edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    heaviest = both.agg(F.max("w")).first()[0]
    places = cut_lineage(start.select("id", F.col("reduced").alias("y")))
    width = places.agg(F.max(F.size("y"))).first()[0]
    if heaviest is None or width is None:
        return places.select("id", F.col("y").alias("reduced"))
    # dealt once, by the end that moves; a round joins the places of both ends
    held = cut_lineage(both.select("u", "v", (F.col("w") / heaviest).alias("p")).repartition("u"))
    total = None
    for number in range(rounds):
        rate = step * (1 - number / rounds)
        # another draw each round, by the hash of the point
        shown = np.array([r.y for r in places.orderBy(shuffle_key("id", seed + number), "id").limit(SHOWN).collect()])

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                here, there = np.stack(pdf["yu"].to_numpy()), np.stack(pdf["yv"].to_numpy())
                sums = _pull(here - there, a, b)
                # the draw of an edge follows from its ends and the round, so a task that runs again draws the same
                draws = pdf["draw"].to_numpy().astype(np.uint64)
                for i in range(pushes):
                    draws = (draws ^ draws >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
                    at = (draws >> np.uint64(16)) % np.uint64(len(shown))
                    sums = sums + _push(here - shown[at.astype(np.int64)], a, b)
                yield pd.DataFrame({"id": pdf["u"], **{f"g{j}": sums[:, j] for j in range(width)}})

        draw = F.xxhash64("u", "v", F.lit(seed + number))
        active = held.withColumn("draw", draw).filter(F.pmod("draw", F.lit(1_000_003)) / 1_000_003.0 < F.col("p"))
        ends = active.join(places.select(F.col("id").alias("u"), F.col("y").alias("yu")), "u").join(places.select(F.col("id").alias("v"), F.col("y").alias("yv")), "v")
        sums = ends.select("u", "draw", "yu", "yv").mapInPandas(move, "id long, " + ", ".join(f"g{j} double" for j in range(width)))
        moves = sums.groupBy("id").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(width)])
        new = F.array(*[F.col("y")[j] + rate * F.coalesce(F.col(f"g{j}"), F.lit(0.0)) for j in range(width)])
        keep = number >= rounds - averaged
        joined = places if total is None else places.join(total, "id")
        before = F.col("s") if total is not None else F.array_repeat(F.lit(0.0), width)
        added = F.zip_with(before, "z", lambda x, y: x + y) if keep else before
        moved = cut_lineage(joined.join(moves, "id", "left").withColumn("z", new).select("id", F.col("z").alias("y"), added.alias("s")))
        places, total = moved.select("id", "y"), moved.select("id", "s")
    n = min(averaged, rounds)
    return total.select("id", F.transform("s", lambda x: x / n).alias("reduced")) if n else places.select("id", F.col("y").alias("reduced"))


def preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``<n_edges, preserved>``: the share of each point's neighbours ``<src, dst>`` that are still its neighbours."""
    hits = before.select("src", "dst").join(after.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_edges"), F.avg(F.coalesce("hit", F.lit(0))).alias("preserved"))
