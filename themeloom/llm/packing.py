"""Packing documents into windows by non-negative least squares over length combinations.

Documents become token ids and are cut into pieces of at most one window. The histogram of piece
lengths (at most one number a length, gathered from all documents) is matched by combinations of up
to three lengths that fill a window; repeat counts come from non-negative least squares, are rounded
down to what the histogram holds, and what remains is packed greedily, largest first. Every piece then
finds its window from its rank among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import python_ready, stored

WINDOW = 4096


def combinations(lengths: np.ndarray, window: int, each: int = 12) -> list[tuple[int, ...]]:
    """Up to ``each`` combinations of at most three lengths led by every length, the fullest first.

    ``lengths`` ascend. A leading length is the largest of its combination.
    """
    out: set[tuple[int, ...]] = set()
    for lead in lengths[::-1].tolist():
        gap = window - lead
        fit = lengths[: np.searchsorted(lengths, min(gap, lead), "right")]
        if not len(fit):
            out.add((lead,))
            continue
        found = [(gap - int(b), (lead, int(b))) for b in fit[-2:]]
        spread = fit[np.unique(np.linspace(0, len(fit) - 1, 4 * each).astype(int))]
        third = np.searchsorted(lengths, np.minimum(gap - spread, spread), "right") - 1
        found += [(gap - int(b) - int(lengths[k]), (lead, int(b), int(lengths[k]))) for b, k in zip(spread, third, strict=True) if k >= 0]
        out.update(c for _, c in sorted(found)[:each])
    return sorted(out, reverse=True)


def repeats(combos: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x for which the lengths used by x times each combination are nearest to the counts.

    Accelerated projected gradient; the matrix has at most three entries a column.
    """
    width = max(map(len, combos))
    place = np.full((len(combos), width), len(lengths))
    for j, c in enumerate(combos):
        place[j, : len(c)] = np.searchsorted(lengths, c)
    flat = place.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, width), len(lengths) + 1)[:-1]

    def slope(r: np.ndarray) -> np.ndarray:
        return np.append(r, 0.0)[place].sum(1)

    v = np.ones(len(combos))
    for _ in range(20):
        v = slope(used(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - slope(used(y) - counts) / (1.05 * bound))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """Windows as [(length, how many), ...] with their repeat counts; uses every piece exactly once."""
    left = {k: n for k, n in histogram.items() if n > 0}
    if not left:
        return []
    lengths = np.array(sorted(left))
    out = []
    combos = combinations(lengths, window)
    x = repeats(combos, lengths, np.array([left[k] for k in lengths.tolist()], float))
    for j in np.argsort(-x, kind="stable").tolist():
        need = {k: combos[j].count(k) for k in combos[j]}
        n = min(int(x[j]), *(left[k] // m for k, m in need.items()))
        # one that leaves more than a hundredth open is left to the greedy step
        if n > 0 and sum(combos[j]) >= 0.99 * window:
            out.append((sorted(need.items(), reverse=True), n))
            for k, m in need.items():
                left[k] -= n * m
    sizes = sorted(k for k, n in left.items() if n)
    while sizes:
        gap, need = window, {}
        while gap:
            at = int(np.searchsorted(sizes, gap, "right")) - 1
            while at >= 0 and left[sizes[at]] <= need.get(sizes[at], 0):
                at -= 1
            if at < 0:
                break
            k = sizes[at]
            m = min(left[k] - need.get(k, 0), gap // k)
            need[k] = need.get(k, 0) + m
            gap -= m * k
        n = min(left[k] // m for k, m in need.items())
        out.append((sorted(need.items(), reverse=True), n))
        for k, m in need.items():
            left[k] -= n * m
        sizes = [k for k in sizes if left[k]]
    return out


def slots(planned: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many in a window, first window, offset) for each run of ranks of a length."""
    out, rank, first = [], {}, 0
    for need, n in planned:
        offset = 0
        for k, m in need:
            out.append((k, rank.get(k, 0), m, first, offset))
            rank[k] = rank.get(k, 0) + n * m
            offset += k * m
        first += n
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end: int, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their ``ids`` (little-endian uint32), and their rank among those of one length in one task (``part``)."""
    python_ready(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.packing import PIECES
        from themeloom.llm.word_ids import encoder, filled, portions

        words, seen = encoder(tokenizer), {}
        for batch in batches:
            parts, doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), filled(batch.column(2))
            for low, high in portions(texts):
                ids, sizes = words.encode(texts.slice(low, high - low), end)
                ids, at, rows = ids.astype("<u4"), 0, []
                for n, size in enumerate(sizes.tolist(), low):
                    for start in range(0, size, window):
                        length = min(window, size - start)
                        rank = seen[length] = seen.get(length, -1) + 1
                        rows.append((doc_ids[n], start, length, ids[at + start : at + start + length].tobytes(), size, parts[n], rank))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    rows = docs.select(F.spark_partition_id().alias("part"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, part int, rank long")


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
)


def pack_documents(docs: DataFrame, tokenizer: str, end: int, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    Null texts count as empty and give the end id alone; null and repeated doc_ids are rows like any
    other; an empty table gives no rows. Pieces of a window lie without gaps from offset 0; the rest of
    the window is padding. The driver holds one count and a few runs a length, whatever the input.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, end, window, key, text), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = stored(by_part.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "lengths")
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(slots(plan(histogram, window)), "length long, low long, many long, first long, offset long")
    runs = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "many", "first", "offset"))).alias("runs"))
    # the runs of a length go to every task: with a window of 4,096 about 104,000 in all, from a million documents on;
    # the counts before a task grow with the tasks and meet the pieces in a join
    placed = pieces.join(by_part.select("part", "length", "before"), ["part", "length"]).join(F.broadcast(runs), "length")
    nth = F.col("rank") + F.col("before")
    run = F.element_at(F.filter("runs", lambda r: r["low"] <= F.col("nth")), -1)
    placed = placed.withColumn("nth", nth).withColumn("run", run).withColumn("nth", F.col("nth") - F.col("run.low"))
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("run.first") + F.expr("nth div run.many")).alias("sequence_id"),
        (F.col("run.offset") + F.col("length") * F.expr("nth % run.many")).alias("offset"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from themeloom.llm.common import read

    rows = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
